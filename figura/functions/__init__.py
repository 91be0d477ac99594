"""Column-level expressions (built-in Spark functions only)."""
