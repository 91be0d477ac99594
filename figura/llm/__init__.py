"""Training-data operators: archives, language-model scoring, deduplication,
quality rules, token files, sharding, decontamination and packing.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""
