"""Composed jobs and the registered driver queries."""
