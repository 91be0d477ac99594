"""Registry of the driver queries: a Spark plan per name and, where the
operator is expressible in SQL, an equivalent DuckDB query (the oracle).

Queries read whole tables. Doubles are rounded to ``DIGITS`` on both sides,
counts are BIGINT on both sides, and no query returns an array column (the
oracle compare is value based).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    from figura.plans import (q_analysis, q_assembly, q_corpus, q_evaluate, q_features,  # noqa: F401
                              q_markup, q_models, q_text)
