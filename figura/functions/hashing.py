"""Deterministic hash buckets, identical in Spark and in ANSI SQL engines
(first 8 hex digits of md5 read as an unsigned integer)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def bucket(c, n) -> Column:
    """``md5_int(c) % n``; ``n`` may be a column."""
    n = n if isinstance(n, Column) else F.lit(n)
    return md5_int(c) % n
