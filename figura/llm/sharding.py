"""Rendezvous (highest random weight) sharding of stable record keys.

DataFrame functions only. Each (key, shard) pair is hashed to u in (0, 1) and
scored ``-weight / ln(u)``; the shard with the highest score takes the record.
A key's scores do not depend on the other shards, so a further shard takes
rows only into itself, in proportion to its weight, and moves nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.llm.common import gapless_rank


def rendezvous_shard(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """Shard number (0-based int) of a record by its key columns.

    Ties in the score go to the lower shard. Null key columns hash like any
    other value: records with the same (null) key share a shard.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    scores = []
    for shard, weight in enumerate(weights):
        h = F.xxhash64(F.lit(shard), *[F.col(k) for k in keys])
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0 ** -53)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.array_max(F.array(*scores)) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard_records(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
                  keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Place every record: key columns, size, text_crc32, shard, slot and,
    with ``grown`` weights, grown_shard (its shard under those).

    ``size``: UTF-8 bytes of the text plus 1. ``slot``: gapless from 0 within
    the shard. Null text: size 1, checksum 0. Repeated rows each take a slot;
    other columns of ``docs`` are ignored, an empty table gives no rows.
    """
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        *keys,
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        rendezvous_shard(keys, weights).alias("shard"),
        (rendezvous_shard(keys, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    n = docs.count()
    return gapless_rank(rows, ["shard"], [*keys, "text_crc32", "size"], "slot", n)
