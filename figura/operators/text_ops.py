"""Row-expanding text operators (token tables)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figura.session import spread


def running_total(rows: DataFrame, keys: list[str], pos: str, amount: str, name: str,
                  chunk: int = 4096) -> DataFrame:
    """Inclusive running sum of ``amount`` in ``pos`` order within each key,
    computed in two levels so that no task holds a whole group: totals per
    (key, chunk of ``chunk`` positions) are aggregated map-side, a window
    over those few totals gives each chunk's base, and the final window
    runs within one chunk."""
    c = F.floor(F.col(pos) / chunk).alias("_chunk")
    rows = rows.withColumn("_chunk", c)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(amount).alias("_tot"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(wk), F.lit(0))).drop("_tot")
    wc = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding,
                                                                       Window.currentRow)
    return (rows.join(bases, [*keys, "_chunk"])
            .withColumn(name, F.col("_base") + F.sum(amount).over(wc)).drop("_chunk", "_base"))


def token_offsets(df: DataFrame, key: str, text: str = "text", min_partitions: int | None = None) -> DataFrame:
    """One row per whitespace token: ``(key, pos, token, start)`` where
    ``start`` is the 0-based character offset of the token in ``text``.

    Texts are cut where they are, batch by batch, without a shuffle (Python's
    and the tokenisers' white space are the same set; a running sum in SQL
    expressions is interpreted and three times slower). Inputs in fewer than
    ``min_partitions`` splits are spread first. Null and blank texts give
    no row; rows that repeat are cut each."""
    rows = spread(df.select(key, F.col(text).alias("_text")), min_partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, token, start = [], [], [], []
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if not t:
                    continue
                n = 0
                for n, m in enumerate(_TOKEN.finditer(t), 1):
                    token.append(m[0])
                    start.append(m.start())
                pos.extend(range(n))
                at.extend([i] * n)
                if len(token) >= _OFFSET_ROWS:
                    yield _offsets(b, key, at, pos, token, start)
                    at, pos, token, start = [], [], [], []
            if token:
                yield _offsets(b, key, at, pos, token, start)

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, token string, start int")


_TOKEN = re.compile(r"\S+")
_OFFSET_ROWS = 100_000


def _offsets(b: pa.RecordBatch, key: str, at: list, pos: list, token: list, start: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()),
                                       pa.array(token, pa.string()), pa.array(start, pa.int32())], names=[key, "pos", "token", "start"])
