"""Connected components of an edge table by alternating star contractions.

Every round is a few joins and map-side combined aggregations; the number of
rounds grows with the logarithm of the longest path. Nothing but a row count
and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import drop_staged, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v). ``large`` links every larger
    neighbour of a node to the smallest of its neighbourhood, otherwise every
    smaller neighbour and the node itself."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    t = both.join(least, "u")
    if large:
        out = t.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (t.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionAll(least.select("u", F.col("m").alias("v"))))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes with
    an edge to another node. Self-loops, repeated edges and null ends are
    ignored; an empty table gives no rows."""
    cur = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct(), "edges")
    mark = None
    while True:
        got = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not got[0] or tuple(got) == mark:
            break
        mark = tuple(got)
        nxt = stage(_star(_star(cur, True), False), "edges")
        drop_staged(cur)
        cur = nxt
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
            .unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
