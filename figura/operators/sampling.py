"""Seeded, exact-size sampling and ordinals.

Samples are ordered by ``md5(seed:id)``: the same rows come back for a given
seed whatever the partitioning, and the size is exact. Global top-n uses
Spark's ``TakeOrderedAndProject`` (per-partition top-n, one small merge).
Samples per group find the group's threshold from a histogram of the hashes
and rank only what is below it; top-n by other orders is two-staged, so that a
hot group is spread over salt buckets before the final per-group window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figura.functions.hashing import bucket


def sample_key(id_col, seed: int = 0) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def seeded_sample(df: DataFrame, n: int, seed: int = 0, id_col: str = "id",
                  key_name: str | None = None) -> DataFrame:
    """Exactly ``min(n, count)`` rows, chosen by the seeded hash order."""
    key = sample_key(id_col, seed)
    out = df.withColumn("_skey", key).orderBy("_skey", id_col).limit(n)
    return out.withColumnRenamed("_skey", key_name) if key_name else out.drop("_skey")


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    n: int, salt_on: str, salt_buckets: int = 32,
                    rank_name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order_cols`` (ties broken by
    the order columns, which must be unique within a group).

    Stage 1 keeps the top ``n`` of every (group, salt) bucket, so a group
    holding a third of the data is cut down in parallel; stage 2 ranks the
    at most ``n * salt_buckets`` survivors of each group.
    """
    salt = bucket(F.concat(F.lit("salt:"), F.col(salt_on).cast("string")), salt_buckets)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    stage1 = (df.withColumn("_salt", salt)
              .withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= n).drop("_r1", "_salt"))
    return stage1.withColumn(rank_name, F.row_number().over(w2)).where(F.col(rank_name) <= n)


def sample_per_group(df: DataFrame, group_cols: list[str], n: int, seed: int = 0,
                     id_col: str = "id", rank_name: str = "rank") -> DataFrame:
    """Seeded sample of ``n`` rows per group (all rows when fewer): the ``n``
    smallest sample keys, by ``bottom_k``."""
    keyed = df.withColumn("_skey", sample_key(id_col, seed))
    return bottom_k(keyed, group_cols, "_skey", n, [id_col], rank_name).drop("_skey")


def bottom_k(df: DataFrame, group_cols: list[str], key: str, n: int, ties: list[str], rank_name: str = "rank",
             digits: int = 5) -> DataFrame:
    """The ``n`` rows of each group with the smallest ``key``, a hexadecimal
    hash (ties by the columns ``ties``), ranked from 1.

    Each group's hashes are counted by their first ``digits`` digits, a summary
    that tasks build on their own and that adds up. The first count that
    reaches ``n`` tells which hashes can be among the smallest; only rows up to
    there, about ``n`` and a millionth of the group, are ranked. The size is
    exact, a group of any share of the rows is counted where its rows are, and
    nothing depends on a number of salts. A null group is a group."""
    head = F.substring(F.col(key), 1, digits)
    upto = Window.partitionBy(*group_cols).orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = df.groupBy(*group_cols, head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    limit = (counts.withColumn("_sum", F.sum("_n").over(upto)).where(F.col("_sum") - F.col("_n") < n)
             .groupBy(*group_cols).agg(F.max("_head").alias("_limit")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], "_limit"))
    same = head <= F.col("_limit")
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    rank = Window.partitionBy(*group_cols).orderBy(key, *ties)
    return (df.join(limit, same).drop("_limit", *[f"_g{i}" for i in range(len(group_cols))])
            .withColumn(rank_name, F.row_number().over(rank)).where(F.col(rank_name) <= n))


def head(df: DataFrame, n: int, order_cols: list) -> DataFrame:
    """First ``n`` rows under an explicit order."""
    return df.orderBy(*order_cols).limit(n)


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                start: int = 0, partitions: int | None = None) -> DataFrame:
    """Consecutive integers ``start, start+1, ...`` in ``order_cols`` order,
    computed without a single-partition window.

    Rows are range-partitioned and sorted, numbered within each partition,
    and checkpointed so the numbering is stable; each partition's offset is
    the running total of the (one-per-partition) counts before it.
    """
    # without an explicit count AQE sizes the range partitions; coalesced
    # partitions are contiguous ranges read in order, so numbering holds
    ranged = (df.repartitionByRange(partitions, *order_cols) if partitions
              else df.repartitionByRange(*order_cols))
    ranged = (ranged
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    with_pid = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a tiny single-partition window is fine here.
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).drop("_cnt")
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    return (with_pid.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local + F.lit(start)).cast("bigint"))
            .drop("_mid", "_pid", "_off"))
