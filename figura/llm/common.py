"""Helpers shared by the operators of this package: staging in the shared
folder, files that tasks read and write there, and gapless ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figura.session import shared_path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and gives the planner the measured size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders of staged frames that are no longer read."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder as a URI that tasks can open with ``open_fs``."""
    path = shared_path(spark, name)
    if path.startswith("file:"):
        path = "file://" + path[len("file:"):].replace("//", "", 1) if path.startswith("file://") \
            else "file://" + path[len("file:"):]
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (local, HDFS, S3, GCS)."""
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write one file, its folder included."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def has_words(c: Column) -> Column:
    """A string with a character besides ASCII white space."""
    return c.rlike(r"[^\x20\x09-\x0D]")


def gapless_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, rows: int) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each group, without gaps.

    A group may hold most of the rows: it is dealt into about sqrt(``rows``)
    hash buckets of its order columns; buckets are counted, the running sum of
    the counts is taken over the (few) buckets of a group, and rows are
    numbered inside their bucket only. Ranks follow bucket, then ``order``.
    Rows equal in all order columns get different ranks in any order.
    """
    n = max(1, math.isqrt(max(rows, 1)))
    t = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    seen = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (t.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(seen), F.lit(0).cast("long"))).drop("_n"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    return (t.join(offsets, [*group, "_b"])
            .withColumn(out, F.col("_off") + F.row_number().over(inside) - 1)
            .drop("_b", "_off"))


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle whose tasks do more work than their bytes
    tell: given as a number, they are not merged by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dense_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the row's ordinal (from 0) in the order of its columns.

    Rows are range-partitioned and sorted, numbered inside their partition and
    moved by the counts of the partitions before; no task sees all rows.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = stage(sorted_.withColumn("_m", F.monotonically_increasing_id()), "dense-rank")
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    before = (t.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")).alias("_before")))
    return (t.withColumn("_p", part).join(F.broadcast(before), "_p")
            .withColumn(out, F.col("_before") + row).drop("_p", "_m", "_before"))
