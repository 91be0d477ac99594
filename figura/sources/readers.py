"""Readers and writers for the corpus formats: JSON lines, CSV in two null
regimes, XML corpora (one big fragment file, or one file per source key).

Schemas are always explicit: nothing is inferred.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figura.session import staged
from figura.sources.files import children, locate, reachable, read_text, write_text

LABELS_SCHEMA = "id string, y int"
LEMMAS_SCHEMA = "id string, x struct<`U-lemmaByPOS`:string>"
# Strings read as missing by the default-NA regime (pandas-style defaults).
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_labels_jsonl(spark: SparkSession, path) -> DataFrame:
    """``{"id": ..., "y": ...}`` lines -> ``(id, y)``."""
    return spark.read.schema(LABELS_SCHEMA).json(path).select("id", "y")


def read_lemmas_jsonl(spark: SparkSession, paths) -> DataFrame:
    """Nested ``{"x": {"U-lemmaByPOS": ...}, "id": ...}`` lines (one or many
    files) -> ``(verb_lemma, id)``."""
    return spark.read.schema(LEMMAS_SCHEMA).json(paths) \
        .select(F.col("x.`U-lemmaByPOS`").alias("verb_lemma"), "id")


def read_index_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header row (the example index)."""
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def read_headerless_labels_csv(spark: SparkSession, path) -> DataFrame:
    """Headerless ``id,y`` CSV."""
    return spark.read.schema(LABELS_SCHEMA).csv(path)


def read_csv_keep_blanks(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV where empty fields are empty strings and words like ``NA`` stay
    words (string columns null-filled with ``''``)."""
    df = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.na.fill("", subset=strings)


def read_csv_r(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV where only empty fields and ``NA`` are null (``null``, ``nan`` and
    ``None`` are words)."""
    return read_csv_default_na(spark, path, schema, ("", "NA"))


def read_csv_default_na(spark: SparkSession, path, schema: str, na=NA_STRINGS) -> DataFrame:
    """CSV where empty fields and the usual NA spellings are null."""
    df = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            out = out.withColumn(f.name, F.when(F.col(f.name).isin(*na), None)
                                 .otherwise(F.col(f.name)))
    return out


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header, doubled quotes, empty strings written as empty fields.
    ``single_file`` coalesces to one part (small exports only)."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("emptyValue", "").csv(path))


def _records(spark: SparkSession, path, tag: str) -> DataFrame:
    """The file cut at ``</tag>``: ``(path, block, mid, value)``, in order of
    (block, mid) within a file, each without its closing tag."""
    return spark.read.option("lineSep", f"</{tag}>").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), "value")


def _outer_fragments(records: DataFrame, tag: str, opening: str, chunk: int = 64) -> DataFrame:
    """``(content)`` of the identified elements around other ones, which span
    records.

    A record opens as many elements as it has opening tags and closes one. All
    but its last opening tag, and its closing tag if it opens nothing, belong
    to such elements. Level by level these tags alternate, so an element's end
    is the next row of its level. Only numbers are shuffled, and only of such
    records; then the records of each element's range are joined by chunks of
    positions. An element without an id can't be asked for and is left out, so
    a wrapper around the whole corpus costs nothing.
    """
    opens = F.regexp_count("value", F.lit(opening)).cast("long")
    slim = records.select("path", "block", "mid", opens.alias("opens"))
    blocks = slim.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("opens") - 1).alias("net"))
    above = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("path", "block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("n", "net")])
    inside = Window.partitionBy("path", "block").orderBy("mid")
    placed = (slim.withColumn("row", F.row_number().over(inside))
              .withColumn("run", F.sum(F.col("opens") - 1).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .join(bases, ["path", "block"])
              .select("path", "block", "mid", "opens", (F.col("n0") + F.col("row")).alias("pos"),
                      (F.col("net0") + F.col("run") - F.col("opens") + 1).alias("depth")))
    odd = placed.where("opens <> 1")
    k = F.when(F.col("opens") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("opens") - 2))
    tags = odd.select("path", "block", "mid", "pos", "depth", F.explode(k).alias("k")).select(
        "path", "block", "mid", "pos", "k", (F.col("depth") + F.col("k")).alias("level"))
    level = Window.partitionBy("path", "level").orderBy("pos", "k")
    spans = (tags.withColumn("next_k", F.lead("k").over(level)).withColumn("upto", F.lead("pos").over(level))
             .where("k >= 0 AND next_k = -1").select("path", F.col("pos").alias("from"), "upto", "k"))
    want = spans.withColumn("c", F.explode(F.sequence(F.expr(f"`from` div {chunk}"), F.expr(f"upto div {chunk}"))))
    texts = (records.join(placed.select("path", "block", "mid", "pos", "opens"), ["path", "block", "mid"])
             .withColumn("c", F.expr(f"pos div {chunk}")))
    hit = texts.join(want, ["path", "c"]).where("pos BETWEEN `from` AND upto")
    parts = F.split("value", f"(?={opening})", -1)
    own = F.array_join(F.slice(parts, (F.size(parts) - F.col("opens") + F.col("k") + 1).cast("int"), F.size(parts)), "")
    piece = F.concat(F.when(F.col("pos") == F.col("from"), own).otherwise(F.col("value")), F.lit(f"</{tag}>"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", piece.alias("x"))))
    return (hit.groupBy("path", "from", "k").agg(F.array_join(F.transform(pairs, lambda p: p["x"]), "").alias("content"))
            .select("content"))


def scan_fragments(spark: SparkSession, path, tag: str = "text") -> DataFrame:
    """One record per ``<tag ...>...</tag>`` fragment of a large XML file.

    The file is split on the closing tag, so one corpus file spreads over
    many tasks; each record is cut back to its last (innermost) opening tag
    and closed again. Elements around other ones are put together from their
    records if they have an id. Returns ``(fragment_id, content)`` with the
    opening tag's ``xml:id`` in either kind of quotes; elements whose names
    only begin with ``tag`` and the ids of other elements don't count."""
    close = f"</{tag}>"
    opening = rf"<{tag}(?:\s[^>]*)?(?<!/)>"
    records = _records(spark, path, tag)
    body = F.regexp_extract(F.col("value"), rf"(?s)^.*({opening}.*)$", 1)
    inner = records.select(body.alias("b")).where(F.col("b") != "").select(F.concat("b", F.lit(close)).alias("content"))
    first = F.regexp_extract("content", f"^{opening}", 0)
    fid = F.regexp_extract(first, r"""\sxml:id\s*=\s*(["'])(.*?)\1""", 2)
    outer = _outer_fragments(records, tag, opening).withColumn("fragment_id", fid).where("fragment_id <> ''")
    return inner.select(fid.alias("fragment_id"), "content").unionByName(outer)


# Layouts of a source corpus: the key is the file's name, or its folder's.
KEY_IN_FILE_NAME = r"/([^/]+)\.xml$"
KEY_IN_FOLDER = r"/key=([^/]+)/[^/]+$"


#: Folders that ``write_keyed_files`` deals its files to.
FOLDERS = 256


def write_keyed_files(docs: DataFrame, root: str, key: str = "key", content: str = "content") -> str:
    """One file per key under ``root``, written by the tasks, and the layout
    to scan them by. A key is a file name; rows of one key are lines of its
    file, and rows without a key, which nobody can ask for, are not written. A
    file costs no folder, no rename and nothing on the driver. In a store that
    only Spark reaches, its own writer makes a folder per key."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).where("key IS NOT NULL")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key")
    if not reachable(root):
        dealt.write.mode("overwrite").partitionBy("key").text(root)
        return KEY_IN_FOLDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = locate(root)
        made, last, lines = set(), None, []

        def close():
            folder = f"{zlib.crc32(last.encode()) % FOLDERS:02x}"
            if folder not in made:
                made.add(folder)
                fs.create_dir(f"{path.rstrip('/')}/{folder}", recursive=True)
            write_text(f"{root.rstrip('/')}/{folder}/{last}.xml", "".join(lines))
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != last and lines:
                    close()
                    lines = []
                last = k
                lines.append((x.as_py() or "") + "\n")
        if lines:
            close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([], pa.int64())})

    dealt.sortWithinPartitions("key").mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()
    return KEY_IN_FILE_NAME


def _list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path)`` of all files below a folder, listed by tasks level by level:
    neither folders nor files pass through the driver."""
    if any(c in root for c in "*?[{"):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                got = children(path)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([d for _, d in got], pa.bool_())],
                                                 names=["path", "folder"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([(root,)], "path string").coalesce(1), None
    while True:
        got = staged(level.mapInArrow(run, "path string, folder boolean"), "listing")
        found = got.where("NOT folder").select("path")
        files = found if files is None else files.unionByName(found)
        level = got.where("folder").select("path")
        if level.isEmpty():
            return files
        level = level.repartition(n, "path")


def scan_keyed_files(spark: SparkSession, root: str, keys: DataFrame, key_col: str,
                     layout: str = KEY_IN_FILE_NAME) -> DataFrame:
    """The wanted files of a corpus stored one file per key, in folders of any
    depth (``X/XY/XYZ.xml``, or ``key=XYZ/...``); ``layout`` is the pattern
    that finds the key in a file's path. Returns ``(key, path, content)``.

    Files are listed by tasks and without being opened, the list is cut down to the keys
    that ``keys`` mentions by a semi-join, and tasks open what is left: a file
    that nobody asks for is never read, and no list of keys passes through the
    driver. In a store that only Spark's own readers reach, all files are
    scanned and unwanted ones dropped."""
    want = keys.select(F.col(key_col).cast("string").alias("key")).distinct()
    if not reachable(root):
        files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
        path = F.col("_metadata.file_path")
        keyed = files.select(F.regexp_extract(path, layout, 1).alias("key"), path.alias("path"), F.col("value").alias("content"))
        return keyed.where(F.col("key") != "").join(want, "key", "left_semi")
    files = (_list_files(spark, root).select(F.regexp_extract("path", layout, 1).alias("key"), "path").where(F.col("key") != "")
             .join(want, "key", "left_semi"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):          # one file at a time: a batch is as large as its file
                key, path = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                yield pa.RecordBatch.from_pydict({"key": [key], "path": [path], "content": [read_text(path)]})

    # paths are short and files are not: spread them by number, not by bytes
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(load, "key string, path string, content string")
