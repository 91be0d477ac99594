"""Repeated line runs by a suffix array over line-ID sequences.

DataFrame functions only. The non-blank lines of the documents are sequences
of line IDs. Distributed prefix doubling ranks suffixes by their first 1, 2,
4, ... lines: the rank for 2h lines is the ordinal of the sorted pair (rank of
the suffix, rank of the suffix h lines on). A suffix whose prefix occurs once
has its final place and drops out, so a round handles repeated prefixes only.

Equal ranks at depth h are an interval of the suffix array with a longest
common prefix of at least h. A run of at least ``min_words`` words repeats
exactly if its minimal qualifying windows do (from each line forward, and from
each line backward, the fewest lines with that many words), and their union is
the maximal run; depth is therefore bounded by ``min_words`` lines. The
interval of a window of n lines is found from two overlapping ranks of the
largest power of two in n. The first occurrence of an interval (by doc_id,
then place) stays, lines of the others are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figura.llm.common import dense_rank, drop_staged, stage

_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _numbered(text: Column) -> Column:
    """Non-blank lines as structs (i: line number, line)."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("line"))),
                    lambda x: x["line"].rlike(_WORD))


def line_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, o, words, h1, h2): document key, ordinal among its non-blank lines,
    words, and a 96-bit line ID (two hashes)."""
    t = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h")).alias("d"),
                    F.posexplode(_numbered(F.col(text))).alias("o", "x"))
    line = F.col("x.line")
    return t.select("d", "o", F.regexp_count(line, F.lit(_WORD)).alias("words"),
                    F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def _ranked(positions: DataFrame, key: list[str]) -> DataFrame:
    """Positions whose key occurs twice or more, with the key's ordinal as
    ``rank``. Counts are combined on the map side, so a key on a third of the
    rows is no hot task; the join back leaves it to skew splitting."""
    classes = positions.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return positions.join(dense_rank(classes, key, "rank"), key).drop(*key)


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """(d, s, n): minimal windows of consecutive repeated lines with at least
    ``min_words`` words, forward from each line and backward from each line."""
    by_doc = Window.partitionBy("d").orderBy("o")
    t = (active.select("d", "o", "words")
         .withColumn("island", F.col("o") - F.row_number().over(by_doc))
         .withColumn("upto", F.sum("words").over(by_doc)))
    own = F.struct(F.col("o"), F.col("island"))
    # one sorted sweep a direction: ends and questions are points on the scale of running words
    ends = t.select("d", F.col("upto").alias("at"), F.lit(0).alias("ask"), own.alias("line"), F.lit(None).cast(t.select(own).schema[0].dataType).alias("from"))
    asks = t.select("d", (F.col("upto") - F.col("words") + min_words).alias("at"), F.lit(1).alias("ask"), F.lit(None).cast(t.select(own).schema[0].dataType).alias("line"), own.alias("from"))
    down = Window.partitionBy("d").orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = (ends.unionAll(asks).withColumn("end", F.min("line").over(down)).where("ask = 1")
           .select("d", F.col("from.o").alias("s"), F.col("from.island").alias("i"), F.col("end.o").alias("e"), F.col("end.island").alias("j")))
    begins = t.select("d", (F.col("upto") - F.col("words")).alias("at"), F.lit(0).alias("ask"), own.alias("line"), F.lit(None).cast(t.select(own).schema[0].dataType).alias("from"))
    asks = t.select("d", (F.col("upto") - min_words).alias("at"), F.lit(1).alias("ask"), F.lit(None).cast(t.select(own).schema[0].dataType).alias("line"), own.alias("from"))
    up = Window.partitionBy("d").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = (begins.unionAll(asks).withColumn("start", F.max("line").over(up)).where("ask = 1")
            .select("d", F.col("start.o").alias("s"), F.col("start.island").alias("i"), F.col("from.o").alias("e"), F.col("from.island").alias("j")))
    return (fwd.unionAll(back).where("i = j").select("d", "s", (F.col("e") - F.col("s") + 1).alias("n")).distinct())


def repeated_runs(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, runs): for each document with lines to delete, the sorted maximal
    runs as structs (s, e): ordinals s..e-1 of its non-blank lines."""
    lines = line_ids(docs, doc_id, text)
    # rows that agree in id and text are one document
    active = stage(_ranked(lines, ["h1", "h2"]).dropDuplicates(["d", "o"]), "active-lines")
    windows = stage(_windows(active, min_words), "line-windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    level, depth = active.select("d", "o", "rank"), 1
    ranks = [level.withColumn("depth", F.lit(1))]
    staged = [active, windows]
    while 2 * depth <= longest:
        ahead = Window.partitionBy("d").orderBy("o").rangeBetween(depth, depth)
        pairs = (level.withColumnRenamed("rank", "left").withColumn("right", F.max("left").over(ahead))
                 .where("right IS NOT NULL"))
        level = stage(_ranked(pairs, ["left", "right"]), "line-ranks")
        depth *= 2
        staged.append(level)
        ranks.append(level.withColumn("depth", F.lit(depth)))
    table = ranks[0]
    for r in ranks[1:]:
        table = table.unionByName(r)
    power = F.expr("cast(pow(2, floor(log2(n))) as int)")
    w = windows.withColumn("depth", power).withColumn("t", F.col("s") + F.col("n") - F.col("depth"))
    first = table.select("d", F.col("o").alias("s"), "depth", F.col("rank").alias("left"))
    second = table.select("d", F.col("o").alias("t"), "depth", F.col("rank").alias("right"))
    named = stage(w.join(first, ["d", "s", "depth"]).join(second, ["d", "t", "depth"]).select("d", "s", "n", "left", "right"), "line-intervals")
    # written before the join, which then may split a hot interval's rows
    heads = stage(named.groupBy("n", "left", "right").agg(F.min(F.struct("d", "s")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1"), "line-heads")
    later = named.join(heads, ["n", "left", "right"]).where(F.struct("d", "s") != F.col("head")).select("d", "s", (F.col("s") + F.col("n")).alias("e"))
    before = Window.partitionBy("d").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("d").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (later.withColumn("open", F.max("e").over(before))
            .withColumn("run", F.sum(F.when(F.col("open") >= F.col("s"), 0).otherwise(1)).over(upto))
            .groupBy("d", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
            .groupBy("d").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs")))
    out = stage(runs, "line-runs")
    drop_staged(*staged, named, heads)
    return out


def delete_repeats(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text",
                   details: bool = False) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text;
    with ``details`` also n_lines, n_removed (non-blank lines) and n_runs.

    A blank line goes with the non-blank line before it. A text that loses all
    lines is empty, a null text stays null. The first copy is that with the
    smallest doc_id (null before all), then the smallest text hash and line.
    Rows that agree in doc_id and text get the same result; other columns pass
    through, whatever their names.
    """
    # the same plan at every size: texts are dealt once by document, the runs are the hashed side
    runs = repeated_runs(docs, min_words, doc_id, text).hint("shuffle_hash")
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    t = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), key.alias("d")).join(runs, "d", "left")
    t = t.select("row", "runs", _lines(F.col(f"row.{text}")).alias("all"),
                 F.transform(_numbered(F.col(f"row.{text}")), lambda x: x["i"]).alias("at"))
    n = F.size("all")
    cuts = F.transform("runs", lambda r: F.struct(
        F.get("at", r["s"]).alias("s"), F.coalesce(F.get("at", r["e"]), n).alias("e")))
    t = t.withColumn("cuts", cuts)
    m = F.size("cuts")
    kept = F.transform(F.sequence(F.lit(0), m), lambda j: F.slice(
        F.col("all"), F.coalesce(F.get("cuts", j - 1)["e"], F.lit(0)) + 1,
        F.coalesce(F.get("cuts", j)["s"], n) - F.coalesce(F.get("cuts", j - 1)["e"], F.lit(0))))
    clean = F.when(F.col("runs").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(F.flatten(kept), "\n"))
    out = [clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if details:
        out += [F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_lines"),
                F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["e"] - r["s"]), F.lit(0)).cast("long").alias("n_removed"),
                F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs")]
    return t.select(*out)
