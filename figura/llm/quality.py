"""Host-level quality rules with an empirical beta prior.

Documents are measured one by one; rule failures are summed by host; each
host's failure rate per rule is shrunk towards the rate of all hosts by a
beta prior fitted to the hosts (method of moments); hosts whose shrunk rate is
credibly above a limit reject all their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import stage

SYMBOLS = "#*$%&|<>"
_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("base", "symbols", "dup_lines")


def _names(v: np.ndarray) -> np.ndarray:
    """Equal values get equal small integers."""
    return np.unique(v, return_inverse=True)[1].astype(np.int64)


def repeated_window_words(words: list[bytes], size: int = 5) -> int:
    """Words lying in a ``size``-word window that occurs twice or more.

    Windows are named exactly: word ids are paired into names of 2, 4, ...
    words and the last pair overlaps, so no hash is involved.
    """
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    have = 1
    while have < size:
        step = min(have, size - have)
        left, right = name[:len(name) - step], name[step:]
        name = _names(left * (int(name.max()) + 1) + right)
        have += step
        if int(name.max()) + 1 == len(name):
            return 0
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``. None has no words."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in _SEPARATORS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SEPARATORS)]
    return (len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_window_words(words))


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, the counts, base_failed) of every row.

    A null or blank host is the host ``''``. Null or empty text counts zero
    everywhere and fails the base rule. Rows are measured one by one, so
    repeated rows give repeated results; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t.as_py()) for t in b.column(2)]
            cols = list(zip(*got, strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]],
                names=["doc_id", "host", *COUNTS])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.trim(F.col(host).cast("string")), F.lit("")).alias("host"),
                       F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.withColumn("base_failed", base_failed())


def base_failed():
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def host_verdicts(counts: DataFrame, max_rate: float = 0.5, z: float = 1.645, symbol_rate: float = 0.1,
                  dup_line_rate: float = 0.3, max_strength: float = 1000.0) -> DataFrame:
    """One row per host: n_docs, failures and shrunk rate of each rule, host_bad.

    Rules of a document: ``base`` (base_failed), ``symbols`` (more symbols
    than ``symbol_rate`` per word), ``dup_lines`` (share of repeated lines
    above ``dup_line_rate``). The prior Beta(a, b) of a rule has the mean and
    variance of the hosts' rates; a host is bad if, for any rule, the shrunk
    rate less ``z`` posterior standard deviations is above ``max_rate``.
    Sums are combined on the map side, so a host with most rows is no hot task;
    only the prior's moments (two numbers a rule) reach the driver.
    """
    fails = {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") > F.col("n_words") * symbol_rate,
        "dup_lines": F.col("n_dup_lines") > F.col("n_lines") * dup_line_rate,
    }
    hosts = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(fails[r].cast("long")).alias(f"f_{r}") for r in RULES])
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    prior = hosts.agg(*[e for r in RULES for e in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}"))]).first()
    t, bad = hosts, F.lit(False)
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        s = min(max(m * (1 - m) / v - 1, 1.0), max_strength) if v > 0 else max_strength
        p = F.col(f"rate_{r}")
        t = t.withColumn(f"rate_{r}", (F.col(f"f_{r}") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)))
        bad = bad | (p - z * F.sqrt(p * (1 - p) / (F.col("n_docs") + F.lit(s) + 1)) > max_rate)
    return t.withColumn("host_bad", bad).select(
        "host", "n_docs", *[f"f_{r}" for r in RULES], *[f"rate_{r}" for r in RULES], "host_bad")


def host_rules(docs: DataFrame, **columns: str) -> DataFrame:
    """Counts of every document with its host's verdict: ``kept`` is false if
    the base rule failed or the host is bad. One row per row of ``docs``."""
    counts = stage(document_counts(docs, **columns), "quality-counts")
    hosts = host_verdicts(counts).select("host", "host_bad")
    return (counts.join(hosts, "host", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_bad", F.lit(False))))


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without rejected documents; columns unchanged, whatever their
    names. Null or empty texts have no words and are rejected; rows that
    repeat are judged each; an empty table stays empty.

    Each text is measured once: rows that pass the base rule are written with
    their counts, the others with counts alone, and bad hosts are taken out by
    an anti-join with the (host-sized) verdict table, so texts are not
    shuffled while that is small enough for the planner to broadcast.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    t = docs.select(row, F.coalesce(F.trim(F.col(host).cast("string")), F.lit("")).alias("host"), F.col(text).alias("text"))
    kind = t.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(x.as_py()) for x in b.column(2)]
            cols = list(zip(*got, strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=["row", "host", *COUNTS])

    measured = t.mapInArrow(run, f"row {kind}, host string, " + ", ".join(f"{c} bigint" for c in COUNTS)).withColumn("base_failed", base_failed())
    measured = stage(measured.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))), "quality-rows")
    bad = stage(host_verdicts(measured).where("host_bad").select("host"), "quality-hosts")
    kept = measured.where(~F.col("base_failed")).join(bad, "host", "left_anti")
    return kept.select([F.col("row")[c].alias(c) for c in docs.columns])
