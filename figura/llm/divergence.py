"""Divergence between the sources of one language, in exact integers.

A document is an exact sparse vector of term counts. As ``CountVectorizer``
with minDF and the largest vocabSize would, each language keeps every term
that is in enough of its documents; vectors are summed by (lang, source), and
pairs of sources are compared on the terms that occur in either.

``CountVectorizer`` itself collects its vocabulary on the driver, broadcasts it
and handles a string object per token. Here the vocabulary stays a table: tasks
add up their documents' vectors by group (counts, and documents that have the
term), Spark merges these sums by term, and minDF is applied to the merged
ones. Nothing that grows with the data passes through the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figura.llm.common import drop_staged, stage, tasks

WORD = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1000          # three steps of long division by it make the factor 10^9
_HELD = 600_000       # entries of summed vectors a task holds
_DOC = 1 << 40        # a document, above the occurrences in a sum


def group_vectors(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, c, df): for every group its terms, their
    occurrences and the documents that have them, and a row with a null term
    that says the group is there.

    Terms are the runs of letters of whole texts (``WORD``), only A-Z
    lower-cased; null lang, source or text is ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[str, int]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, s), terms in sums.items():
                n = np.fromiter(terms.values(), np.int64, len(terms))
                cols = [pa.array([*terms, None], pa.string()), pa.array(np.append(n % _DOC, 0)), pa.array(np.append(n // _DOC, 0))]
                yield pa.RecordBatch.from_arrays([pa.array([x] * (len(terms) + 1), pa.string()) for x in (g, s)] + cols,
                                                 names=["lang", "source", "term", "c", "df"])
            sums.clear()
        held = 0
        for b in batches:
            for g, s, t in zip(*b.columns, strict=True):
                terms = sums.setdefault((g.as_py(), s.as_py()), {})
                before = len(terms)
                for w, n in Counter(WORD.findall(t.as_py().encode().lower().decode())).items():
                    terms[w] = terms.get(w, 0) + n + _DOC
                held += len(terms) - before
                if held >= _HELD:
                    yield from out()
                    held = 0
        yield from out()

    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    got = docs.select(*cols).mapInArrow(run, "lang string, source string, term string, c bigint, df bigint")
    return got.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def kept_counts(vectors: DataFrame, min_df: int) -> DataFrame:
    """(lang, source, term, c) of the terms that are in ``min_df`` documents
    of their language at least."""
    kept = (vectors.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("df").alias("df"))
            .where(F.col("df") >= min_df).select("lang", "term"))
    return vectors.where("term IS NOT NULL").select("lang", "source", "term", "c").join(kept, ["lang", "term"])


def share(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (c + 2) / (n + 2 v)) by long division in three steps:
    exact while n + 2 v is under 9 * 10^15. ``v`` is 1 at least."""
    whole = n + 2 * v
    step = lambda a: F.call_function("div", a * SCALE, whole)
    rest = lambda a: (a * SCALE) % whole
    a = c + 2
    b, d = rest(a), rest(rest(a))
    return (step(a) * SCALE + step(b)) * SCALE + step(d) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(c: np.ndarray, whole: np.ndarray) -> np.ndarray:
    rest, total = c + 2, np.zeros_like(c)
    for _ in range(3):
        total = total * SCALE + rest * SCALE // whole
        rest = rest * SCALE % whole
    return total + 1


_PAIRS = "lang string, s1 string, s2 string, f bigint, terms bigint"


def _block_pairs(t: pd.DataFrame) -> pd.DataFrame:
    """Sums over one block of terms, for the pairs of two blocks of sources.
    Rows without a term tell that a source is there."""
    names, s = np.unique(t["source"].to_numpy(object), return_inverse=True)
    term, terms = pd.factorize(t["term"])
    whole, block = np.ones(len(names), np.int64), np.zeros(len(names), np.int64)
    whole[s], block[s] = t["n"] + 2 * t["v"], t["sb"]
    c = np.zeros((len(names), len(terms)), np.int64)
    real = term >= 0
    c[s[real], term[real]] = t["c"].to_numpy()[real]
    p = _shares(c, whole[:, None])
    a, b = t["ba"].iloc[0], t["bb"].iloc[0]
    out = []
    for i in np.flatnonzero(block == a):
        js = np.flatnonzero(block == b)
        js = js[js > i] if a == b else js
        d = p[i] - p[js]
        out += [(names[i], names[j], f) for j, f in zip(js, (d * d // (p[i] + p[js])).sum(axis=1), strict=True)]
    lang = t["lang"].iloc[0]
    return pd.DataFrame([(lang, min(x, y), max(x, y), f, len(terms)) for x, y, f in out], columns=["lang", "s1", "s2", "f", "terms"])


def pair_sums(counts: DataFrame, groups: DataFrame, source_block: int = 64, term_block: int = 4096) -> DataFrame:
    """(lang, s1, s2, f, terms): sums over the terms that occur near a pair,
    s1 < s2, and how many terms these are. Work is dealt by blocks of terms
    and pairs of blocks of sources; sums are taken inside a block."""
    blocks = groups.groupBy("lang").agg(F.floor((F.count(F.lit(1)) - 1) / source_block + 1).cast("int").alias("nb"),
                                        F.floor((F.max("v") - 1) / term_block + 1).cast("int").alias("tb"))
    g = (groups.where("v > 0").join(blocks, "lang")
         .withColumn("sb", F.pmod(F.xxhash64("source"), F.col("nb")).cast("int")))
    others = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    ends = [F.least("sb", "o").alias("ba"), F.greatest("sb", "o").alias("bb")]
    row = ["lang", "source", "n", "v", "sb", "nb"]
    real = (counts.join(g, ["lang", "source"])
            .select(*row, "term", "c", F.pmod(F.xxhash64("term"), F.col("tb")).cast("int").alias("t")))
    there = g.select(*row, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("c"),
                     F.explode(F.sequence(F.lit(0), F.col("tb") - 1)).alias("t"))
    dealt = real.unionByName(there).select("*", others).select("lang", "source", "n", "v", "sb", "term", "c", "t", *ends)
    keys = ["lang", "t", "ba", "bb"]
    return (dealt.repartition(tasks(counts.sparkSession), *keys).groupBy(*keys).applyInPandas(_block_pairs, _PAIRS)
            .groupBy("lang", "s1", "s2").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms")))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_df: int = 10, top: int = 10,
          source_block: int = 64, term_block: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has each other
    source of the language with the divergence summed over all kept terms;
    part ``term`` the ``top`` kept terms by which a group exceeds its language.

    Null lang, source or text is ''. A group without terms, or a language
    without kept terms, has its pairs too (value 0 where no term is kept).
    Rows given twice count twice; ties rank by item in UTF-8 order; an empty
    table gives no rows; columns besides the three named are not read.
    """
    vectors = stage(group_vectors(docs, lang, source, text), "divergence-vectors")
    counts = stage(kept_counts(vectors, min_df), "divergence-counts")
    langs = stage(counts.groupBy("lang", "term").agg(F.sum("c").alias("lc")), "divergence-langs")
    sizes = langs.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lc").alias("ln"))
    zero = F.lit(0).cast("long")
    groups = stage(
        vectors.where("term IS NULL").select("lang", "source")
        .join(counts.groupBy("lang", "source").agg(F.sum("c").alias("n")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", *[F.coalesce(x, zero).alias(x) for x in ("n", "v", "ln")]), "divergence-groups")
    drop_staged(vectors)

    sums = pair_sums(counts, groups, source_block, term_block)
    g, o = groups.alias("g"), groups.alias("o")
    v = F.greatest(F.col("g.v"), F.lit(1))
    nowhere = gap(share(zero, F.col("g.n"), v), share(zero, F.col("o.n"), v))    # a term that neither group has
    pairs = (g.join(o, (F.col("g.lang") == F.col("o.lang")) & (F.col("g.source") < F.col("o.source")))
             .join(sums, (F.col("g.lang") == sums["lang"]) & (F.col("g.source") == F.col("s1")) & (F.col("o.source") == F.col("s2")), "left")
             .select(F.col("g.lang").alias("lang"), F.col("g.source").alias("a"), F.col("o.source").alias("b"),
                     F.when(F.col("g.v") == 0, zero)
                     .otherwise(F.coalesce("f", zero) + (v - F.coalesce("terms", zero)) * nowhere).alias("value")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", "value", both).select("lang", F.col("x.source").alias("source"), F.lit("pair").alias("part"),
                                                      F.col("x.item").alias("item"), "value").withColumn("rank", F.row_number().over(order))

    p, q = share(F.col("c"), F.col("n"), F.col("v")), share(F.col("lc"), F.col("ln"), F.col("v"))
    term = (counts.join(groups, ["lang", "source"]).join(langs, ["lang", "term"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q"))
            .where("p > q").select("lang", "source", "part", "item", gap(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return pair.unionByName(term)
