"""Discourse context: nearest enclosing units, smallest context, nth
fragment, sentence lookup.

Documents are node tables ``(doc_id, pre, post, tag, ...)`` in document and
closing order (the markup scan emits them; see ``figura.sources.markup``).
"Nearest enclosing X" is a merge of targets and candidates in document order
with a stack of the open candidates (``figura.operators.structural``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.functions import text as T
from figura.operators import structural

# Fixed value: the context candidates in tie-break order (earlier wins).
CONTEXT_ORDER = ("paragraph", "utterance", "div_4", "div_3", "div_2", "div_1")


def nearest_ancestors(targets: DataFrame, candidates: DataFrame, kinds: list[str],
                      doc: str = "doc_id", pre: str = "pre", kind: str = "kind", value="pre") -> DataFrame:
    """For every target node, the ``value`` of its nearest ancestor of each
    kind (null when it has none), one column per kind.

    ``targets``: ``(doc, pre, post)``; ``candidates``: ``(doc, pre, post,
    kind, value...)``, one kind per candidate node; ``value`` is a column or
    its name.
    """
    value = F.col(value) if isinstance(value, str) else value
    return structural.nearest(targets, candidates, kinds, value, doc, pre, kind=kind)


def context_candidates(nodes: DataFrame) -> DataFrame:
    """Context-bearing elements of a node table with their kind: ``p``,
    ``u`` and ``div_<level>`` for divs with a level attribute."""
    level = F.col("attrs").getItem("level")
    kind = (F.when(F.col("tag") == "p", F.lit("p")).when(F.col("tag") == "u", F.lit("u"))
            .when((F.col("tag") == "div") & level.isNotNull(), F.concat(F.lit("div_"), level)))
    return nodes.select("doc_id", "pre", "post", kind.alias("kind")).where(F.col("kind").isNotNull())


def smallest_context(candidates: list[tuple[str, Column]]) -> Column:
    """Among non-null candidate texts, the one with the shortest stripped
    text; ties keep the earlier candidate. Returns ``struct(len, prio,
    kind, text)`` with the stripped (not yet normalised) text."""
    items = []
    for prio, (kind, c) in enumerate(candidates):
        s = T.strip(c)
        items.append(F.struct(F.length(s).alias("len"), F.lit(prio).alias("prio"),
                              F.lit(kind).alias("kind"), s.alias("text")))
    return F.array_min(F.filter(F.array(*items), lambda x: x["len"].isNotNull()))


def with_min_context(df: DataFrame, sentence: str = "sentence_text",
                     order=CONTEXT_ORDER) -> DataFrame:
    """Add ``min_context`` (normalised), ``min_kind`` and the 0-based span
    of the normalised sentence inside it."""
    best = smallest_context([(k, F.col(k)) for k in order])
    out = (df.withColumn("_best", best)
           .withColumn("min_context", T.normalize_whitespace(F.col("_best.text")))
           .withColumn("min_kind", F.col("_best.kind")).drop("_best"))
    span = T.char_span(F.col("min_context"), T.normalize_whitespace(F.col(sentence)))
    return (out.withColumn("sentence_start_idx", span["start"])
            .withColumn("sentence_end_idx", span["end"]))


def fragment_ordinals(divs: DataFrame, doc: str = "doc_id", pre: str = "pre",
                      level: str = "level") -> DataFrame:
    """Number the fragments of each document 1, 2, ... in document order:
    level-1 divs, or every div when a document has no level-1 div.

    No window spans a whole document: whether a document has level-1 divs
    is a grouped flag (partial aggregation), and the ordinal is a two-level
    running count (``running_total`` over chunks of ``pre``)."""
    from figura.operators.text_ops import running_total
    flags = divs.groupBy(doc).agg(F.max((F.col(level) == "1").cast("int")).alias("_has_l1"))
    frags = (divs.join(flags, doc)
             .where((F.coalesce(F.col("_has_l1"), F.lit(0)) == 0) | (F.col(level) == "1"))
             .drop("_has_l1").withColumn("_one", F.lit(1)))
    return running_total(frags, [doc], pre, "_one", "fragment_n") \
        .withColumn("fragment_n", F.col("fragment_n").cast("int")).drop("_one")


def first_sentence(sentences: DataFrame, keys: list[str], pre: str = "pre") -> DataFrame:
    """One sentence per key: the first in document order (``find``)."""
    cols = [c for c in sentences.columns if c not in keys and c != pre]
    return sentences.groupBy(*keys).agg(
        F.min(F.struct(pre, *cols)).alias("_s")).select(
            *keys, *[F.col(f"_s.{c}").alias(c) for c in [pre, *cols]])


def lookup_sentences(examples: DataFrame, sentences: DataFrame,
                     keys=("text_segment_id", "sentence_number")) -> DataFrame:
    """Attach each example's sentence (first match per key)."""
    return examples.join(first_sentence(sentences, list(keys)), list(keys), "left")
