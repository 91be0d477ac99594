"""Corpus assembly operators: ids, label and lemma joins, train/test union,
genre mapping, rejects, final projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.functions import ids, text

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
# Corpus text-type code -> genre; any other code is 'unknown'.
GENRE_MAP = {
    "ACPROSE": "academic",
    "NEWS": "news",
    "FICTION": "fiction",
    "CONVRSN": "conversation",
}
UNKNOWN_GENRE = "unknown"
# Sentence numbers that exist in the annotated corpus but not in the source
# corpus, and the source sentence to use instead.
SENTENCE_QUIRKS = {"675a": "675"}
# ---------------------------------------------------------------------------


def genre_of(code) -> Column:
    """Map a text-type code to a genre, ``'unknown'`` by default."""
    code = F.col(code) if isinstance(code, str) else code
    m = F.create_map(*[F.lit(x) for kv in GENRE_MAP.items() for x in kv])
    return F.coalesce(F.element_at(m, code), F.lit(UNKNOWN_GENRE))


def source_sentence_number(c) -> Column:
    """Sentence number to look up in the source corpus (quirk remap)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in SENTENCE_QUIRKS.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def ordered_text(df: DataFrame, keys: list[str], order_col: str, text_col: str,
                 sep: str = " ", name: str = "text") -> DataFrame:
    """Concatenate the texts of each group in ``order_col`` order.

    The output row *is* the group's full text, so the group is bounded by
    the size of one document; the sort happens on the collected pairs,
    never on ``collect_list`` order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                 F.col(text_col).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["t"]), sep).alias(name))


def _with_segment(df: DataFrame) -> DataFrame:
    return (df.withColumn("bnc_file", ids.segment_part("text_segment_id"))
            .withColumn("bnc_file_n", ids.segment_fragment("text_segment_id")))


def parse_train_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Train-form ids -> typed columns + corpus part and fragment number."""
    return _with_segment(df.select("*", *ids.split_id(id_col, ids.TRAIN_ID_FIELDS)))


def parse_test_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Test-form ids: slot 3 is the word offset; sentence and subword
    offsets become 0 and the verb is filled in later from the sentence."""
    parsed = df.select("*", *ids.split_id(id_col, ids.TEST_ID_FIELDS))
    parsed = (parsed.withColumn("word_offset", F.col("sentence_offset"))
              .withColumn("sentence_offset", F.lit(0))
              .withColumn("subword_offset", F.lit(0))
              .withColumn("verb", F.lit(None).cast("string")))
    return _with_segment(parsed)


def segment_rejects(df: DataFrame, col: str = "text_segment_id") -> DataFrame:
    """Rows whose segment id is malformed, with a reason column."""
    parts = F.split(F.col(col), "-")
    reason = (F.when(F.size(parts) != 2, F.lit("parts"))
              .when(F.length(F.get(parts, 0)) != ids.PART_LENGTH, F.lit("part_length"))
              .otherwise(F.lit("fragment_prefix")))
    return df.where(~ids.segment_valid(col)).withColumn("reason", reason)


def join_labels(index: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    """Inner join of an index with gold labels (duplicate ids multiply)."""
    return index.join(labels, on, "inner")


def join_lemmas(examples: DataFrame, *lemma_sources: DataFrame, on: str = "id") -> DataFrame:
    """Union the lemma sources, then inner-join: examples without a lemma
    are dropped."""
    lemmas = lemma_sources[0]
    for other in lemma_sources[1:]:
        lemmas = lemmas.unionByName(other)
    return examples.join(lemmas, on, "inner")


def union_examples(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side are null."""
    return train.unionByName(test, allowMissingColumns=True)


def finalize_examples(df: DataFrame) -> DataFrame:
    """Drop the intermediate context levels and rebuild ``sentence`` from
    the raw tokens."""
    drop = [c for c in ("div_1", "div_2", "div_3", "div_4", "paragraph", "utterance", "sentence")
            if c in df.columns]
    out = df.drop(*drop)
    if "raw_sentence" in out.columns:
        out = out.withColumn("sentence", text.join_tokens("raw_sentence")).drop("raw_sentence")
    return out
