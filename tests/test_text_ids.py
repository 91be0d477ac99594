"""Text functions, id parsing and validation (word normaliser, tokenizers,
spans, composite ids)."""

import pytest
from pyspark.sql import functions as F

from figura.functions import ids, text
from figura.operators import corpus
from figura.operators.text_ops import token_offsets


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_normalize_and_strip(spark):
    assert one(spark, "  a \t b\n\nc  ", text.normalize_whitespace("x")) == "a b c"
    assert one(spark, "  a  b 　", text.normalize_whitespace("x")) == "a b"
    assert one(spark, "  a  b \n", text.strip("x")) == "a  b"
    assert one(spark, "", text.normalize_whitespace("x")) == ""


def test_whitespace_tokens_empty_is_empty_list(spark):
    assert one(spark, "", text.whitespace_tokens("x")) == []
    assert one(spark, "  a b  ", text.whitespace_tokens("x")) == ["a", "b"]


def test_word_normaliser_fixture(spark):
    got = one(spark, "Hello, World42 it's a été _x y2k incomprehensibilities", text.word_tokens("x"))
    assert got == ["hello", "world", "it", "été"]


def test_infix_tokenizer(spark):
    got = one(spark, 'He said "hi", ok.', text.infix_tokens("x"))
    assert got == ["He", "said", '"', "hi", '"', ",", "ok", "."]
    assert one(spark, "a~b`c", text.infix_tokens("x")) == ["a", "~", "b", "`", "c"]


def test_char_span_first_occurrence(spark):
    df = spark.createDataFrame([("x ab y ab", "ab"), ("abc", "zz"), ("abc", "")], "c string, s string")
    got = [tuple(r) for r in df.select(text.char_span("c", "s").alias("sp")).select("sp.*").collect()]
    assert got == [(2, 4), (-1, 1), (0, 0)]


def test_token_offsets(spark):
    df = spark.createDataFrame([(1, "  ab c\n\td  ")], "k int, text string")
    got = [(r.pos, r.token, r.start) for r in token_offsets(df, "k").orderBy("pos").collect()]
    assert got == [(0, "ab", 2), (1, "c", 5), (2, "d", 8)]


def test_utf8_roundtrip(spark):
    assert one(spark, "héllo ☃", text.utf8_roundtrip("x")) == "héllo ☃"


def test_train_and_test_ids(spark):
    df = spark.createDataFrame([("b17-fragment02_171_3_4_0_Went",)], "id string")
    r = corpus.parse_train_ids(df).first()
    assert (r.text_segment_id, r.sentence_number, r.sentence_offset, r.word_offset,
            r.subword_offset, r.verb, r.bnc_file, r.bnc_file_n) == \
        ("b17-fragment02", "171", 3, 4, 0, "Went", "B17", 2)
    # real test-form rows: three parts, slot 3 is the word offset
    t = spark.createDataFrame([("b17-fragment02_171_1",), ("b17-fragment02_172_12",)], "id string")
    got = rows_of(corpus.parse_test_ids(t), "sentence_number", "word_offset", "sentence_offset", "verb")
    assert got == [("171", 1, 0, None), ("172", 12, 0, None)]


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_sentence_number_stays_string(spark):
    df = spark.createDataFrame([("a01-fragment01_675a_1",)], "id string")
    assert corpus.parse_test_ids(df).first().sentence_number == "675a"
    assert one(spark, "675a", corpus.source_sentence_number("x")) == "675"
    assert one(spark, "675", corpus.source_sentence_number("x")) == "675"


def test_segment_validation(spark):
    df = spark.createDataFrame([("b17-fragment02",), ("b1-fragment02",), ("b17-frag02",),
                                ("b17-fragment02-x",)], "s string")
    bad = rows_of(corpus.segment_rejects(df, "s"), "s", "reason")
    assert bad == [("b1-fragment02", "part_length"), ("b17-frag02", "fragment_prefix"),
                   ("b17-fragment02-x", "parts")]
    with pytest.raises(Exception):
        df.select(ids.assert_segment_valid("s")).collect()
    ok = spark.createDataFrame([("b17-fragment02",)], "s string")
    ok.select(ids.assert_segment_valid("s")).collect()


def test_genre_map(spark):
    df = spark.createDataFrame([("NEWS",), ("ACPROSE",), ("XYZ",), (None,)], "t string")
    assert [r[0] for r in df.select(corpus.genre_of("t")).collect()] == \
        ["news", "academic", "unknown", "unknown"]


def test_union_by_name_and_joins(spark):
    tr = spark.createDataFrame([("a", 1, "x")], "id string, y int, verb string")
    te = spark.createDataFrame([("b", 0)], "id string, y int").withColumn("partition", F.lit("test"))
    u = corpus.union_examples(tr, te)
    assert rows_of(u, "id", "verb", "partition") == [("a", "x", None), ("b", None, "test")]
    lem1 = spark.createDataFrame([("a", "go")], "id string, verb_lemma string")
    lem2 = spark.createDataFrame([("c", "be")], "id string, verb_lemma string")
    assert rows_of(corpus.join_lemmas(u, lem1, lem2), "id", "verb_lemma") == [("a", "go")]


@pytest.mark.parametrize("s", ["Hello, World42 it's", "_x y2k", "a incomprehensibilitiesxx bb", "", "É_té x"])
def test_first_word_equals_first_token(spark, s):
    df = spark.createDataFrame([(s,)], "x string")
    r = df.select(text.first_word("x").alias("a"), text.word_tokens("x").alias("b")).first()
    assert r.a == (r.b[0] if r.b else "")
