"""Values beyond the sizes of the stand-in tables, and unknown partitions."""

import pytest
from pyspark.sql import functions as F

from figura.functions import ids
from figura.functions.stats import mcnemar_midp
from figura.operators import encode, evaluate
from figura.plans import classify, tables
from figura.sources import readers


def test_fragment_numbers_beyond_two_digits(spark):
    df = spark.range(0, 120).select(F.concat(F.lit("c1-fragment"), ids.two_digits("id")).alias("s"), "id")
    got = df.select("s", ids.segment_fragment("s").alias("n"), "id").collect()
    assert all(r.n == r.id for r in got) and len({r.s for r in got}) == 120
    assert got[7].s == "c1-fragment07" and got[103].s == "c1-fragment103"


@pytest.mark.parametrize("bad", ["valid", None])
def test_unknown_partitions_are_errors_or_reported(spark, bad):
    ex = spark.createDataFrame([(1, "train"), (2, "test"), (3, bad), (4, "train")], "id long, partition string")
    with pytest.raises(Exception, match="unknown partition"):
        classify.with_split(ex, 1).collect()
    split = tables.with_dev_split(ex, 1)
    assert {r.id for r in split.where("split IS NULL").collect()} == {3}
    assert evaluate.split_integrity(split).first().n_outside == 1
    known = ex.where("id <> 3")
    assert sorted(r.split for r in classify.with_split(known, 1).collect()) == ["dev", "test", "train"]


def test_long_fragment_is_whole(spark, tmp_path):
    body = "x" * 100_000
    (tmp_path / "a.xml").write_text(f'<c><text xml:id="t1">{body}</text><text xml:id="t2"/></c>')
    got = {r.fragment_id: r.content for r in readers.scan_fragments(spark, str(tmp_path)).collect()}
    assert body in got["t1"]


def test_midp_of_equal_counts_is_one(spark):
    df = spark.createDataFrame([(10**6, 10**6), (3 * 10**9, 3 * 10**9), (5, 5), (0, 0)], "b long, c long")
    assert [r[0] for r in df.select(mcnemar_midp("b", "c")).collect()] == [1.0] * 4


def test_encoders_of_one_factory_function_are_kept_apart():
    def factory(width):
        return lambda: encode.HashingEncoder(width)
    assert [encode._get_encoder(factory(w)).dim for w in (3, 5, 3)] == [3, 5, 3]
    assert encode._get_encoder(factory(3)) is encode._get_encoder(factory(3))


def test_keyed_files_in_both_layouts(spark, tmp_path):
    from figura.sources import readers
    for key in ("A1B", "A1C", "KDB"):
        for d in (tmp_path / "nested" / key[0] / key[:2], tmp_path / "flat" / f"key={key}"):
            d.mkdir(parents=True, exist_ok=True)
            (d / f"{key}.xml").write_text(f"<x>{key}\nmore</x>")
    keys = spark.createDataFrame([("A1B",), ("KDB",), ("ZZZ",), ("A1B",)], "k string")
    for root, layout in (("nested", readers.KEY_IN_FILE_NAME), ("flat", readers.KEY_IN_FOLDER)):
        got = readers.scan_keyed_files(spark, str(tmp_path / root), keys, "k", layout)
        assert sorted((r.key, r.content) for r in got.collect()) == [
            ("A1B", "<x>A1B\nmore</x>"), ("KDB", "<x>KDB\nmore</x>")]


def test_fragments_in_an_outer_text_with_headers(spark, tmp_path):
    from figura.sources import readers
    (tmp_path / "c.xml").write_text(
        '<TEI><teiHeader><textClass xml:id="hdr1">x</textClass></teiHeader><text><group>\n'
        '<text xml:id="a-fragment01"><body><p xml:id="p1">one</p></body></text>\n'
        '<text n="2" xml:id="b-fragment02"><textual xml:id="no">two</textual></text></group></text></TEI>')
    got = sorted(tuple(r) for r in readers.scan_fragments(spark, str(tmp_path / "c.xml")).collect())
    assert got == [
        ("a-fragment01", '<text xml:id="a-fragment01"><body><p xml:id="p1">one</p></body></text>'),
        ("b-fragment02", '<text n="2" xml:id="b-fragment02"><textual xml:id="no">two</textual></text>')]


def test_blank_roles(spark):
    """A blank is zeros for a zero role and a term like any other elsewhere."""
    from figura.operators import encode, features
    vocab = features.Vocabulary(spark.createDataFrame([("", [9.0]), ("run", [1.0])], "w string, x array<float>"),
                                "w", "x", 1)
    df = spark.createDataFrame([(1, "", ""), (2, "run", "nope"), (3, "", "run")], "id int, v string, s string")
    got = features.term_vectors(df, ["v", "s"], vocab, zero_roles=["s"])
    assert sorted((r.id, r.v, r.s, r.v_emb, r.s_emb) for r in got.collect()) == [
        (1, "", "", [9.0], [0.0]), (2, "run", "nope", [1.0], [0.0]), (3, "", "run", [9.0], [1.0])]

    def factory():
        return lambda texts: [[len(t) + 5.0] for t in texts]
    got = encode.attach_encodings(df, ["v", "s"], factory, 1, zero_roles=["s"])
    assert sorted((r.id, r.v_emb, r.s_emb) for r in got.collect()) == [
        (1, [5.0], [0.0]), (2, [8.0], [9.0]), (3, [5.0], [8.0])]


def test_token_offsets_of_long_and_empty_texts_without_shuffle(spark):
    import random
    import re
    from figura.operators.text_ops import token_offsets
    rnd = random.Random(5)
    texts = ["", " \n", None, "a", " a", "x" * 64] + [
        "".join(rnd.choice("ab é\n") for _ in range(n)) for n in (63, 64, 65, 500, 40_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = token_offsets(df, "k")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(k, i, m.group(), m.start()) for k, t in enumerate(texts) for i, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert sorted((r.k, r.pos, r.token, r.start) for r in out.collect()) == want


def test_context_dictionary_with_repeated_rows(spark):
    from figura.operators import features
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", "x"), ("a", "y")], "id string, min_context string")
    got = features.context_dictionary(df).orderBy("ctx_id").collect()
    assert [(r.ctx_id, r.min_context, r.first_seen, r.n_rows) for r in got] == [(0, "y", "a", 2), (1, "x", "b", 2)]


def test_word_vectors_count_every_word(spark, tmp_path):
    """A word met once counts; rows are those of the SQL."""
    import duckdb

    import __spark_entry__ as E
    docs = [(1, "zebra quilt once\nriver\nstone", "en"), (2, "zebra", "en"), (3, "", "en"), (4, None, "en"), (5, "the the of", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, str(i % 2)) for i, _, _ in docs], "doc_id long, quality string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [i + 1.0, 2.0]) for i in range(7)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cols = "id, ctx_dim, v_known, s_known, o_known, ctx_l2"
    got = sorted(tuple(r) for r in E.queries()["word2vec_features"](spark, str(tmp_path)).select(*cols.split(", ")).collect())
    assert [r[2] for r in got] == [True, True, False, False, True] and [r[5] > 0 for r in got] == [True, True, False, False, True]
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({E.oracle_sql()['word2vec_features']})").fetchall())


def test_midp_of_unequal_counts_at_any_size(spark):
    from fractions import Fraction
    from math import comb, erfc, exp, pi, sqrt

    from figura.functions.stats import half_binomial_midp, mcnemar_midp

    def exact(b, c):
        n, x = b + c, min(b, c)
        total = sum(comb(n, k) for k in range(x + 1))
        return float(Fraction(2 * total - comb(n, x), 2 ** n))

    def series(b, c):
        """A normal curve with the first corrections: the rest is below 1 / n^2."""
        n, x = b + c, min(b, c)
        z = (2 * x - n) / sqrt(n)
        phi = exp(-z * z / 2) / sqrt(2 * pi)
        return 2 * (erfc(-z / sqrt(2)) / 2 + phi * (z ** 3 - 7 * z) / (12 * n))

    small = [(0, 1), (1, 0), (0, 7), (1, 2), (2, 1), (3, 9), (5, 40), (7, 8), (14, 17), (15, 16), (16, 17), (20, 60), (100, 131), (999, 1001), (0, 900), (400, 2000), (3000, 3001)]
    df = spark.createDataFrame(small, "b long, c long")
    for (b, c), r in zip(small, df.select(mcnemar_midp("b", "c")).collect(), strict=True):
        assert abs(r[0] - exact(b, c)) < 1e-9, (b, c, r[0], exact(b, c))
    big = [(10**6, 10**6 + 1), (5 * 10**6, 5 * 10**6 + 900), (3 * 10**9, 3 * 10**9 + 1), (3 * 10**9, 3 * 10**9 + 200_000), (10**12, 10**12 + 1),
           (10**12, 10**12 + 10**6), (10**12, 10**12 + 5 * 10**6), (10**12, 2 * 10**12)]
    got = [r[0] for r in spark.createDataFrame(big, "b long, c long").select(mcnemar_midp("b", "c")).collect()]
    for (b, c), g in zip(big, got, strict=True):
        assert abs(g - series(b, c)) < 2e-9, (b, c, g, series(b, c))
    assert abs(got[0] - 0.99943581077) < 1e-10
    same = spark.createDataFrame([(k, 2 * k) for k in (1, 2, 3, 10, 16, 1000, 10**6, 10**9, 10**12)], "x long, n long")
    assert all(abs(r[0] - 1) < 1e-9 for r in same.select(half_binomial_midp(F.col("x"), F.col("n"))).collect())
