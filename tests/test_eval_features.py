"""Metrics, significance, sampling, dense ordinals, vectors, formats and
the driver contract."""

import math

import pytest
from pyspark.sql import functions as F

from figura.functions.stats import mcnemar_midp
from figura.functions.vectors import blank_to_zero, first_token, last_layer, reshape3
from figura.operators import analysis, evaluate, features
from figura.operators.sampling import dense_index, sample_per_group, seeded_sample
from figura.sources import readers
from figura.session import shared_path

# FIXTURES.md: exact mid-p values from integer binomials
MIDP = [(0, 0, 1.0), (5, 5, 1.0), (7, 0, 0.0078125), (3, 10, 0.057373046875),
        (100, 140, 0.009831541179), (900, 1000, 0.021791499254)]


def test_mcnemar_midp_values(spark):
    df = spark.createDataFrame([(b, c) for b, c, _ in MIDP], "b long, c long")
    got = [r[0] for r in df.select(mcnemar_midp("b", "c")).collect()]
    for g, (_, _, want) in zip(got, MIDP):
        assert math.isclose(g, want, rel_tol=1e-9, abs_tol=1e-12)


def _preds(spark, rows):
    return spark.createDataFrame(rows, "id int, model string, genre string, y int, pred int")


def test_metrics_edge_cases(spark):
    rows = [(1, "m", "a", 1, 0), (2, "m", "a", 0, 0), (3, "m", "b", 0, 0), (4, "m", "b", 1, 1)]
    m = {(r.model, r.genre): r for r in evaluate.prf_by_group(_preds(spark, rows)).collect()}
    a = m[("m", "a")]          # no predicted positives: precision 0, f1 0
    assert (a.precision, a.recall, a.f1, a.accuracy, a.n) == (0.0, 0.0, 0.0, 0.5, 2)
    b = m[("m", "b")]
    assert (b.precision, b.recall, b.f1, b.accuracy) == (1.0, 1.0, 1.0, 1.0)
    o = m[("m", "overall")]
    assert (o.precision, o.recall, round(o.f1, 6), o.accuracy, o.n) == (1.0, 0.5, 0.666667, 0.75, 4)


def test_discordant_counts(spark):
    rows = [(1, "a", "g", 1, 1), (1, "b", "g", 1, 0), (2, "a", "g", 0, 1), (2, "b", "g", 0, 0),
            (3, "a", "g", 1, 1), (3, "b", "g", 1, 1)]
    r = evaluate.significance(_preds(spark, rows), [("a", "b")]).first()
    assert (r.model_a, r.model_b, r.b, r.c) == ("a", "b", 1, 1) and r.midp == 1.0


def test_class_weight_and_split_integrity(spark):
    df = spark.createDataFrame([(1, 1, "train"), (2, 0, "train"), (3, 0, "train"), (3, 0, "dev"),
                                (4, 1, "other")], "id int, y int, split string")
    w = evaluate.class_weight(df.where(F.col("split") == "train")).first()
    assert (w.n_pos, w.n_neg, w.pos_weight) == (1, 2, 2.0)
    i = evaluate.split_integrity(df).first()
    assert (i.n_rows, i.n_outside, i.n_overlap) == (5, 1, 1)


def test_seeded_sample_is_partitioning_invariant(spark):
    df = spark.range(500).withColumnRenamed("id", "id")
    a = sorted(r.id for r in seeded_sample(df.repartition(1), 37, seed=3).collect())
    b = sorted(r.id for r in seeded_sample(df.repartition(17), 37, seed=3).collect())
    c = sorted(r.id for r in seeded_sample(df, 37, seed=4).collect())
    assert a == b and len(a) == 37 and a != c


def test_sample_per_group_matches_brute_force(spark):
    # one group holds most rows (skew); compare with a plain window
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") < 1500, "hot")
                                  .otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"))
    got = sample_per_group(df, ["g"], 9, seed=1)
    from pyspark.sql import Window
    key = F.md5(F.concat(F.lit("1:"), F.col("id").cast("string")))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(key, "id"))) \
        .where(F.col("rank") <= 9)
    assert sorted(map(tuple, got.select("g", "id", "rank").collect())) == \
        sorted(map(tuple, want.select("g", "id", "rank").collect()))


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    got = dense_index(df, ["k"], name="i", start=1, partitions=5).collect()
    assert sorted((r.k, r.i) for r in got) == [(k, k + 1) for k in range(1000)]
    # partition count left to AQE
    big = spark.range(30000).select(((F.col("id") * 7919) % 30000).alias("k")).repartition(13)
    got = dense_index(big, ["k"], name="i").collect()
    assert sorted((r.k, r.i) for r in got) == [(k, k) for k in range(30000)]


def test_vector_helpers(spark):
    df = spark.createDataFrame([("", [1.0, 2.0]), ("x", None), ("y", [3.0, 4.0])], "t string, v array<float>")
    got = [r[0] for r in df.select(blank_to_zero("t", "v", 2)).collect()]
    assert got == [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]]
    e = spark.createDataFrame([([float(i) for i in range(24)],)], "v array<float>")
    layers = e.select(reshape3("v", 3, 2, 4).alias("l"))
    assert layers.select(first_token(F.array(last_layer("l")))).first()[0] == [16.0, 17.0, 18.0, 19.0]


def test_mean_pool_counts_unknown_tokens(spark):
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0])], "w string, v array<float>")
    vocab = features.Vocabulary(vec, "w", "v", 2)
    toks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz"), (2, "a"), (2, "a")], "d int, tok string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "d int")
    got = {r.d: r.ctx_emb for r in features.mean_pool(toks, "d", "tok", vocab, docs=docs, dtype="float64")
           .collect()}
    assert got[1] == pytest.approx([4 / 3, 8 / 3]) and got[2] == [1.0, 2.0] and got[3] == [0.0, 0.0]


def test_term_vectors_blank_and_unknown(spark):
    vec = spark.createDataFrame([("go", [1.0])], "w string, v array<float>")
    vocab = features.Vocabulary(vec, "w", "v", 1)
    df = spark.createDataFrame([(1, "go", "", "nope")], "id int, v string, s string, o string")
    r = features.term_vectors(df, ["v", "s", "o"], vocab).first()
    assert (r.v_emb, r.s_emb, r.o_emb) == ([1.0], [0.0], [0.0])


def test_context_dictionary_first_seen(spark):
    df = spark.createDataFrame([(5, "b"), (1, "a"), (3, "b"), (9, "c"), (2, "a")], "id int, min_context string")
    d = {r.min_context: (r.ctx_id, r.first_seen, r.n_rows) for r in features.context_dictionary(df).collect()}
    assert d == {"a": (0, 1, 2), "b": (1, 3, 2), "c": (2, 9, 1)}


def test_error_sample_counts_and_reasoning_golden(spark):
    # golden counts of the reasoning-type relation (fixed values: the hand
    # annotations' id lists per type)
    explicit = [20, 27, 150, 163, 234, 239, 256, 282, 352, 476, 485]
    implicit = [185, 300, 343, 415, 493]
    err = [249, 250, 310, 311]
    beyondplus = [261, 268, 299, 313, 320, 324, 332, 348, 353, 357, 359]
    rel = spark.createDataFrame([(i, t) for t, ids in [("explicit", explicit), ("implicit", implicit),
                                                      ("err", err), ("beyondplus", beyondplus)] for i in ids],
                                "id int, ctx_type string")
    got = {r.ctx_type: r["count"] for r in analysis.group_counts(rel, ["ctx_type"]).collect()}
    assert got == {"explicit": 11, "beyondplus": 11, "implicit": 5, "err": 4}
    wide = spark.createDataFrame([(1, 1, 0, 1, 1, "beyond"), (2, 0, 1, 1, 0, None), (3, 1, 1, 1, 0, "args")],
                                 "id int, y int, y_pred_l int, y_pred_la int, y_pred_lac int, ctx_label string")
    c = sorted((r.model, r.ctx_label or "-", r["count"]) for r in analysis.error_sample_counts(wide, 5).collect())
    assert c == [("l", "-", 1), ("l", "beyond", 1), ("la", "-", 1), ("lac", "args", 1)]


def test_csv_blanks_fixture(spark, tmp_path):
    p = tmp_path / "ex.csv"
    p.write_text('id,y,subject,object,sentence\n1,0,,NA,"He said ""hi"", ok"\n')
    schema = "id int, y int, subject string, object string, sentence string"
    r = readers.read_csv_keep_blanks(spark, str(p), schema).first()
    assert (r.subject, r.object, r.sentence) == ("", "NA", 'He said "hi", ok')
    n = readers.read_csv_default_na(spark, str(p), schema).first()
    assert (n.subject, n.object) == (None, None)
    q = tmp_path / "r.csv"
    q.write_text("id,y,subject,object,sentence\n1,0,null,NA,None\n")
    n = readers.read_csv_r(spark, str(q), schema).first()
    assert (n.subject, n.object, n.sentence) == ("null", None, "None")
    out = shared_path(spark, "csv-test")
    readers.write_csv(readers.read_csv_keep_blanks(spark, str(p), schema), out, single_file=True)
    assert readers.read_csv_keep_blanks(spark, out, schema).first() == r


def test_jsonl_lemmas(spark, tmp_path):
    p = tmp_path / "lem.jsonl"
    p.write_text('{"x": {"U-lemmaByPOS": "explain"}, "id": "b17-fragment02_171_1"}\n'
                 '{"x": {"U-lemmaByPOS": "cause"}, "id": "b17-fragment02_172_12"}\n')
    got = sorted(tuple(r) for r in readers.read_lemmas_jsonl(spark, str(p)).collect())
    assert got == [("cause", "b17-fragment02_172_12"), ("explain", "b17-fragment02_171_1")]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) >= {"model", "genre", "precision", "recall", "f1", "accuracy", "n", "n_features"}
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 45


def test_running_total_matches_window_on_skewed_key(spark):
    from pyspark.sql import Window

    from figura.operators.text_ops import running_total
    # key "hot" holds 3/4 of the rows and spans many chunks of 16 positions
    df = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("k"),
                                  (F.col("id") * 3).alias("pos"), (F.col("id") % 7).alias("amt"))
    got = running_total(df, ["k"], "pos", "amt", "run", chunk=16)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumn("run", F.sum("amt").over(w))
    assert sorted(map(tuple, got.select("k", "pos", "run").collect())) == \
        sorted(map(tuple, want.select("k", "pos", "run").collect()))
