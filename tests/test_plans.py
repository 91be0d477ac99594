"""Feature extraction and classification jobs on stand-in examples
(labelled documents of sf0.01)."""

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from figura.operators import encode
from figura.plans import classify, extract
from figura.plans.q_features import _roles
from figura.plans.tables import vocabulary
from figura.session import shared_path
from figura.operators.features import read_feature_store

SF = "/root/testdata/sf0.01"


def _examples(spark):
    r = _roles(spark, SF)
    return r.select("id", "y", "partition", "genre", F.col("text").alias("min_context"),
                    F.col("v").alias("verb_lemma"), F.col("s").alias("subject"), F.col("o").alias("object"))


def test_extract_and_classify(spark):
    ex = _examples(spark)
    facts, contexts = extract.extract_with_vocabulary(ex, vocabulary(spark, SF))
    path = shared_path(spark, "store-test")
    extract.write_store(facts, contexts, path)
    f2, c2 = read_feature_store(spark, path)
    assert f2.count() == ex.count() and c2.count() == ex.select("min_context").distinct().count()
    widths = f2.join(c2, "ctx_id").select(F.size("v_emb") + F.size("s_emb") + F.size("o_emb")
                                          + F.size("ctx_emb")).distinct().collect()
    assert [w[0] for w in widths] == [256]
    clf = GBTClassifier(maxDepth=2, maxIter=3, seed=0)
    export = shared_path(spark, "dev-test")
    metrics, sig, dev = classify.classify(f2, c2, n_dev=40, seed=0, classifier=clf, digits=6,
                                          examples=ex.drop("min_context"), export=export)
    m = metrics.collect()
    assert {r.model for r in m} == {"l", "la", "lac"}
    assert {r.n_features for r in m} == {64, 192, 256}
    assert all(0.0 <= r.f1 <= 1.0 for r in m)
    s = {(r.model_a, r.model_b): r for r in sig.collect()}
    assert set(s) == {("l", "la"), ("la", "lac")} and all(0.0 <= r.midp <= 1.0 for r in s.values())
    assert dev.columns == ["id", "genre", "y", "y_pred_l", "y_pred_la", "y_pred_lac", "partition",
                           "verb_lemma", "subject", "object"]
    assert dev.count() == 40 and spark.read.option("header", True).csv(export).count() == 40


def test_encoder_features_blank_roles(spark):
    ex = _examples(spark)
    facts, contexts = extract.extract_with_encoder(ex, encode.hashing_encoder_factory(16), 16)
    rows = facts.join(ex.select("id", "subject"), "id").collect()
    assert all((r.subject == "") == (sum(abs(x) for x in r.s_emb) == 0.0) for r in rows)
    assert contexts.count() == ex.select("min_context").distinct().count()


def test_encoder_is_a_mean_of_signed_hashes():
    import hashlib
    got = encode.HashingEncoder(7)(["b a B", "", " \n", "x"])
    want = [[0.0] * 7 for _ in range(4)]
    for i, words in ((0, ["b", "a", "b"]), (3, ["x"])):
        for w in words:
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[i][h % 7] += (1 if h >> 31 else -1) / len(words)
    assert abs(got - want).max() < 1e-6
    assert encode.HashingEncoder(7)([]).shape == (0, 7)
