"""Blocked product, first occurrences, bottom-k samples, bucketed store,
arguments in the row, rejects counted on the way."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from figura.operators import arguments, features, occurrences, product, sampling


# ------------------------------------------------------------- product

def vectors(rng, n, dim):
    return {f"w{i}": [float(np.float32(x)) for x in rng.normal(size=dim)] for i in range(n)}


@pytest.mark.parametrize("block", [7, 10_000])
def test_blocked_product_equals_plain_sums(spark, block, monkeypatch):
    rng, dim = np.random.default_rng(1), 5
    table = vectors(rng, 60, dim)
    docs = [(i, [f"w{rng.integers(0, 80)}" for _ in range(rng.integers(0, 40))]) for i in range(50)]
    docs += [(50, None), (51, []), (52, [None, "w1", None]), (53, ["unknown"]), (7, docs[7][1]), (54, ["w2"] * 5000)]
    vdf = spark.createDataFrame([*table.items(), ("w_null", None), (None, [1.0] * dim)], "k string, v array<float>").repartition(4)
    ddf = spark.createDataFrame(docs, "id long, t array<string>").repartition(5)
    files = product.stage_blocks(vdf, "k", "v", block)
    assert len(files) >= (60 // 7 if block == 7 else 1)
    got = product.mean_vectors(ddf, "id", "t", files, dim, "m", "float64").collect()
    want = sorted((i, tuple(np.round(np.mean([table.get(t, [0.0] * dim) for t in ts], axis=0) if ts else np.zeros(dim), 9) + 0.0)) for i, ts in docs)
    assert sorted((r.id, tuple(np.round(r.m, 9) + 0.0)) for r in got) == want
    assert "Exchange" not in product.mean_vectors(ddf, "id", "t", files, dim, "m")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_weighted_rows_and_documents_without_tokens(spark):
    vdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 4.0])], "k long, v array<float>")
    vocab = features.Vocabulary(vdf, "k", "v", 2, key_fn=lambda t: t.cast("long"))
    toks = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("a", "9"), ("b", "9")], "d string, t string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    got = {r.d: r.ctx_emb for r in features.mean_pool(toks, "d", "t", vocab, docs=docs, dtype="float64").collect()}
    assert got == {"a": [0.5, 1.0], "b": [0.0, 0.0], "c": [0.0, 0.0]}
    arrays = spark.createDataFrame([("a", ["1", "1", "2", "9"]), ("b", ["9"]), ("c", None)], "d string, t array<string>")
    assert {r.d: r.ctx_emb for r in features.mean_pool_arrays(arrays, "d", F.col("t"), vocab, dtype="float64").collect()} == got
    empty = features.Vocabulary(vdf.where("k > 5"), "k", "v", 2, key_fn=lambda t: t.cast("long"))
    assert {tuple(r.ctx_emb) for r in features.mean_pool_arrays(arrays, "d", F.col("t"), empty).collect()} == {(0.0, 0.0)}


# ------------------------------------------------------------- occurrences

@settings(max_examples=300, deadline=None)
@given(st.text("abé \n", max_size=60), st.lists(st.text("abé ", max_size=6), max_size=8))
def test_first_places(text, sentences):
    got = occurrences.first_places(text, set(sentences))
    assert all(got.get(s, -1) == text.find(s) for s in sentences)


def test_first_occurrences_table(spark):
    ctx = spark.createDataFrame([(1, "a b c a b"), (2, None), (3, "xyz" * 1000 + "end")], "k long, text string")
    sent = [(1, 0, "a b"), (1, 1, "c a"), (1, 2, "zz"), (1, 3, None), (1, 4, ""), (2, 0, "a"), (3, 0, "end"), (3, 0, "end"), (9, 0, "a"), (None, 0, "a")]
    df = spark.createDataFrame(sent, "k long, line int, sentence string").repartition(3)
    got = sorted(tuple(r) for r in occurrences.first_occurrences(ctx, df, ["k"]).where("k IS NOT NULL").collect())
    assert [g for g in got if None not in g] == [(1, 0, 0, 3), (1, 1, 4, 7), (1, 2, -1, 1), (1, 4, 0, 0), (3, 0, 3000, 3003), (3, 0, 3000, 3003)]
    assert sorted(g[:2] for g in got if None in g) == [(1, 3), (2, 0), (9, 0)]


def test_many_lines_of_one_long_context_are_linear():
    import time
    lines = [f"line {i} of the text" for i in range(40_000)]
    text = "\n".join(lines)
    begin = time.monotonic()
    got = occurrences.first_places(text, set(lines))
    assert len(got) == len(lines) and time.monotonic() - begin < 10
    assert got[lines[777]] == text.find(lines[777])


# ------------------------------------------------------------- bottom-k

@pytest.mark.parametrize("digits", [1, 5])
def test_bottom_k_is_exact_with_a_hot_group(spark, digits):
    rows = [(i, "hot" if i % 3 else f"g{i % 50}") for i in range(4000)] + [(5000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, g string").withColumn("_k", sampling.sample_key("id", 3)).repartition(6)
    got = sampling.bottom_k(df, ["g"], "_k", 20, ["id"], digits=digits).collect()
    by = {}
    for r in df.collect():
        by.setdefault(r.g, []).append((r._k, r.id))
    want = {(g, i, n + 1) for g, rs in by.items() for n, (_, i) in enumerate(sorted(rs)[:20])}
    assert {(r.g, r.id, r["rank"]) for r in got} == want
    assert Counter(r.g for r in got)["hot"] == 20 and Counter(r.g for r in got)[None] == 5


def test_sample_per_group_sizes(spark):
    df = spark.range(1000).withColumn("m", (F.col("id") % 2).cast("string"))
    assert {r.m: r["count"] for r in sampling.sample_per_group(df, ["m"], 7, 1).groupBy("m").count().collect()} == {"0": 7, "1": 7}
    assert sampling.sample_per_group(df.where("id < 0"), ["m"], 7).isEmpty()


# ------------------------------------------------------------- store

def test_bucketed_gather_moves_nothing(spark, tmp_path):
    facts = spark.range(200).select("id", (F.col("id") % 17).alias("ctx_id"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("partition"))
    ctx = spark.range(17).select(F.col("id").alias("ctx_id"), F.array(F.col("id").cast("float")).alias("ctx_emb"))
    features.write_bucketed_store(facts, ctx, str(tmp_path / "store"), "bucket_test", 4)
    got = features.gather_from_store(spark, "bucket_test")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert sorted((r.id, r.ctx_id, r.ctx_emb[0], r.partition) for r in got.collect()) == [(i, i % 17, float(i % 17), "test" if i % 4 == 0 else "train") for i in range(200)]
    spark.sql("DROP TABLE bucket_test_features")
    spark.sql("DROP TABLE bucket_test_contexts")


# ------------------------------------------------------------- arguments

def test_arguments_in_row_follow_the_long_form(spark):
    rng = random.Random(8)
    t = "tokens array<struct<lemma:string>>, deps array<struct<dep:string,governor:int,governorGloss:string,dependent:int,dependentGloss:string>>"
    rows = []
    for i in range(120):
        n = rng.randint(1, 7)
        words = [rng.choice(["Bank", "money", "Ran", "in"]) for _ in range(n)]
        deps = [(rng.choice(["nsubj", "dobj", "case", "det"]), g := rng.randint(0, n), words[g - 1] if g else "ROOT", d, words[d - 1]) for d in range(1, n + 1)]
        rows.append((f"e{i}", rng.randint(0, n + 1), [(w.lower() + "_l",) for w in words], deps))
    rows += [("none", 1, None, None), ("empty", 1, [], []), ("null", None, [("a",)], [("nsubj", 1, "A", 1, "A")])]
    df = spark.createDataFrame(rows, f"id string, word_offset int, {t}")
    cols = ["subject", "object", "subject_lemma", "object_lemma"]
    got = {r.id: tuple(r[c] for c in cols) for r in df.select("id", *arguments.arguments_in_row()).collect()}
    long = arguments.extract_arguments(arguments.deps_long(df), ["id"], order="dep_pos", verbs=df.where("word_offset IS NOT NULL").select("id", "word_offset"))
    want = {r.id: tuple(r[c] for c in cols) for r in long.collect()} | {"null": ("",) * 4}
    assert got == want and len(set(got.values())) > 10


def test_all_arguments_follow_the_long_form(spark):
    rng = random.Random(18)
    kind = "array<struct<dep:string,governor:int,dependent:int,dependent_gloss:string,dependent_lemma:string,governor_gloss:string,governor_lemma:string>>"
    rows = []
    for i in range(80):
        n = rng.randint(0, 8)
        words = [rng.choice(["Bank", "money", "Ran", None]) for _ in range(n)]
        lem = lambda w: w and w.lower()
        rows.append((i % 40, i // 40, [(rng.choice(["nsubj", "dobj", "case", "det"]), g := rng.randint(0, n), d, words[d - 1], lem(words[d - 1]),
                                        words[g - 1] if g else "ROOT", lem(words[g - 1]) if g else "root") for d in range(1, n + 1)]))
    df = spark.createDataFrame([*rows, (99, 0, None)], f"conv_id long, turn int, deps {kind}")
    got = arguments.all_arguments(df, ["conv_id", "turn"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    long = df.select("conv_id", "turn", F.explode("deps").alias("d")).select("conv_id", "turn", "d.*")
    cols = ["conv_id", "turn", "word_offset", "subject", "object", "subject_lemma", "object_lemma"]
    want = arguments.extract_arguments(long, ["conv_id", "turn"]).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


# ------------------------------------------------------------- rejects

def test_every_reject_reason_is_counted(spark):
    from figura.plans.assemble import REJECTS, assemble_examples
    from figura.sources import markup
    ann = [("a1b-fragment01", '<text><s n="1"><w>He</w> <w>ran</w></s><s n="2"><w>No</w> <w>context</w></s></text>'),
           ("a1c-fragment01", '<text><s n="1"><w>He</w> <w>ran</w></s></text>')]
    src = [("A1B", '<x><wtext type="NEWS"><div level="1"><p><s n="1"><w>He </w><w>ran</w></s></p></div></wtext></x>'),
           ("A1C", '<x><wtext type="NEWS"><div level="1"><p><s n="1"><w>He </w><w>ran</w></s></p></div></wtext><stext/></x>')]
    node = lambda rows: markup.node_table(spark.createDataFrame(rows, "doc_id string, content string"))
    test = [("a1b-fragment01_1_2", "ok"), ("a1b-fragment01_9_2", "sentence"), ("a1b-fragment01_2_2", "context"), ("a1c-fragment01_1_2", "text units"),
            ("toolong-fragment01_1_2", "id"), ("a1bfragment01_1_2", "id"), ("a1b-fragmentXX_1_2", "id"), ("a1b-fragment01_1_x", "id")]
    labels = spark.createDataFrame([(i, 0) for i, _ in test], "id string, y int")
    index = spark.createDataFrame([], "id string, genre string, partition string, fold_no int")
    deps = spark.createDataFrame([], "id string, tokens array<struct<lemma:string>>, deps array<struct<dep:string,governor:int,governorGloss:string,dependent:int,dependentGloss:string>>")
    lemmas = spark.createDataFrame([("run", i) for i, _ in test], "verb_lemma string, id string")
    seen = Observation("assembly")
    ex = assemble_examples(index, labels.limit(0), labels, node(ann), node(src), deps, lemmas, audit=True, observation=seen)
    got = {r.id: r.reject for r in ex.collect()}
    assert got == {i: None if why == "ok" else why for i, why in test}
    assert seen.get == {"examples": 8, "id": 4, "sentence": 1, "context": 1, "span": 0, "text units": 1}
    assert set(REJECTS) == set(seen.get) - {"examples"}
