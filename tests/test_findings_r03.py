"""Steps of the third round's findings: what a task holds, reads and computes once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from figura.functions import text as T
from figura.operators import arguments, encode, infer, product, train
from figura.sources import markup


def test_affix_tokens_keep_chunks_whole_and_nulls_apart(spark):
    rows = [(0, "(x\0y) x\0y!"), (1, None), (2, ""), (3, "(a.b) (a.b)")]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, t string").select("i", T.affix_tokens("t").alias("x")).collect()}
    # a NUL is no mark and no infix; the fold over characters cut there
    assert got == {0: ["(", "x\0y", ")", "x\0y", "!"], 1: None, 2: [], 3: ["(", "a", ".", "b", ")"] * 2}


class _Frame:
    """Stands for a DataFrame and keeps the function that its tasks would run."""

    class schema:
        fields: list = []

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_arguments_are_taken_in_pieces(monkeypatch):
    monkeypatch.setattr(arguments, "_DEPENDENCIES", 5)
    kind = pa.struct([("dep", pa.string()), ("governor", pa.int32()), ("dependent", pa.int32()),
                      *[(c, pa.string()) for c in ("dependent_gloss", "dependent_lemma", "governor_gloss", "governor_lemma")]])
    dep = lambda i: {"dep": "nsubj", "governor": 1, "dependent": i + 1, "dependent_gloss": f"W{i}", "dependent_lemma": f"l{i}",
                     "governor_gloss": "G", "governor_lemma": "g"}
    sizes = [2, 0, 2, 7, 1, 3]
    parses = pa.array([[dep(i) for i in range(n)] for n in sizes] + [None], pa.list_(kind))
    out = list(arguments.all_arguments(_Frame(), ["k"]).run(iter([pa.RecordBatch.from_arrays([pa.array(range(7)), parses], names=["k", "deps"])])))
    assert max(b.num_rows for b in out) <= 7 and len(out) > 2       # one sentence, or 5 dependencies
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["k"] for r in rows] == [k for k, n in enumerate(sizes) for _ in range(n)]
    assert [r["subject"] for r in rows if r["word_offset"] == 1] == ["w1", "w1", "w6", "w0", "w2"]


def test_training_frame_fills_the_cores_and_carries_no_text(spark, monkeypatch):
    df = spark.range(30_000).select("id", F.array(F.rand(1)).alias("a"), F.lit("x" * 50).alias("text"), F.lit("g").alias("genre"),
                                    (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    cached = train.sized_for_training(df, {"l": ["a"]})
    assert cached.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism)
    cached.unpersist()
    seen = []

    def sized(frame, sets):
        seen.append(frame.columns)
        return frame.persist()
    monkeypatch.setattr(train, "sized_for_training", sized)
    monkeypatch.setattr(train, "fit_predict", lambda frame, *_: frame.select("id"))
    assert train.ablation(df, {"l": ["a"]}).count() == 30_000
    assert seen == [["id", "split", "genre", "y", "a"]]


def test_a_text_is_fitted_alike_alone_and_among_others():
    rng = np.random.default_rng(4)
    sizes = [40, 0, 1, 300, 7]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    word, count = rng.integers(0, 50, len(doc)), rng.integers(1, 5, len(doc)).astype(float)
    table, noise, start = rng.normal(size=(50, 8)), rng.normal(size=(6, 8)), rng.random((len(sizes), 8))
    how = (table, noise, 30, 0.01, 0.0001, 5)
    got = infer.fit(start, doc, word, count, *how)
    for i in range(len(sizes)):
        own = doc == i
        alone = infer.fit(start[i:i + 1], doc[own] - i, word[own], count[own], *how)
        assert (got[i] == alone[0]).all()
    assert (got[1] == 0).all()


def test_terms_are_encoded_over_the_cores_with_hashes_kept(spark):
    terms = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    got = encode.encode_texts(terms, "t", encode.hashing_encoder_factory(4), 4)
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and got.count() == 2
    enc = encode.HashingEncoder(4)
    first = enc(["a b", "b"])
    assert set(enc.hashes) == {"a", "b"} and (enc(["a b", "b"]) == first).all()


def test_blocks_are_held_as_floats(spark):
    vectors = spark.createDataFrame([(1, [0.1, 2.0]), (2, [3.0, 4.0])], "k bigint, v array<float>")
    keys, table = product.load_block(product.stage_blocks(vectors, "k", "v")[0])
    assert table.dtype == np.float32 and sorted(keys.to_pylist()) == [1, 2]


def test_markup_is_scanned_in_arrow():
    docs = [("a", '<t x="1" y><w>u &amp; v</w><br>tail</t>'), ("b", None), ("c", "plain")]
    out = list(markup._parse_batches(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs, strict=True)], names=["doc_id", "content"])])))
    rows = [r | {"attrs": r["attrs"] if r["attrs"] is None else dict(r["attrs"])} for b in out for r in b.to_pylist()]
    assert rows == [r for d, c in docs for r in markup.parse_markup(d, c)]
