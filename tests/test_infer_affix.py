"""Inferred document vectors against plain Python; the affix tokenizer against
its rules tried character by character."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from figura.functions import text as T
from figura.operators import infer, product


def plain(tokens, table, noise, dim, steps, alpha, min_alpha, negative, seed):
    """One text, one word at a time."""
    words = [table[t] for t in tokens or [] if t in table]
    if not words:
        return [0.0] * dim
    h = zlib.crc32("\0".join(map(str, tokens)).encode(), seed)
    d = [(x - 0.5) / dim for x in np.random.default_rng(h).random(dim)]
    used = [table[t] for t in set(tokens) if t in table]
    longest = max(sum(x * x for x in v) for v in used + noise)
    most = 4.0 / ((1 + negative) * longest)
    sig = lambda z: 1 / (1 + math.exp(-z))
    for t in range(steps):
        rate = min((alpha - (alpha - min_alpha) * t / max(steps - 1, 1)) * len(words), most)
        g = [0.0] * dim
        for w in words:
            s = 1 - sig(sum(a * b for a, b in zip(d, w)))
            g = [a + s * b / len(words) for a, b in zip(g, w)]
        for u in noise:
            s = sig(sum(a * b for a, b in zip(d, u)))
            g = [a - negative * s * b / len(noise) for a, b in zip(g, u)]
        d = [a + rate * b for a, b in zip(d, g)]
    return d


@pytest.mark.parametrize("parts", [1, 5])
def test_inferred_vectors_equal_plain_python(spark, parts, monkeypatch):
    rng, dim = np.random.default_rng(4), 6
    table = {f"w{i}": [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([.2, 1, 3])] for i in range(40)}
    docs = [(i, [f"w{rng.integers(0, 60)}" for _ in range(rng.integers(1, 30))]) for i in range(25)]
    docs += [(30, None), (31, []), (32, ["none"]), (33, ["w1"] * 500), (34, [None, "w2"])]
    vdf = spark.createDataFrame([*table.items(), ("x", None)], "k string, v array<float>")
    noise = infer.noise_pool(vdf, "k", "v", 8, seed=1)
    assert noise.shape == (8, dim)
    files = product.stage_blocks(vdf, "k", "v", 15)
    df = spark.createDataFrame(docs, "id long, t array<string>").repartition(parts)
    got = {r.id: r.vector for r in infer.infer_vectors(df, "id", "t", files, noise, dim, steps=30, seed=7).collect()}
    for i, ts in docs:
        want = plain(["None" if t is None else t for t in ts] if ts else ts, table, noise.tolist(), dim, 30, 0.01, 0.0001, 5, 7)
        assert np.abs(np.array(got[i]) - want).max() < 1e-5, i
    assert got[30] == [0.0] * dim


def test_vectors_lean_to_their_words(spark):
    vdf = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "k string, v array<float>")
    files = product.stage_blocks(vdf, "k", "v")
    df = spark.createDataFrame([(1, ["a"] * 20), (2, ["b"] * 20)], "id long, t array<string>")
    got = {r.id: r.vector for r in infer.infer_vectors(df, "id", "t", files, np.zeros((0, 2)), 2).collect()}
    assert got[1][0] > 1 > abs(got[1][1]) and got[2][1] > 1 > abs(got[2][0])


def tokens(text, pre=T.PREFIXES, suf=T.SUFFIXES, exceptions=T.EXCEPTIONS, infix=".,?:;‘’`“”\"'~"):
    out = []
    for x in text.split():
        head, tail = [], []
        while x and x not in exceptions:
            front = x[0] in pre
            rest = x[1:] if front else x
            back = bool(rest) and not (front and rest in exceptions) and rest[-1] in suf
            if front:
                head.append(x[0])
            if back:
                tail.insert(0, rest[-1])
            x = rest[:-1] if back else rest
            if not (front or back):
                break
        if x in exceptions:
            core = [x]
        else:
            core, cur = [], ""
            for c in x:
                if c in infix:
                    core += [cur, c] if cur else [c]
                    cur = ""
                else:
                    cur += c
            core += [cur] if cur else []
        out += head + core + tail
    return out


CASES = ["(U.S.)", "Hello, world!", '"quoted"', "((nested))", "e.g., this", "...", "a.b,c", "it's", "'s", ":)", "$5.00!", "“smart”", "(", ")", "()", "(.)", ".(", "''''",
         "", "  ", "x", "Dr. Who", "well...", "(...)", "[\"'a'\"]", "étude’s", "1,000.5%", "~tilde~", "«a»", "(e.g.)", "(:)", ":))"]


def test_affix_rules(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.affix_tokens("t").alias("x")).collect()}
    assert got == {i: tokens(t) for i, t in enumerate(CASES)}
    own = {r.i: r.x for r in df.select("i", T.affix_tokens("t", "(", ")!", ("(x)",), "[-]").alias("x")).collect()}
    assert own == {i: tokens(t, "(", ")!", ("(x)",), "-") for i, t in enumerate(CASES)}
    assert spark.createDataFrame([(None,)], "t string").select(T.affix_tokens(F.col("t")).alias("x")).first().x is None


def test_affix_rules_on_random_chunks(spark):
    import random
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("a(.)'\"s: !U$") for _ in range(rng.randint(0, 14)))) for i in range(600)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, t string").select("i", T.affix_tokens("t").alias("x")).collect()}
    assert got == {i: tokens(t) for i, t in rows}
