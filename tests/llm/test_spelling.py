"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from figura.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, m int, a string, head string, best string"


def letter(c):
    return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"


def brute(rows, min_length=5, min_count=3, every=97):
    seen = Counter()
    for i, t in rows:
        runs = "".join(c if letter(c) else " " for c in t or "").split()
        for w in runs:
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    v = {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}

    def near(x, y):
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        if len(x) > len(y):
            x, y = y, x
        return len(x) + 1 == len(y) and any(y[:i] + y[i + 1:] == x for i in range(len(y)))
    around = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w, xs in around.items():
        if xs:
            best = min(xs, key=lambda x: (-v[x], x))
            if v[best] >= 2 * v[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), v[w], len(around[w]), v[form[w]] if w in form else None) for w in v}


def sample():
    rng = random.Random(3)
    stems = ["letter", "aabbaa", "aaaaa", "aaaaaa", "aaaaaaa", "ationes", "ations", "étéétéé", "×÷×÷×", "ÿÿÿÿÿÿ", "colour", "color", "colours"]
    stems += ["commonstart" + "".join(rng.choice("ab") for _ in range(k)) for k in (1, 2, 3, 4, 5) for _ in range(6)]
    stems += ["".join(rng.choice("ab") for _ in range(k)) + "commonend" for k in (1, 2, 3, 4) for _ in range(6)]
    stems += ["l" * 3000, "l" * 2999, "l" * 1500 + "k" + "l" * 1499]
    rows = []
    for i in range(120):
        words = [rng.choice(stems) for _ in range(rng.randint(0, 40))]
        words = [w.upper() if rng.random() < .1 and w.isascii() else w for w in words]
        rows.append((i, rng.choice([" ", "-", "1", "\n", "_"]).join(words)))
    return rows + [(None, "letter letter color"), (200, None), (201, ""), (202, " \n12"), (5, rows[5][1]), (5, rows[5][1]), (None, None)]


@pytest.mark.parametrize("group_words", [4096, 8])
def test_equals_brute_force(spark, group_words):
    rows = sample()
    df = spark.createDataFrame([(i, t, "w", 1, 2, "a", "h", "b") for i, t in rows], SCHEMA).repartition(3)
    got = spelling.variants(df, every=7, group_words=group_words).collect()
    assert {tuple(r) for r in got} == brute(rows, every=7) and len(got) == len(set(got))
    assert any(r.form for r in got) and any(r.root != (r.form or r.word) for r in got)


def test_whole_table(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(docs).collect()} == brute(rows)


def test_empty(spark):
    got = spelling.variants(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.isEmpty()
    assert spelling.variants(spark.createDataFrame([(1, "aa bb cc", "", 1, 1, "", "", "")], SCHEMA)).isEmpty()


def test_groups_stay_small_under_a_common_half(spark):
    rng = random.Random(5)
    words = sorted({"prefixprefix" + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(600)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    groups = spelling.meeting_groups(df, 16).groupBy(*spelling.KEY).count().collect()
    assert max(r["count"] for r in groups if r.b - r.a > 1) <= 16


def test_bitsets_cross_machine_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(500)})
    index = spelling.BitIndex(spelling._letters(words, 6))
    lo, hi = np.zeros(len(words), int), np.full(len(words), len(words))
    x, y = index.one_edit(index.letters, lo, hi)
    want = {(i, j) for i, p in enumerate(words) for j, q in enumerate(words) if sum(c != d for c, d in zip(p, q, strict=True)) == 1}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
    longer = sorted({w[:3] + "z" + w[3:] for w in words[:50]} | {w + w[-1] for w in words[:50]})
    x, y = index.one_edit(spelling._letters(longer, 7), np.full(len(longer), 3), np.full(len(longer), 200))
    want = {(i, j) for i, p in enumerate(longer) for j, q in enumerate(words) if 3 <= j < 200 and any(p[:k] + p[k + 1:] == q for k in range(7))}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
