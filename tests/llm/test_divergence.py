"""Source divergence against plain Python integers."""

import random
from collections import Counter, defaultdict

import pytest

from figura.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, c int, terms string, i int"


def words(t):
    out, cur = [], ""
    for c in (t or "") + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or c >= "\x80":
            cur += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif cur:
            out.append(cur)
            cur = ""
    return out


def brute(rows, min_df, top=10):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, g, s in rows:
        g, s, w = g or "", s or "", words(t)
        groups[g].add(s)
        df[g].update(set(w))
        count[g, s].update(w)
    out = set()
    utf = lambda s: s.encode()
    for g, sources in groups.items():
        kept = [t for t, n in df[g].items() if n >= min_df]
        v = len(kept)
        n = {s: sum(count[g, s][t] for t in kept) for s in sources}
        p = lambda c, n, v=v: 1 + 10**9 * (c + 2) // (n + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p(count[g, s][t], n[s]), p(count[g, o][t], n[o])) for t in kept)) for o in sources if o != s]
            out |= {(g, s, "pair", o, x, k + 1) for k, (o, x) in enumerate(sorted(pairs, key=lambda y: (-y[1], utf(y[0]))))}
            terms = [(t, p(count[g, s][t], n[s]), p(sum(count[g, o][t] for o in sources), sum(n.values()))) for t in kept if count[g, s][t]]
            terms = sorted(((t, f(a, b)) for t, a, b in terms if a > b), key=lambda y: (-y[1], utf(y[0])))[:top]
            out |= {(g, s, "term", t, x, k + 1) for k, (t, x) in enumerate(terms)}
    return out


def sample():
    rng = random.Random(11)
    vocab = ["été", "Über", "ünder", "naïve", "x", "the", "of", "\x80\x85", "日本", "\U0001f600", "and", "Zed", "zed", "ſ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(150):
        src = rng.choice([f"s{i % 7}", "hot", "hot", "hot", None, "é", "￿", "\U00010000"])
        rows.append((rng.choice([" ", "-", "1", "\0", "\n"]).join(rng.choice(vocab[:rng.choice([5, len(vocab)])]) for _ in range(rng.randint(0, 60))),
                     rng.choice(["en", "fr", None]), src))
    rows += [(None, "en", "s1"), ("", "en", "only-empty"), (None, None, None), ("alone", "xx", "a"), ("alone", "xx", "b"), ("of " * 20_000, "en", "s2")]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize(("min_df", "kw"), [(3, {}), (10, {"source_block": 3, "term_block": 5})])
def test_equals_integers(spark, min_df, kw):
    rows = sample()
    df = spark.createDataFrame([(1, *r, "t", 1, 2, "x", 3) for r in rows], SCHEMA).repartition(4)
    got = [tuple(r) for r in divergence.audit(df, min_df=min_df, **kw).collect()]
    assert set(got) == brute(rows, min_df) and len(got) == len(set(got))


def test_empty_and_nothing_kept(spark):
    empty = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.isEmpty()
    rows = [("one two", "en", "a"), (None, "en", "b"), ("three", None, None)]
    df = spark.createDataFrame([(1, *r, "t", 1, 2, "x", 3) for r in rows], SCHEMA)
    assert {tuple(r) for r in divergence.audit(df).collect()} == brute(rows, 10) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_long_division_is_exact():
    import numpy as np

    for c, whole in [(0, 2), (0, 3), (10**15, 10**15 + 2), (8 * 10**15, 9 * 10**15), (123456789012, 7 * 10**14 + 1)]:
        got = divergence._shares(np.array([[c]], np.int64), np.array([[whole]], np.int64))[0, 0]
        assert got == 1 + 10**9 * (c + 2) // whole
