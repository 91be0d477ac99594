"""Personal data: base spans against the contract's patterns, added spans
against planted ones."""

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from figura.llm import pii

SCHEMA = "doc_id long, text string, base string, place int, code int, votes int, kind string, n int, spans string"


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(t):
    """The patterns as they are written, tried from every place."""
    got = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    got += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            got.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            got.append((3, *m.span()))
    return got


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab0149.@+- ()é\n:%_", max_size=60))
def test_base_patterns(t):
    assert pii.base_spans(t) == brute(t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4", "255.256.1.1", "+1 (555) 123-4567",
                                 "+49 30 1234567", "a.b@c.example.com", "a@b", "x@y.z", " ", ".", "-", "+", "@", "12", "000", "é"]), max_size=12))
def test_base_patterns_in_parts(parts):
    t = "".join(parts)
    assert pii.base_spans(t) == brute(t)


def test_long_runs_are_linear():
    n = 300_000
    begin = time.monotonic()
    for t in ("a" * n, "a" * n + "@", "a@" * n, "1" * n, "1." * n, "+" * n, "+1" + " " * n, "+1 " * n, "(" * n, "1 " * n, ":" * n, "a" * n + "@" + "b." * n):
        pii.base_spans(t)
        pii.loose_spans(t)
    assert time.monotonic() - begin < 30


def card(rng, prefix="4", n=16):
    s = prefix + "".join(rng.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    return next(s + c for c in "0123456789" if luhn(s + c))


def planted(rng, k):
    """A text with words, one or more base spans and, in some, a looser one."""
    text = " ".join(rng.choice(["alpha", "beta", "the", "at", "dot", "on", "v2", "3.14", "2024-01-02"]) for _ in range(30))
    at = lambda what: f"{text[:40]} {what} {text[40:]}"
    kinds = [f"contact u{k}@mail{k % 9}.example.com now", f"server {k % 250}.12.13.14 up", f"card {card(rng)} paid", f"call +1 (555) 123-{1000 + k}",
             f"build 300.1.2.{k}", f"order {rng.randint(10**15, 10**16 - 1)} sent", f"invoice 12 34 56 78 90 {k}", "nothing here"]
    hidden = [(f"email u{k} [at] site{k % 9} [dot] com please", "email"), (f"host 2001:db8:0:0:0:0:2:{k % 9}", "ip"),
              (f"amex card {card(rng, '37', 15)} used", "card"), (f"phone (030) 555-1234-{k % 9} today", "phone")]
    pick = k % 12
    return (at(kinds[pick]), None) if pick < 8 else (at(hidden[pick - 8][0]), hidden[pick - 8][1])


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, planted(rng, i)[0]) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "x@y.example.com"), (7, rows[7][1]), (7, rows[7][1]), (502, "a" * 100_000 + "@b.com"), (503, "no data")]
    df = spark.createDataFrame([(i, t, "b", 1, 2, 3, "k", 4, "s") for i, t in rows], SCHEMA).repartition(3)
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(rows)
    name = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
    want = sorted((repr(i), *[sum(k == x for k, _, _ in brute(t or "")) for x in range(4)], hashlib.sha256(name(brute(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    text = dict(rows)
    for r in got:
        spans = [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and set(brute(text[r.doc_id] or "")) <= set(spans) and len(spans) == len(brute(text[r.doc_id] or "")) + r.n_added
        extra = sorted((s, e) for k, s, e in spans if (k, s, e) not in brute(text[r.doc_id] or ""))
        assert all(a[1] <= b[0] for a, b in zip(extra, extra[1:], strict=False))


def test_added_spans_find_hidden_data_and_little_else(spark):
    rng = random.Random(4)
    made = [planted(rng, i) for i in range(1200)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    hidden = [i for i, (_, k) in enumerate(made) if k]
    found = [i for i in hidden if any(x.startswith(made[i][1]) for x in got[i].spans.split(","))]
    wrong = [i for i in got if i not in set(hidden) and got[i].n_added]
    assert len(found) >= 0.7 * len(hidden) and len(wrong) <= 0.02 * len(made)


def test_empty(spark):
    got = pii.find_personal_data(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"] and got.isEmpty()


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.7, 0.85, 0.6, 0.8, 0.75])
    ok = rng.random((20_000, 7)) < right
    votes = np.where(rng.random((20_000, 7)) < 0.2, pii.ABSTAIN, np.where(truth[:, None] == ok, pii.YES, pii.NO))
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table, post = pii.reliabilities(patterns, n.astype(float))
    assert abs(share - truth.mean()) < 0.02
    assert np.abs(table[1, :, pii.YES] / (1 - table[1, :, pii.ABSTAIN]) - right).max() < 0.05
    assert ((post[where.ravel()] > 0.5) == truth).mean() > 0.95


def test_classifier_follows_its_labels():
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    w = pii.fit_classifier(x, np.full(4, 1000.0), np.array([10.0, 20.0, 980.0, 990.0]))
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((4, 1))]) @ w)))
    assert (p[2:] > 0.9).all() and (p[:2] < 0.1).all()
