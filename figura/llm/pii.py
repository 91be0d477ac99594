"""Personal data by weak supervision.

Four kinds of strict (base) spans are always kept. Looser candidates are
voted on by labelers: regular expressions and checksums, gazetteers (top-level
domains, card and calling prefixes, reserved networks) and words nearby. Votes
are counted over all documents; expectation-maximisation on the counts (a
Dawid-Skene model with abstentions) estimates how reliable each labeler is,
and a logistic classifier of span features is trained on the resulting
probabilities. Candidates it accepts are added to the base spans.

Only counts per vote pattern and per feature pattern reach the driver: at most
4 * 3^7 and 4 * 2^10 rows, whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "shape", "checksum", "gazetteer", "context", "other context", "boundary")
FEATURES = ("strict", "checksum", "gazetteer", "context", "other context", "left free", "right free", "separators", "long", "one digit")
VOTES, MASKS = 3 ** len(LABELERS), 2 ** len(FEATURES)
ABSTAIN, NO, YES = range(3)

# Common top-level domains, calling codes, card prefixes.
TLDS = frozenset("com org net edu gov int mil io co info biz me us uk de fr es it nl be ch at se no dk fi pl pt ie eu ru ua cz gr hu ro jp cn "
                 "kr in au nz ca mx br ar cl za il tr".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55",
           "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "971", "972", "351", "353", "358", "420")
CARDS = (("4", (13, 16, 19)), ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)), ("34", (15,)), ("37", (15,)),
         ("36", (14,)), ("38", (14,)), ("6011", (16, 19)), ("65", (16, 19)), ("35", (16, 19)), ("62", (16, 17, 18, 19)))
NEAR = {
    EMAIL: "email e-mail mail contact write reply courriel correo kontakt",
    IP: "ip host server address client login adresse dirección from",
    CARD: "card visa mastercard amex credit debit carte tarjeta karte payment pay",
    PHONE: "phone tel telephone call fax mobile cell contact whatsapp téléphone teléfono telefon",
}
NEAR = {k: frozenset(v.split()) for k, v in NEAR.items()}
OTHER = frozenset("version v id order invoice isbn issn token serial date page section license part doi sku build revision".split())
_NEARBY = 32          # code points before a span that are read for words

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r" ?[(\[{] ?(?:at|AT|At) ?[)\]}] ?| ?@ ?")
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{] ?(?:dot|DOT|Dot) ?[)\]}] ?| (?:dot|DOT) )[A-Za-z0-9-]{1,63}){1,8}")
_SIX = re.compile(r"[0-9A-Fa-f:]{3,}")
_SIX_FORM = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
_RUN = re.compile(r"[0-9]++")
_LOOSE = re.compile(r"[0-9(](?:[ ().-]{0,2}[0-9])++")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict spans, by kind, then start. Every
    scan is linear: an address is read outwards from its ``@``, digits are
    never tried again from the middle of a run."""
    got, end, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, end)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            got.append((EMAIL, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _RUN.search(text):
        return got
    got += [(IP, m.start(), m.end()) for m in _QUAD.finditer(text) if m[1] and all(map(_small, m[0].split(".")))]
    for m in _CHAIN.finditer(text):
        d = m.end() - m.start()
        if d >= 16 and 16 <= len(n := _digits(m[0])) <= 19 and _luhn(n):
            got.append((CARD, m.start(), m.end()))
    got += [(PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return got


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates beyond the strict patterns: spelt-out
    addresses, IPv6, card numbers of other lengths or inside longer chains,
    phone numbers without a plus."""
    got, end = [], 0
    if "@" in text or "at" in text or "AT" in text or "At" in text:
        for m in _MARK.finditer(text):
            if m[0] == "@" or m.start() < end:
                continue
            start = _local_start(text, m.start(), end)
            if start < m.start() and (d := _SPELT.match(text, m.end())):
                got.append((EMAIL, start, d.end()))
                end = d.end()
    if ":" in text:
        got += [(IP, m.start(), m.end()) for m in _SIX.finditer(text)
                if m.end() - m.start() <= 39 and m[0].count(":") >= 2 and _SIX_FORM.fullmatch(m[0])]
    if not _RUN.search(text):
        return got
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 13:
            continue
        n = len(_digits(m[0]))
        if 13 <= n <= 19:
            got.append((CARD, m.start(), m.end()))
        elif n > 19:
            runs = [(r.start() + m.start(), r.end() + m.start()) for r in _RUN.finditer(m[0])]
            i = 0
            while i < len(runs):
                a, b = runs[i]
                four = runs[i:i + 4]
                if 13 <= b - a <= 19:
                    got.append((CARD, a, b))
                elif len(four) == 4 and all(y - x == 4 for x, y in four):
                    got.append((CARD, a, four[3][1]))
                    i += 3
                i += 1
    got += [(PHONE, m.start(), m.end()) for m in _LOOSE.finditer(text)
            if 9 <= m.end() - m.start() <= 24 and 8 <= len(_digits(m[0])) <= 15 and len(_RUN.findall(m[0])) >= 3]
    return got


def judge(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int]:
    """(votes, features) of a candidate: votes as digits of base 3 in the
    order of ``LABELERS``, features as bits in the order of ``FEATURES``."""
    s = text[start:end]
    digits = _digits(s)
    before = {w.lower() for w in _WORDS.findall(text[max(0, start - _NEARBY):start])}
    left = start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_-+./@:")
    right = end == len(text) or not (text[end].isalnum() or text[end] in "_-@/")
    if kind == EMAIL:
        host = _MARK.split(s, maxsplit=1)[-1]
        names = [x for x in re.split(r"[^A-Za-z0-9-]+(?:dot|DOT|Dot)?[^A-Za-z0-9-]*| (?:dot|DOT) ", host) if x]
        shape = len(names) >= 2 and names[-1].isalpha() and len(names[-1]) >= 2
        check, listed = shape, bool(names) and names[-1].lower() in TLDS
    elif kind == IP:
        six = ":" in s
        shape = six or not any(len(p) > 1 and p[0] == "0" for p in s.split("."))
        check = six and len(s) >= 8 or not six and all(map(_small, s.split(".")))
        listed = s.startswith(("10.", "192.168.", "127.", "172.16.", "fe80:", "2001:", "fd", "fc"))
    elif kind == CARD:
        shape = len(digits) in (14, 15, 16, 19) or strict
        check = _luhn(digits)
        listed = any(digits.startswith(p) and len(digits) in n for p, n in CARDS)
    else:
        shape = s[0] in "+(" or digits.startswith("00")
        check = 8 <= len(digits) <= 15
        listed = s[0] == "+" and digits.startswith(CALLING) or digits.startswith("00") and digits[2:].startswith(CALLING)
    near, other = bool(before & NEAR[kind]), bool(before & OTHER)
    votes = (YES if strict else ABSTAIN, YES if shape else NO, YES if check else NO, YES if listed else ABSTAIN,
             YES if near else ABSTAIN, NO if other else ABSTAIN, YES if left and right else NO)
    mask = (strict, check, listed, near, other, left, right, any(c in " .-()" for c in s), end - start > 16, len(set(digits)) == 1)
    return sum(v * 3 ** k for k, v in enumerate(votes)), sum(1 << k for k, x in enumerate(mask) if x)


class _Taken:
    """Spans that don't overlap, in order of their starts."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take the span unless it overlaps one taken before."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, where, codes = [], [], []
        for t in b.column(1):
            t = t.as_py() or ""
            strict = base_spans(t)
            taken = sorted((s, e) for _, s, e in strict)
            begins = np.array([s for s, _ in taken], np.int64)
            ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else begins
            found = []
            for k, s, e in loose_spans(t):                   # looser ones only where no strict span lies
                at = int(np.searchsorted(begins, e)) - 1
                if at < 0 or ends[at] <= s:
                    found.append((k, s, e, False))
            place, code = [], []
            for k, s, e, known in [(*x, True) for x in strict] + found:
                votes, mask = judge(t, k, s, e, known)
                place += (k, s, e)
                code.append((k * VOTES + votes) * MASKS + mask)
            base.append([x for span in strict for x in span])
            where.append(place)
            codes.append(code)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in (base, where, codes)]],
                                         names=["doc_id", "base", "place", "code"])


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """(share, table, posterior): expectation-maximisation over vote patterns.

    ``votes`` is patterns x labelers, ``counts`` how often each was seen;
    ``table[y, labeler, vote]`` is the chance of a vote given the truth y. Few
    pseudo-counts say that labelers are right rather than wrong, which fixes
    which class is which.
    """
    prior = np.array([[2.0, 3.0, 0.5], [2.0, 0.5, 3.0]])
    signed = (votes == YES).sum(1) - (votes == NO).sum(1)
    post = 1 / (1 + np.exp(-signed.astype(float)))
    onehot = (votes[:, :, None] == np.arange(3)).astype(float)
    share, table = 0.5, np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        table = np.einsum("yp,plv->ylv", weight, onehot) + prior[:, None, :]
        table /= table.sum(2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        odds = np.log(share / (1 - share)) + np.einsum("plv,lv->p", onehot, np.log(table[1] / table[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - post).max(initial=0) < tolerance:
            post = new
            break
        post = new
    return share, table, post


def fit_classifier(x: np.ndarray, counts: np.ndarray, positive: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (bias last) of a logistic classifier by Newton steps. Row i of
    ``x`` stands for ``counts[i]`` spans, ``positive[i]`` of them true in
    expectation."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T * (counts * p * (1 - p)) @ x + np.diag(pull + 1e-9), x.T @ (positive - counts * p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def train(candidates: DataFrame) -> dict[int, np.ndarray]:
    """Classifier weights by kind from all candidates (a column ``code``)."""
    spark = candidates.sparkSession
    parts = candidates.select(F.expr(f"code div {VOTES * MASKS}").alias("kind"), F.expr(f"(code div {MASKS}) % {VOTES}").alias("votes"),
                              F.expr(f"code % {MASKS}").alias("mask"))
    seen = sorted(tuple(r) for r in parts.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect())
    chance = []
    for kind in sorted({k for k, _, _ in seen}):
        rows = [(v, n) for k, v, n in seen if k == kind]
        votes = np.array([[v // 3 ** j % 3 for j in range(len(LABELERS))] for v, _ in rows])
        _, _, post = reliabilities(votes, np.array([n for _, n in rows], float))
        chance += [(kind, v, float(p)) for (v, _), p in zip(rows, post, strict=True)]
    if not chance:
        return {}
    post = spark.createDataFrame(chance, "kind long, votes long, p double")
    seen = parts.groupBy("kind", "votes", "mask").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(post), ["kind", "votes"])
    rows = sorted(tuple(r) for r in seen.groupBy("kind", "mask").agg(F.sum("n"), F.round(F.sum(F.col("n") * F.col("p")), 6)).collect())
    got = {}
    for kind in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == kind]
        x = np.array([[m >> j & 1 for j in range(len(FEATURES))] for _, m, _, _ in mine], float)
        got[kind] = fit_classifier(x, np.array([r[2] for r in mine], float), np.array([r[3] for r in mine], float))
    return got


def accepted(weights: dict[int, np.ndarray], threshold: float) -> frozenset[int]:
    """kind * MASKS + mask of the feature patterns whose spans are added."""
    x = np.array([[m >> j & 1 for j in range(len(FEATURES))] + [1] for m in range(MASKS)], float)
    need = np.log(threshold / (1 - threshold))
    return frozenset(k * MASKS + int(m) for k, w in weights.items() for m in np.flatnonzero(x @ w >= need))


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added),
    one row per row of ``docs``.

    Counts and digest are of the base spans; ``spans`` has base and added ones
    as ``kind:start:end`` in code points. An added span overlaps no other.
    Null or empty text has no spans; repeated rows give repeated results (and
    count twice in training); an empty table gives no rows; other columns are
    not read. Spans, votes and features are written once, so the text is
    scanned once and a lost executor repeats no training.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = stage(rows.mapInArrow(_scan, f"doc_id {kind}, base array<int>, place array<int>, code array<int>"), "pii-candidates")
    good = accepted(train(found.select(F.explode("code").alias("code"))), threshold)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, added = [], [], [], []
            for base, place, code in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                strict = list(zip(base[::3], base[1::3], base[2::3], strict=True))
                all_, taken = list(strict), _Taken()
                for i in range(len(strict), len(code)):
                    k, s, e = place[3 * i:3 * i + 3]
                    if k * MASKS + code[i] % MASKS in good and taken.add(s, e):
                        all_.append((k, s, e))
                counts.append([sum(k == x for k, _, _ in strict) for x in range(4)])
                digests.append(hashlib.sha256(_named(strict).encode()).hexdigest())
                spans.append(_named(all_))
                added.append(len(all_) - len(strict))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return found.mapInArrow(finish, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                            + ", base_sha256 string, spans string, n_added bigint")
