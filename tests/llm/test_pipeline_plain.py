"""run() of the pipeline against its five stages in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from figura.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(docs):
    """Base rule, and hosts whose shrunk failure rate is credibly over a half."""
    rows = []
    for d in docs:
        t = d["text"] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        symbols = sum(t.count(c) for c in "#*$%&|<>") > 0.1 * len(w)
        rows.append(((d["source"] or "").strip(" "), base, symbols, len(lines) - len(set(lines)) > 0.3 * len(lines)))
    hosts = defaultdict(list)
    for h, *fails in rows:
        hosts[h].append(fails)
    bad = set()
    for k in range(3):
        rates = [sum(f[k] for f in fs) / len(fs) for fs in hosts.values()]
        m = sum(rates) / len(rates)
        v = sum((r - m) ** 2 for r in rates) / len(rates)
        s = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
        for h, fs in hosts.items():
            p = (sum(f[k] for f in fs) + m * s) / (len(fs) + s)
            if p - 1.645 * math.sqrt(p * (1 - p) / (len(fs) + s + 1)) > 0.5:
                bad.add(h)
    return [d for d, (h, base, *_) in zip(docs, rows, strict=True) if not base and h not in bad]


def line_dedup(docs, least=50):
    """Later copies of the shortest line runs of 50 words or more go."""
    seen, gone = {}, defaultdict(set)
    spots = []
    for d in docs:
        raw = (d["text"] or "").split("\n") if d["text"] is not None else []
        at = [i for i, x in enumerate(raw) if WORD.search(x)]
        sizes = [len(WORD.findall(raw[i])) for i in at]
        runs = set()
        for s in range(len(at)):
            n = 0
            for e in range(s, len(at)):
                n += sizes[e]
                if n >= least:
                    runs.add((s, e))
                    break
        for e in range(len(at)):
            n = 0
            for s in range(e, -1, -1):
                n += sizes[s]
                if n >= least:
                    runs.add((s, e))
                    break
        spots.append((d, raw, at))
        for s, e in sorted(runs):
            seen.setdefault("\n".join(raw[i] for i in at[s:e + 1]), []).append((d["doc_id"], s, e))
    for places in seen.values():
        for doc, s, e in sorted(places)[1:]:
            gone[doc].update(range(s, e + 1))
    out = []
    for d, raw, at in spots:
        drop = gone[d["doc_id"]]
        lines = [x for i, x in enumerate(raw) if not ((k := sum(a <= i for a in at) - 1) >= 0 and k in drop)]
        text = "\n".join(lines) if drop else d["text"]
        out.append({**d, "text": text, "n_chars": len(text) if text is not None else None})
    return out


def fingerprint(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_dedup(docs):
    fp = [fingerprint(d["text"]) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for d, g in zip(docs, group, strict=True):
        first[g] = min(first.get(g, d["doc_id"]), d["doc_id"])
    return [d for d, g in zip(docs, group, strict=True) if d["doc_id"] == first[g]]


def decontaminate(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for t in items:
        if w := words(t):
            n = min(window, len(w))
            windows[n].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in known:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(d)
    return out


def pieces(docs, capacity=1024):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % capacity or min(len(ids), capacity)
        cuts = [(0, head), *((s, capacity) for s in range(head, len(ids), capacity))]
        for k, (s, n) in enumerate(cuts):
            yield d["doc_id"], k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())


def best_fit(lengths, capacity=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda k: room[k])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_run_equals_plain_python(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    a = quality(docs)
    b = line_dedup(a)
    c = near_dedup(b)
    d = decontaminate(c, items)
    want = sorted(pieces(d))
    assert len(docs) > len(a) > len(c) > len(d) > 50 and any(x["text"] != y["text"] for x, y in zip(a, b, strict=True))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spots in sequences.values():
        end = 0
        for o, n in sorted(spots):
            assert o == end
            end += n
        assert end <= 1024
    assert len(sequences) <= best_fit([w[3] for w in want])
