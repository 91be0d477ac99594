"""Operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from figura.llm import (components, decontaminate, linededup, lmscore, packing, quality, sharding, simhash, suffixdedup,
                        warc, wavelet)
from figura.llm.tokens import Encoder, vocabulary

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, shard string, fp string, _b int, host int, runs int"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def sample():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "été", "the", "of", "x1", "Über", "##", "a*b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = "\n".join(text(30) for _ in range(3))
    rows = [(i, text(rng.randint(0, 60)) + ("\n" + passage + "\n" if i % 3 == 0 else "\n \n") + text(12)) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "   \n\t"), (43, "one"), (44, text(20_000)), (45, passage), (46, passage), (None, passage),
             (None, None), (47, "a" * 700), (48, "ab" * 300), (50, rows[0][1]), (50, rows[0][1]), (51, text(60)), (51, text(60))]
    return [(d, t, rng.choice(["h1", "h2", None, ""]), "en", None, "s", "f", 1, 2, 3) for d, t in rows]


ROWS = sample()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def key(x):
    return sorted(x, key=repr)


def test_archives(spark, empty):
    big = "<p>" + "é" * 200
    pages = [(i, f"http://{'www.' * (i % 2)}Host{i % 5}.example.com:80/p?q={i % 3}", big if i % 4 == 0 else f"<b>{i % 7}</b>" * (i % 50)) for i in range(60)]
    pages += [(70, None, None), (71, "", ""), (None, "http://x.org", big), (4, pages[4][1], big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    got = warc.archive_pages(df, archive_bytes=3000, fan_in=2, range_rows=5).collect()
    first = {}
    for p, _, h in pages:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            first[data] = min(p, first.get(data, p))
    want = []
    for p, _, h in pages:
        data = (h or "").encode()
        r = first.get(data) if p is not None and p > first.get(data, p) else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if r is None else "revisit", r))
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)
    order = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order) and sorted(r.position for r in got) == list(range(len(pages)))
    assert warc.archive_pages(empty.selectExpr("doc_id page_id", "text url", "text html")).count() == 0


def test_one_key_fills_many_range_files(spark, tmp_path):
    """Files of one sort key are read on in the next pass, in order."""
    pages = [(7, "http://a.org/x", "<p>")] * 90 + [(i, "http://a.org/x", "<p>") for i in range(20)] + [(None, None, None)] * 70
    pages += [(i, "http://b.org/" + "y" * 5000 * (i % 2), "<p>") for i in range(20)]
    pages += [(i, u, "<p>") for i in range(6) for u in ("http://a.org/x\x00", "http://a.org/x\x00!", "http://a.org/x\x01", "http://a.org/x\x00\x00")]
    random.Random(4).shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    manifest = warc.write_archives(warc.captures(df), f"{tmp_path}/archives", 20)
    merged = warc.merge_index(manifest, f"{tmp_path}/index", fan_in=2, range_rows=3)
    got = warc.read_index(merged).orderBy("position").collect()
    assert key((r.page_id, r.url) for r in got) == key(x[:2] for x in pages)
    assert [r.position for r in got] == list(range(len(pages)))
    order = [(r.key, r.ts, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)
    met = Counter()
    for r in got:
        assert r.capture == met[r.key]
        met[r.key] += 1
    assert [warc._key_of(warc.sort_key(k, "2", 1)) for k in ("", "a\x00\x01b", "\x01\x02")] == ["", "a\x00\x01b", "\x01\x02"]


def test_loser_tree_merges():
    rng = random.Random(1)
    runs = [sorted((rng.randint(0, 9), i) for _ in range(rng.randint(0, 9))) for i in range(7)]
    assert [x[0] for x in warc.LoserTree([iter(r) for r in runs])] == sorted(x[0] for r in runs for x in r)
    assert list(warc.LoserTree([])) == []


def test_cross_entropy_difference(docs, empty):
    grams = lambda t: (w := [lower(x) for x in (t or "").split()]) and list(zip(["<s>", *w], w))
    target = [(d, t) for d, t in PAIRS if d is not None and d % 5 == 0]
    model = {}
    for name, rows in (("t", target), ("b", PAIRS)):
        g = Counter(x for _, t in rows for x in grams(t))
        h = Counter()
        for (a, _), n in g.items():
            h[a] += n
        model[name] = g, h, sum(g.values())
    v = len(set(model["t"][1]) | set(model["b"][1]))
    scale, a = model["t"][2] / model["b"][2], 0.01
    want = []
    for d, t in PAIRS:
        loss = [sum(s * (math.log2(k * h[x[0]] + a * v) - math.log2(k * g[x] + a)) for s, k, (g, h, _) in
                    ((1, 1, model["t"]), (-1, scale, model["b"]))) for x in grams(t)]
        want.append((d, len(loss), round(sum(loss) / len(loss), 6) if loss else None))
    for kw in ({}, dict(shard_bytes=5000, chunk_tokens=500, heavy=50), dict(shard_bytes=5000, chunk_tokens=500, heavy=50, fan=2),
               dict(shard_bytes=20_000, chunk_tokens=300, heavy=5, fan=1)):
        got = lmscore.cross_entropy_difference(docs, docs.where("doc_id % 5 = 0"), **kw).collect()
        assert key((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 6)) for r in got) == key(want)
    assert lmscore.cross_entropy_difference(empty, empty).count() == 0
    assert lmscore.cross_entropy_difference(docs, empty).count() == len(ROWS)


def test_scoring_rows_grow_with_the_ngrams(spark, monkeypatch):
    """Twice the text, chunks and shards: about twice the rows, not four times."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    made = []
    for k in (1, 2):
        df = spark.createDataFrame([(i, say(400)) for i in range(64 * k)], "doc_id long, text string").repartition(4)
        bits = 4 + k
        counts = lmscore.ngram_counts(df, True, bits, 800, fan=3)
        made.append(counts.count())
        assert lmscore._levels(bits, 3) == ([3, 5] if k == 1 else [3, 6])
        assert counts.groupBy("shard").count().count() == 8
    assert made[1] <= 2.2 * made[0]


@pytest.mark.parametrize("kw", [{}, dict(shard_bytes=2000, chunk_tokens=500, heavy=50), dict(shard_bytes=2000, chunk_tokens=500, heavy=50, fan=3)])
@pytest.mark.parametrize("held", ["separate", "empty"])
def test_cross_entropy_difference_with_a_background(spark, docs, held, kw):
    """N-grams that the background holds once, and those it doesn't hold."""
    back = [] if held == "empty" else [(1, "alpha beta gamma once only"), (2, "the of the of"), (3, None), (4, PAIRS[1][1])]
    target = [(d, t) for d, t in PAIRS if d is not None and d % 5 == 0 and d != 44]
    grams = lambda t: (w := [lower(x) for x in (t or "").split()]) and list(zip(["<s>", *w], w))
    (gt, ht), (gb, hb) = [(Counter(x for _, t in rows for x in grams(t)), Counter(h for _, t in rows for h, _ in grams(t))) for rows in (target, back)]
    v, a = len(set(ht) | set(hb)), 0.01
    scale = sum(ht.values()) / sum(hb.values()) if hb else 1.0
    want = []
    for d, t in PAIRS:
        diff = [math.log2(ht[h] + a * v) - math.log2(gt[h, w] + a) - math.log2(scale * hb[h] + a * v) + math.log2(scale * gb[h, w] + a) for h, w in grams(t)]
        want.append((d, len(diff), round(sum(diff) / len(diff), 6) if diff else None))
    got = lmscore.cross_entropy_difference(docs, spark.createDataFrame(target, "doc_id long, text string"),
                                           spark.createDataFrame(back, "doc_id long, text string"), **kw).collect()
    assert key((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 6)) for r in got) == key(want)


def brute_runs(rows, least):
    """Deleted non-blank lines by (id, text): windows of ``least`` words or more, compared pairwise by content."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = {d: [x for x in (d[1] or "").split("\n") if x.split()] for d in docs}
    at = defaultdict(list)
    for d in docs:
        n = [len(x.split()) for x in seqs[d]]
        for i in range(len(n)):
            for e in range(i, len(n)):
                if sum(n[i:e + 1]) >= least:
                    at[tuple(seqs[d][i:e + 1])].append((d, i))
                    if sum(n[i:e + 1]) >= 2 * least + 60:
                        break
    return docs, seqs, at


def test_line_runs(docs, empty):
    got = {(r.doc_id, r.text) for r in linededup.delete_repeats(docs, 50).select("doc_id", "text").collect()}
    _, seqs, at = brute_runs(PAIRS, 50)
    # one first copy of every repeated run stays; no other copy of it is whole
    kept = Counter()
    for _, t in got:
        lines = [x for x in (t or "").split("\n") if x.split()]
        for run in {tuple(lines[i:e + 1]) for i in range(len(lines)) for e in range(i, len(lines))}:
            kept[run] += 1
    for run, places in at.items():
        if len({d for d, _ in places}) > 1:
            assert kept[run] <= 1
    longest = max((r for r, p in at.items() if len({d for d, _ in p}) > 3), key=len)
    assert kept[longest] == 1
    clean = {d for d in seqs if not any(len({x for x, _ in p}) > 1 and d in {x for x, _ in p} for p in at.values())}
    assert all(d in got for d in clean)
    assert linededup.delete_repeats(docs).count() == len(ROWS) and linededup.delete_repeats(docs).columns == docs.columns
    assert linededup.delete_repeats(empty, details=True).count() == 0


def test_line_runs_depth(spark):
    """Short lines: several rounds of doubling; the copy goes whole, its surroundings stay."""
    run = [f"w{i} v{i}" for i in range(60)]
    rows = [(1, "\n".join(["first", *run, "end"])), (2, "\n".join(["second", *run[:40], "", *run[40:], "", "tail"])), (3, "\n".join(run[:24])), (4, "\n".join(run[5:31]))]
    got = {r.doc_id: r.text for r in linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {1: rows[0][1], 2: "second\ntail", 3: rows[2][1], 4: ""}


def test_host_rules(docs, empty):
    got = quality.host_rules(docs).collect()
    want = []
    for d, t in PAIRS:
        w = (t or "").encode().split()
        lines = [x for x in (t or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for k in range(5)}
        want.append((d, len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit),
                     len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == key(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.host_rules(empty).count() == 0 and quality.filter_documents(empty).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_bad_host_is_rejected_and_prior_protects_small_ones(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "bad", f"h{i % 40}" if i < 40 else "junk") for i in range(40, 140)]
    rows += [(1000 + i, good, f"h{i % 40}") for i in range(400)] + [(2000, good, "junk"), (2001, "short", "tiny"), (2002, good, "tiny")]
    got = {r.doc_id: r.kept for r in quality.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[2000] and got[2002] and got[1000]


def test_simhash(docs, empty):
    def fp(t):
        w = lower(t or "").encode().split()
        sh = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [fp(t) for _, t in PAIRS]
    label = {f: f for f in fps}
    for a in label:
        for b in label:
            if (a ^ b).bit_count() <= 4:
                x, y = label[a], label[b]
                for f in label:
                    if label[f] == x:
                        label[f] = y
    least = {}
    for (d, _), f in zip(PAIRS, fps):
        if d is not None:
            least[label[f]] = min(d, least.get(label[f], d))
    got = simhash.near_duplicates(docs).collect()
    assert key((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == key((d, f, least.get(label[f])) for (d, _), f in zip(PAIRS, fps))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({label[f] for f in fps})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("blocks", [5, 6])
def test_bk_links_in_cut_shards(spark, blocks):
    """A dense hot group over many trees: same components as all pairs."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    vals = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(120)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in vals], "fp long")
    got = {r.node: r.label for r in components.components(simhash.links(df, 4, tree_size=50, blocks=blocks)).collect()}
    root = np.arange(len(vals))
    arr = np.array(vals, np.uint64)
    for i in range(len(vals)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
            root[root == root[j]] = root[i]
    signed = [v - (1 << 64) if v >> 63 else v for v in vals]
    want = {signed[i]: min(signed[j] for j in np.flatnonzero(root == root[i])) for i in range(len(vals))}
    assert {n: got.get(n, n) for n in signed} == want


def test_wavelet_matrix():
    ids = np.array([random.Random(2).randrange(3000) for _ in range(5000)] + [2], np.uint32)
    m, names, lengths = wavelet.load(wavelet.dump(ids, ["a", None], [5000, 1]))
    assert (m.all() == ids).all() and names == ["a", None] and lengths.tolist() == [5000, 1]
    at = np.array([0, 1, 511, 512, 4999, 5000])
    assert (m.access(at) == ids[at]).all()
    for c in [int(ids[7]), 2, 2999, 4096]:
        spots = np.flatnonzero(ids == c)
        assert m.count(c) == len(spots) and m.occurrences(c).tolist() == spots.tolist()
        assert m.count(c, 100, 3000) == ((spots >= 100) & (spots < 3000)).sum() and m.select(c, len(spots)) == -1


def test_token_files(docs, empty):
    enc = Encoder(WORD, 2)
    got = sorted(wavelet.token_files(docs, WORD, shard_tokens=3000).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in PAIRS), key=lambda d: (d is not None, d or 0))
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((d, len(e := enc.encode(t)) // 4, zlib.crc32(e)) for d, t in PAIRS)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert wavelet.token_files(empty, WORD).count() == 0


def test_rendezvous(docs, empty):
    got = sharding.shard_records(docs, [1.0] * 8, [1.0] * 9).collect()
    assert key((r.doc_id, r.size, r.text_crc32) for r in got) == key((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in PAIRS)
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_records(empty, [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(["doc_id"], [1.0, 0.0])


def test_rendezvous_weights(spark):
    n = Counter(r[0] for r in spark.range(20_000).select(sharding.rendezvous_shard(["id"], [1.0, 3.0])).collect())
    assert 0.73 < n[1] / 20_000 < 0.77


def test_decontamination(spark, docs, empty):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    items = [("5", PAIRS[0][1]), ("6", "one"), ("7", None), (None, "alpha beta gamma"), ("8", "the of the"), ("8", "été x1"), ("9", "")]
    items += [(str(20 + i), " ".join(words(PAIRS[44 % len(PAIRS)][1] or PAIRS[3][1])[i * 7:i * 7 + 20])) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = [(i, tuple(w[p:p + min(13, len(w))])) for i, t in items if (w := words(t)) for p in range(len(w) - min(13, len(w)) + 1)]
    want = []
    for d, t in PAIRS:
        w = words(t)
        hit, met = set(), set()
        index = defaultdict(list)
        for n in {len(x) for _, x in windows}:
            for p in range(len(w) - n + 1):
                index[tuple(w[p:p + n])].append(p)
        for i, x in windows:
            for p in index.get(x, ()):
                hit.update(range(p, p + len(x)))
                met.add(i)
        met.discard(None)
        want.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontaminate.contamination(docs, bench).collect()
    assert key((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == key(want)
    first = next(r for r in got if r.doc_id == 0)
    assert first.longest_words == len(words(PAIRS[0][1])) and first.longest_doc_word == 0
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.where("false")).collect())


@pytest.mark.parametrize("kw", [{}, dict(max_group=3, chunk_bytes=9000, collection_bytes=4000), dict(length=17)])
def test_suffix_dedup(docs, kw):
    n = kw.get("length", 200)
    data = [(t or "").encode() for _, t in PAIRS]
    c = Counter(t[i:i + n] for t in data for i in range(len(t) - n + 1))
    want = []
    for (d, _), t in zip(PAIRS, data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if c[t[i:i + n]] > 1:
                gone[i:i + n] = True
        want.append((d, len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    got = suffixdedup.remove_repeats(docs, **kw).collect()
    assert key((r.doc_id, r.n_bytes, sum(s.e - s.s for s in r.spans), bytes(r.kept)) for r in got) == key(want)


def test_suffix_dedup_empty(empty):
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_packing(docs, empty):
    enc = Encoder(BYTE, 2)
    got = packing.pack_documents(docs, BYTE, 64).collect()
    want = [(d, k, s, n, zlib.crc32(e[4 * s:4 * (s + n)])) for d, t in PAIRS for e in [enc.encode(t)] for k, (s, n) in enumerate(packing.cut(len(e) // 4, 64))]
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == key(want)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 64
    room = []                                            # best-fit decreasing, piece by piece
    for n in sorted((r.length for r in got), reverse=True):
        fit = min((x for x in room if x >= n), default=None)
        if fit is not None:
            room.remove(fit)
        room.append((64 if fit is None else fit) - n)
    assert len(at) == len(room)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_plan_is_whole_and_small():
    rng = random.Random(5)
    counts = {n: rng.randint(0, 10_000) for n in range(1, 1025)}
    slots = packing.plan(counts, 1024)
    got = Counter()
    for n, _, k, _, _ in slots:
        got[n] += k
    assert got == Counter({k: v for k, v in counts.items() if v}) and len(slots) < 20_000
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]
