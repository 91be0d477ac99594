"""Stages with columns named like their internals, repeated and null ids; the
shard choice and the search against plain Python."""

import random
import struct
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from figura.llm import decontaminate, packing, quality, sharding, simhash

NAMES = ["row", "host", "h", "id", "k", "n", "kid", "kh", "fp", "component", "component_id", "_kept", "_kfp", "_fp", "_bad_host", "host_bad",
         "base_failed", "n_words", "n_lines", "first", "none", "rank", "_b", "_off", "_n", "_rank", "length"]


def rows():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randint(0, 9)) for _ in range(n))
    texts = [say(40) for _ in range(12)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(20, texts[0], "s0"), (None, texts[0], "s1"), (None, texts[1], None), (3, texts[3], "s0"), (3, texts[3], "s2"), (3, say(40), "s0"),
            (30, None, "s0"), (31, "", "s1"), (None, None, None), (None, None, None)]
    return out


@pytest.mark.parametrize("unique", [True, False])
def test_any_column_names(spark, unique):
    data = [r for r in rows() if r[0] is not None] if unique else rows()
    if unique:
        data = list({r[0]: r for r in data}.values())
    df = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    for got in (simhash.keep_one(df), quality.filter_documents(df)):
        assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
        assert all(tuple(r)[3:] == tuple(range(len(NAMES))) for r in got.collect())
    kept = sorted((repr(r.doc_id), r.text, r.source) for r in simhash.keep_one(df).collect())
    fp = {t: simhash.fingerprint(t.encode() if t is not None else None) for _, t, _ in data}
    root = {t: t for t in fp}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 4 and find(a) != find(b):
                root[find(a)] = find(b)
    groups = {}
    for d, t, s in data:
        groups.setdefault(find(t), []).append((d is None, d if d is not None else 0, t, s))
    assert len(kept) == len(groups)
    for g in groups.values():
        least = min(g, key=lambda x: x[:2])[:2]
        assert sum((repr(None if x[0] else x[1]), x[2], x[3]) in kept for x in g if x[:2] == least) >= 1
    again = sorted((repr(r.doc_id), r.text, r.source) for r in simhash.keep_one(df.repartition(5)).collect())
    assert again == kept


def test_pack_takes_any_column(spark):
    cuts = spark.createDataFrame([(1, 0, 0, 5, 9), (1, 1, 5, 10, 8), (2, 0, 0, 5, 7), (None, 0, 0, 3, 6)],
                                 "doc_id long, piece int, start long, length long, ids_crc32 long")
    for c in ("row", "_b", "_off", "_n", "_rank", "rank", "sequence_id", "offset"):
        cuts = cuts.withColumn(c, F.lit(c))
    got = packing.pack(cuts, 10).collect()
    assert len(got) == 4 and all(r["row"] == "row" and r["_b"] == "_b" and r["rank"] == "rank" for r in got)
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(place) == 3
    for spots in place.values():
        end = 0
        for o, n in sorted(spots):
            assert o == end
            end += n
        assert end <= 10


# ------------------------------------------------------------- shards

def score(shard, key, weight):
    """Spark's xxhash64(shard, key): each value hashed with the hash so far as seed; null leaves it."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    return -weight / np.log(((h >> 11) + 0.5) * 2.0 ** -53)


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.5, 0.5]])
def test_shard_choice_is_the_highest_score(spark, weights):
    keys = [*range(-50, 400), 2**40, -2**62, None]
    df = spark.createDataFrame([(k, f"t{k}") for k in keys], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_records(df, weights, [*weights, 1.0]).collect()}
    best = lambda k, w: max(range(len(w)), key=lambda s: (score(s, k, w[s]), -s))
    assert got == {k: (best(k, weights), best(k, [*weights, 1.0])) for k in keys}


# ------------------------------------------------------------- search

def test_repeated_windows_make_no_pairs():
    k = 4000
    window = [f"w{i}".encode() for i in range(13)]
    text = b" ".join(window)
    block = decontaminate.Block([str(i) for i in range(k)], [text] * k, 13)
    begin = time.monotonic()
    tracemalloc.start()
    shard = decontaminate._Shard([b" ".join([text] * k), None, b"clean"])
    shard.search(block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert time.monotonic() - begin < 6 and peak < 300e6
    assert shard.hits() == [13 * k, 0, 0] and len(shard.items[0]) == k and shard.match[0][0] == 13


def longest(words, items, window=13):
    best = 0
    for item in items:
        for p in range(len(words)):
            for q in range(len(item)):
                n = 0
                while p + n < len(words) and q + n < len(item) and words[p + n] == item[q + n]:
                    n += 1
                if n >= window or n == len(item):
                    best = max(best, n)
    return best


def test_longest_matches():
    rng = random.Random(12)
    for trial in range(30):
        alphabet = [f"x{i}" for i in range(rng.choice([1, 2, 3, 40]))]
        word = lambda n: [rng.choice(alphabet) for _ in range(n)]
        items = [word(rng.choice([1, 3, 13, 14, 20, 40])) for _ in range(5)]
        docs = []
        for _ in range(6):
            d = []
            while len(d) < 60:
                it = rng.choice(items)
                a = rng.randint(0, len(it))
                d += it[a:a + rng.randint(1, 40)] + word(rng.randint(0, 2))
            docs.append(d)
        docs.append([])
        block = decontaminate.Block([str(i) for i in range(5)], [" ".join(i).encode() for i in items], 13)
        shard = decontaminate._Shard([" ".join(d).encode() for d in docs])
        shard.search(block)
        for d, (n, item, at, pos) in zip(docs, shard.match, strict=True):
            assert n == longest(d, items)
            if n:
                assert items[int(item)][at:at + n] == d[pos:pos + n]


def test_blocks_and_gathering_change_nothing(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda n: " ".join(f"v{rng.randint(0, 30)}" for _ in range(n))
    items = [(str(i), word(rng.choice([5, 13, 30]))) for i in range(40)]
    docs = [(i, word(20) + " " + items[i % 40][1] + " " + word(20)) for i in range(60)] + [(99, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string")
    want = {(r.doc_id, r.n_hit, r.n_items, r.items_sha256, r.longest_words) for r in decontaminate.contamination(d, b).collect()}
    real = decontaminate.stage_benchmark
    monkeypatch.setattr(decontaminate, "stage_benchmark", lambda x, **kw: real(x, **{**kw, "block_bytes": 300}))
    assert {(r.doc_id, r.n_hit, r.n_items, r.items_sha256, r.longest_words) for r in decontaminate.contamination(d, b).collect()} == want
    assert decontaminate.remove_contaminated(d, b).count() == sum(not (h > 0 and 20 * h >= 40 + len(docs[i][1].split()) - 40 if i < 60 else False) for i, h, *_ in want)


# ------------------------------------------------------------- archives, token files

def test_capture_times(spark):
    from datetime import UTC, datetime

    from figura.llm import warc
    times = [datetime(2020, 1, 1, tzinfo=UTC), datetime(1969, 12, 31, 23, 59, 59, tzinfo=UTC), datetime(2300, 5, 6, 7, 8, 9, tzinfo=UTC), None]
    pages = [(i, f"http://a.org/{i % 2}", f"<p>{i}", times[i % 4]) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, seen timestamp").repartition(4)
    got = warc.archive_pages(df, archive_bytes=20, fan_in=3, range_rows=4, ts=F.col("seen")).collect()
    stamp = lambda t: (t or datetime(1970, 1, 1, tzinfo=UTC)).strftime("%Y%m%d%H%M%S")
    assert {r.page_id: r.timestamp for r in got} == {i: stamp(t) for i, _, _, t in pages}
    order = [(r.url_key, r.timestamp, r.page_id) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order) and len(order) == 40
    ids = [0, 3_153_600_000, 3_153_600_001, 1 << 62, -5]
    late = warc.archive_pages(spark.createDataFrame([(i, "http://a.org", "") for i in ids], "page_id long, url string, html string"))
    assert [r.page_id for r in sorted(late.collect(), key=lambda r: r.position)] == sorted(ids)


def test_token_files_of_any_id_type(spark):
    from datetime import date
    from decimal import Decimal

    from figura.llm import wavelet
    from figura.llm.tokens import vocabulary
    path = vocabulary("word_bpe_49k.json")
    for kind, ids in (("date", [date(2020, 1, 2), date(1999, 1, 1), None]), ("decimal(12,3)", [Decimal("1.500"), Decimal("-2.000"), None]),
                      ("binary", [b"\x00b", b"a", None])):
        df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)] * 3, f"doc_id {kind}, text string").repartition(3)
        got = wavelet.token_files(df, path, shard_tokens=4).collect()
        plain = lambda i: repr(bytes(i) if isinstance(i, bytearray) else i)
        assert sorted(plain(r.doc_id) for r in got) == sorted(plain(i) for i in ids * 3)
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))
