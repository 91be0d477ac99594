"""SimHash near-duplicates found with BK-trees.

64-bit fingerprints of word shingles are reduced to the distinct ones. Two
that differ in at most r bits agree in at least ``blocks - r`` of ``blocks``
bit blocks, so every choice of that many blocks makes a table of shards, and
linked fingerprints share a shard in some table. Each shard gets a BK-tree
(children keyed by their integer Hamming distance to the parent) and searches
follow only the edges whose key is within the radius of the query's distance.

A shard whose tree would pass ``tree_size`` nodes is dealt again by blocks of
the bits it leaves open. What stays above that has its fingerprints close
together: it is cut into trees of that size at most and its queries into as
many blocks, and each tree goes to each block of queries. So no tree, task or
message grows with a hot group, and no link is lost. A task returns a spanning
forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import drop_staged, stage, tasks
from figura.llm.components import components

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
LEAF = 32


def fingerprint(data: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half of the
    XXH64 values of its word shingles; 0 without words."""
    words = data.translate(_LOWER).split() if data else []
    if not words:
        return 0
    text, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    stops = ends[shingle - 1:].tolist()
    starts = [0, *(ends[:n - shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(stops)
    for at in range(0, total, 1 << 16):                  # bounded memory for very long texts
        h = np.array([digest(text[i:j], seed) for i, j in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp, h): fp as a signed 64-bit number, h a hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], names=["doc_id", "fp", "h"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint, h bigint")


class BKTree:
    """BK-tree over distinct 64-bit values, in arrays.

    A node is a value with child edges keyed by Hamming distance; subtrees of
    ``LEAF`` values or fewer stay lists. ``links`` searches many queries at
    once: they go down together, each along the edges within the radius.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root = self._build(np.arange(len(values)))

    def _build(self, at: np.ndarray):
        # an explicit stack: chains of equal distances can be long
        root: list = []
        todo = [(at, root, None)]
        while todo:
            at, home, key = todo.pop()
            if len(at) <= LEAF:
                home.append((key, at, None))
                continue
            edges: list = []
            home.append((key, at[:1], edges))
            d = np.bitwise_count(self.values[at[1:]] ^ self.values[at[0]])
            order = np.argsort(d, kind="stable")
            d, rest = d[order], at[1:][order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for part, k in zip(np.split(rest, cuts), d[np.concatenate([[0], cuts])], strict=True):
                todo.append((part, edges, int(k)))
        return root[0]

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, node index) within the radius, piece by piece."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (_, at, edges), q = todo.pop()
            if not len(at) or not len(q):
                continue
            if edges is None:
                for i in range(0, len(q), 1 << 14):
                    part = q[i:i + (1 << 14)]
                    x, y = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.values[at][None, :]) <= radius)
                    yield part[x], at[y]
                continue
            d = np.bitwise_count(queries[q] ^ self.values[at[0]]).astype(np.int64)
            near = q[d <= radius]
            yield near, np.repeat(at, len(near))
            for edge in edges:
                todo.append((edge, q[np.abs(d - edge[0]) <= radius]))


def _forest(n: int, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Edges that join separate sets, from index pairs over 0..n-1."""
    root = np.arange(n)
    for a, b in pieces:
        while True:
            ra, rb = root[a], root[b]
            rest = ra != rb
            if not rest.any():
                break
            a, b, ra, rb = a[rest], b[rest], ra[rest], rb[rest]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            high, first = np.unique(high, return_index=True)
            yield from zip(a[first].tolist(), b[first].tolist(), strict=True)
            root[high] = low[first]
            while (root[root] != root).any():
                root = root[root]


def _masks(bits: int, radius: int, blocks: int) -> list[int]:
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _narrower(mask: int, radius: int, bits: int = 64) -> list[int]:
    """``mask`` with one more block of agreeing bits each: the other bits are
    cut into ``radius + 1`` blocks, of which two fingerprints that agree in
    ``mask`` and differ in ``radius`` bits at most have one in common."""
    free = [b for b in range(bits) if not mask >> b & 1]
    if len(free) <= radius:
        return []
    edges = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def links(fps: DataFrame, radius: int = 4, tree_size: int = 4096, blocks: int | None = None, levels: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect
    exactly those within ``radius`` bits, directly or over others.

    ``blocks`` (default by the number of fingerprints, so that a shard of
    random fingerprints stays below a tree) changes the work only. A shard
    above ``tree_size`` is dealt again by ``radius + 1`` blocks of the bits
    that it leaves open, up to ``levels`` times; what is still above it has
    its fingerprints close together and is cut.
    """
    spark = fps.sparkSession
    if blocks is None:
        n = fps.count()
        blocks = radius + 1
        while blocks < radius + 4 and n / 2.0 ** (64 * (blocks - radius) // blocks) > tree_size / 2:
            blocks += 1
    masks = _masks(64, radius, blocks)
    level = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("t")).withColumn("key", F.col("fp").bitwiseAND(F.col("t")))
    settled: list[DataFrame] = []
    for _ in range(levels):
        hot = stage(level.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_size).select("t", "key"), "hot-shards")
        masks = sorted({m & ((1 << 64) - 1) for m in (r.t for r in hot.select("t").distinct().collect())})     # masks, not data: a few thousand
        nxt = {m: _narrower(m, radius) for m in masks}
        if not any(nxt.values()):
            break
        finer = spark.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in nxt.items() if xs], "t long, finer array<long>")
        hot = hot.join(F.broadcast(finer.select("t")), "t")
        settled.append(level.join(hot, ["t", "key"], "left_anti"))
        again = level.join(hot, ["t", "key"], "left_semi").join(F.broadcast(finer), "t")
        level = stage(again.select("fp", F.explode("finer").alias("t")).distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("t"))), "finer-shards")
    keyed = level
    for x in settled:
        keyed = keyed.unionByName(x)
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = stage(sizes.where(F.col("n") > tree_size).select("t", "key", F.ceil(F.col("n") / tree_size).cast("int").alias("cuts")), "hot-shards")
    rows = keyed.join(hot, ["t", "key"], "left").select(
        "t", "key", "fp", F.coalesce("cuts", F.lit(1)).alias("cuts"),
        F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1))).cast("int").alias("part"))
    # a cut shard: part i meets part j >= i once, in task (i, j)
    ends = F.when(F.col("cuts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1),
                    lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j"))))
    rows = rows.withColumn("ij", F.explode(ends)).select("t", "key", "ij.i", "ij.j", "part", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def work(t: pd.DataFrame) -> pd.DataFrame | None:
            out: list[tuple[int, int]] = []
            vals = t["fp"].to_numpy().view(np.uint64)
            cols = t[["t", "key", "i", "j"]].to_numpy()
            cut = np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1
            for a, b in zip([0, *cut], [*cut, len(t)], strict=True):
                if b - a < 2:
                    continue
                v, part = vals[a:b], t["part"].to_numpy()[a:b]
                i, j = cols[a, 2], cols[a, 3]
                node = np.flatnonzero(part == i) if i != j else np.arange(b - a)
                query = np.flatnonzero(part == j) if i != j else node
                tree = BKTree(v[node])
                pairs = ((query[q], node[x]) for q, x in tree.links(v[query], radius))
                out.extend((int(t["fp"].iat[a + x]), int(t["fp"].iat[a + y])) for x, y in _forest(b - a, pairs))
            return pd.DataFrame(out, columns=["a", "b"]) if out else None

        for b in batches:
            last = b[["t", "key", "i", "j"]].iloc[-1]
            whole = (b[["t", "key", "i", "j"]] == last).all(axis=1)
            if not whole.all():                          # the last group may go on in the next batch
                held.append(b[~whole])
                if (got := work(pd.concat(held))) is not None:
                    yield got
                held = []
            elif held and not (held[-1][["t", "key", "i", "j"]].iloc[-1] == last).all():
                if (got := work(pd.concat(held))) is not None:
                    yield got
                held = []
            held.append(b[whole])
        if held and (got := work(pd.concat(held))) is not None:
            yield got

    return (rows.repartition(tasks(fps.sparkSession), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
            .mapInPandas(search, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id",
                    text: str = "text", tree_size: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), h (hash of the text),
    component (label of its group of linked fingerprints) and component_id,
    the smallest doc_id of the group (null if the group has null ids only).

    Null, empty and wordless texts have fingerprint zero and are linked like
    any other. Equal fingerprints are one node, so copies and repeated rows
    cost one row. Other columns of ``docs`` are ignored.
    """
    prints = stage(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    edges = links(nodes.select("fp"), radius, tree_size)
    labels = components(edges)
    named = stage(nodes.join(labels, nodes.fp == labels.node, "left")
                  .select("fp", F.coalesce("label", "fp").alias("component"), "first"), "fp-components")
    drop_staged(nodes, labels)
    groups = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = stage(named.select("fp", "component").join(groups, "component"), "fp-groups")
    drop_staged(named)
    return prints.join(table, "fp")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text",
             tree_size: int = 4096) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id
    (null behind all), of those with this id that with the smallest text hash,
    and of rows that agree in both that with the smallest hash of the whole
    row. Columns are unchanged, whatever their names.
    """
    found = near_duplicates(docs, shingle, radius, doc_id, text, tree_size)
    rows = found.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("k"))
    kept = stage(first.select(F.col("k.doc_id").alias("kid"), F.col("k.h").alias("kh"), F.col("k.n").alias("n")), "kept-rows")
    drop_staged(found)
    # `docs` may be any plan: its rows are told apart by id and text, and travel as one column
    t = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"))
    same = F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh"))
    once = t.join(kept.where("n = 1"), same, "left_semi").select("row")
    if not kept.where("n > 1").isEmpty():
        again = t.join(kept.where("n > 1"), same, "left_semi")
        once = once.unionByName(again.groupBy("id", "h").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row"))
    return once.select([F.col("row")[c].alias(c) for c in docs.columns])
