"""Benchmark decontamination with suffix arrays of the training text.

A shard is one Arrow batch of documents (bounded by rows and bytes). Its word
sequence gets a suffix array, built for the shard and searched with every
benchmark suffix by binary search. The array is sparse: suffixes whose first
two words open no benchmark suffix, which no search can meet, are left out,
and its order looks at the ``window`` words that decide a hit. Equal windows
are searched once and carry the list of their texts, so neither a window that
many items share nor one that a document repeats makes pairs. Hit stretches
and the texts they met are then ordered together (``Block.longest``), which
gives the longest verbatim matches and where they are.

The benchmark is staged in blocks of bounded size. Tasks read them one after
another from the shared folder, so its size may grow with no broadcast and
nothing on the driver; documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import folder, open_fs, write_file

WINDOW = 13
#: Lower-cases A-Z and turns [\x00-\x2F\x3A-\x60\x7B-\x7F] (after that) into spaces.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_TABLE).split() if data else []


class Block:
    """A block of benchmark items, ready to search with.

    Equal items are one text with several ids. ``keys`` are the different
    windows: of a text of n words, those at 0..n-window, or its only one if
    n < window. Windows with the same texts share one list of them.
    """

    def __init__(self, item_ids: list, texts: list[bytes], window: int):
        self.window, self.vocab = window, {}
        ids: dict[tuple, list] = {}
        for item, text in zip(item_ids, texts, strict=True):
            if w := words_of(text):
                ids.setdefault(tuple(self.vocab.setdefault(x, len(self.vocab) + 1) for x in w), []).append(item)
        self.texts = [np.array(s, np.int32) for s in ids]
        self.item_ids = list(ids.values())
        keys, spans, owner, place = [], [], [], []
        for i, s in enumerate(self.texts):
            n = min(window, len(s))
            pad = np.concatenate([s, np.zeros(window - n, np.int32)])
            many = len(s) - n + 1
            keys.append(np.lib.stride_tricks.sliding_window_view(pad, window)[:many])
            spans.append(np.full(many, n))
            owner.append(np.full(many, i))
            place.append(np.arange(many))
        keys = np.concatenate(keys) if keys else np.zeros((0, window), np.int32)
        spans, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (spans, owner, place))
        _, first, self.named = np.unique(_packed(keys), return_index=True, return_inverse=True)
        self.named = self.named.ravel()
        self.keys, self.span, self.owner, self.place = keys[first], spans[first], owner[first], place[first]
        pair = np.unique(self.named * max(len(self.texts), 1) + owner)
        lists: dict[bytes, int] = {}
        self.list_of = np.zeros(len(first), np.int64)
        self.lists: list[np.ndarray] = []
        which = pair // max(len(self.texts), 1)
        for k, own in enumerate(np.split(pair % max(len(self.texts), 1), np.flatnonzero(np.diff(which)) + 1) if len(pair) else []):
            at = lists.setdefault(own.tobytes(), len(lists))
            if at == len(self.lists):
                self.lists.append(own)
            self.list_of[k] = at
        v = len(self.vocab) + 1
        head = self.keys[:, 0].astype(np.int64)
        self.singles = np.zeros(v, bool)                 # one-word windows: any suffix with that word
        self.singles[head[self.span == 1]] = True
        self.pairs = np.unique((head * v + self.keys[:, 1])[self.span > 1]) if window > 1 else np.empty(0, np.int64)
        self.low = _packed(self.keys)
        high = self.keys.copy()
        high[np.arange(window)[None, :] >= self.span[:, None]] = np.iinfo(np.int32).max
        self.high = _packed(high)

    def search(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) pairs: where which of the block's different
        windows occurs in ``seq`` (word ids, 0 for words that no item has). A
        position begins at most one window of each length, so there are at
        most ``window`` pairs a position, whatever repeats on either side."""
        none = np.empty(0, np.int64)
        if not len(self.texts) or not len(seq):
            return none, none
        v = len(self.vocab) + 1
        pad = np.zeros(len(seq) + self.window, np.int32)
        pad[:len(seq)] = seq
        wide = pad.astype(np.int64)
        pair = wide[:len(seq)] * v + wide[1:len(seq) + 1]
        ok = (wide[:len(seq)] > 0) & (wide[1:len(seq) + 1] > 0)
        spot = np.flatnonzero(ok)
        if len(self.pairs):
            k = np.searchsorted(self.pairs, pair[spot])
            ok[spot] = self.pairs[np.minimum(k, len(self.pairs) - 1)] == pair[spot]
        else:
            ok[:] = False
        suffixes = np.flatnonzero(ok | self.singles[wide[:len(seq)]])
        if not len(suffixes):
            return none, none
        keys = _packed(pad[suffixes[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")          # the suffix array
        suffixes, keys = suffixes[order], keys[order]
        lo = np.searchsorted(keys, self.low, "left")
        hi = np.searchsorted(keys, self.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        pos = suffixes[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return pos, which

    def longest(self, seq: np.ndarray, pos: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every position hit: the length of the longest match with any
        text that begins there, and the text and word where it is found.

        Hit stretches of ``seq`` and the texts met are ordered together by
        prefix doubling; a position's longest match is its common prefix with
        the nearest text suffix before or behind it, which the doubling's
        ranks measure by halving steps. Linear rows, a sort per doubling.
        """
        met = np.unique(np.concatenate([self.lists[k] for k in np.unique(self.list_of[which])]))
        span = self.span[which]
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + span, -1)
        cover = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        stretch = np.flatnonzero(np.r_[True, np.diff(cover) > 1])
        stop = len(self.vocab) + 1                       # separators are all different: no match crosses one
        parts, at, where = [], [], []
        for piece in np.split(cover, stretch[1:]):
            parts += [seq[piece].astype(np.int64), [stop]]
            at += [piece, [-1]]
            stop += 1
        doc_end = sum(len(p) for p in parts)
        for t in met:
            n = len(self.texts[t])
            parts += [self.texts[t].astype(np.int64), [stop]]
            at.append(np.append(np.arange(n), -1))
            where.append(np.full(n + 1, t))
            stop += 1
        at, text = np.concatenate(at), np.concatenate([np.full(doc_end, -1), *where])
        name = np.unique(np.concatenate(parts), return_inverse=True)[1].ravel()
        levels, have = [name], 1
        while True:                                      # names of 1, 2, 4, ... words, in the order of the words
            behind = np.append(name[have:], np.full(min(have, len(name)), -1)) + 1
            name = np.unique(name.astype(np.int64) * (len(name) + 1) + behind[:len(name)], return_inverse=True)[1].ravel()
            have *= 2
            levels.append(name)
            if not np.isin(name[:doc_end], name[doc_end:]).any():
                break
        order = np.argsort(name, kind="stable")
        is_text = order >= doc_end
        index = np.arange(len(order))
        before = np.maximum.accumulate(np.where(is_text, index, -1))
        behind = np.minimum.accumulate(np.where(is_text, index, len(order))[::-1])[::-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = index
        place = np.full(len(seq), -1)
        place[at[:doc_end][at[:doc_end] >= 0]] = np.flatnonzero(at[:doc_end] >= 0)
        me = place[pos]
        best, spot = np.zeros(len(me), np.int64), np.full(len(me), -1)
        for near in (before[rank[me]], behind[rank[me]]):
            ok = (near >= 0) & (near < len(order))
            a, b = me[ok].copy(), order[near[ok]].copy()
            start, size = b.copy(), np.zeros(len(a), np.int64)
            for k in range(len(levels) - 1, -1, -1):
                inside = (a < len(name)) & (b < len(name))
                same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
                size[same] += 1 << k
                a[same] += 1 << k
                b[same] += 1 << k
            better = np.flatnonzero(ok)[size > best[ok]]
            spot[better], best[better] = start[size > best[ok]], size[size > best[ok]]
        return best, text[spot], at[spot]


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that compare as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">i4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


class _Shard:
    """Documents under search, and what was found in the blocks so far."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = texts
        self.sizes = None
        self.items: list[set] = [set() for _ in texts]
        self.match: list[tuple] = [(0, None, None, None)] * len(texts)

    def words(self) -> list[list[bytes]]:
        """The documents' words, cut anew each time: they take far more room than the texts."""
        docs = [words_of(t) for t in self.texts]
        if self.sizes is None:
            self.sizes = np.array([len(d) for d in docs], np.int64)
            self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)   # a 0 after each document: no match crosses
            self.covered = np.zeros(int((self.sizes + 1).sum()) + 1, np.int64)
        return docs

    def search(self, block: Block, details: bool = True) -> None:
        docs = self.words()
        seq = np.zeros(len(self.covered) - 1, np.int32)
        get = block.vocab.get
        for s, d in zip(self.starts, docs, strict=True):
            if d:
                seq[s:s + len(d)] = [get(w, 0) for w in d]
        del docs
        pos, which = block.search(seq)
        if not len(pos):
            return
        span = block.span[which]
        np.add.at(self.covered, pos, 1)
        np.add.at(self.covered, pos + span, -1)
        if not details:
            return
        doc = np.searchsorted(self.starts, pos, "right") - 1
        lists = np.unique(doc * max(len(block.lists), 1) + block.list_of[which])
        for d, k in zip((lists // len(block.lists)).tolist(), (lists % len(block.lists)).tolist(), strict=True):
            for t in block.lists[k]:
                self.items[d].update(block.item_ids[t])
        # the longest of each document: windows of whole short items, and longer matches of whole windows
        size, text, word = block.longest(seq, pos, which)
        long = (size >= block.window) & (span == block.window)
        size = np.where(long, size, span)
        text, word = np.where(long, text, block.owner[which]), np.where(long, word, block.place[which])
        o = np.lexsort((pos, -size, doc))
        for k in o[np.r_[True, np.diff(doc[o]) > 0]].tolist():
            d = int(doc[k])
            if size[k] > self.match[d][0]:
                self.match[d] = (int(size[k]), block.item_ids[text[k]][0], int(word[k]), int(pos[k] - self.starts[d]))

    def hits(self) -> list[int]:
        """Words inside a benchmark window, per document."""
        before = np.concatenate([[0], np.cumsum(np.cumsum(self.covered[:-1]) > 0)])
        return (before[self.starts + self.sizes] - before[self.starts]).tolist() if self.texts else []


def stage_benchmark(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                    block_bytes: int = 4 << 20) -> list[str]:
    """Write the benchmark in blocks of about ``block_bytes`` (an item is
    never split) and return their files. Only file names reach the driver."""
    out = folder(benchmark.sparkSession, "benchmark")
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"),
                            F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        kept, held = [], 0

        def flush():
            nonlocal kept, held
            path = f"{out}/block-{uuid.uuid4().hex}.parquet"
            buf = io.BytesIO()
            pq.write_table(pa.Table.from_batches(kept), buf)
            write_file(path, buf.getvalue())
            kept, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        for b in batches:
            for row in range(b.num_rows):
                kept.append(b.slice(row, 1))
                held += len(b.column(1)[row].as_py())
                if held >= block_bytes:
                    yield flush()
        if kept:
            yield flush()

    files = rows.repartition(max(1, n)).mapInArrow(run, "path string")
    return sorted(r.path for r in files.collect())


def _block(path: str, window: int) -> Block:
    """A block of the staged benchmark, kept by the worker that parsed it."""
    if (path, window) not in _HELD:
        fs, p = open_fs(path)
        t = pq.read_table(p, filesystem=fs)
        _HELD.clear()                                    # a worker keeps one block at most
        _HELD[path, window] = Block(t["item_id"].to_pylist(), t["text"].to_pylist(), window)
    return _HELD[path, window]


def _searched(batches: Iterator[tuple[pa.RecordBatch, list]], files: list[str], window: int,
              details: bool = True) -> Iterator[tuple[pa.RecordBatch, _Shard]]:
    """Batches with their finished shards. Documents are gathered up to
    ``_GATHER`` bytes and then meet each block once, so a block is parsed once
    per so many bytes of documents however many blocks there are."""
    held, size = [], 0

    def work():
        for path in files:
            block = _block(path, window)
            for _, shard in held:
                shard.search(block, details)
        files.reverse()                                  # begin the next round with the block still at hand
        for _, shard in held:
            if shard.sizes is None:
                shard.words()
        return held
    for b, texts in batches:
        held.append((b, _Shard(texts)))
        size += sum(len(t) for t in texts if t)
        if size >= _GATHER:
            yield from work()
            held, size = [], 0
    yield from work()


_GATHER = 24 << 20
_HELD: dict[tuple, Block] = {}
_RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
           "longest_words", "longest_item", "longest_item_word", "longest_doc_word")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit (words inside a benchmark
    window), n_items and items_sha256 (items met), contaminated (n_hit > 0 and
    at least one word in ``share``), and the longest verbatim match (the
    first in the document of equally long ones) with an item that has it and
    the word offsets in item and document.

    Null or empty texts have no words and are clean. Items without words are
    skipped; items with a null id count as hits but are not listed; repeated
    items count once by id. An empty benchmark leaves every document clean.
    """
    files = stage_benchmark(benchmark, text=text) if benchmark is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = ((b, b.column(1).to_pylist()) for whole in batches for b in _bounded(whole, 1))
        for b, shard in _searched(cuts, list(files), window):
            n, hit = shard.sizes.tolist(), shard.hits()
            listed = [sorted(x for x in s if x is not None) for s in shard.items]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(s) for s in listed], pa.int64()),
                pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in listed]),
                pa.array([h > 0 and share * h >= w for h, w in zip(hit, n, strict=True)], pa.bool_()),
                *[pa.array([x[k] for x in shard.match], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            ], names=list(_RESULT))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
                                "contaminated boolean, longest_words bigint, longest_item string, "
                                "longest_item_word bigint, longest_doc_word bigint")


def _bounded(b: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a column each."""
    first, held = 0, 0
    sizes = pc.binary_length(b.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n
    if b.num_rows > first:
        yield b.slice(first)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                        share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents; columns unchanged, no shuffle."""
    files = stage_benchmark(benchmark, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cuts():
            for whole in batches:
                k = whole.schema.get_field_index(text)
                data = whole.column(k).cast(pa.large_binary() if pa.types.is_large_string(whole.schema.field(k).type) else pa.binary())
                for b in _bounded(whole.set_column(k, text, data), k):
                    yield b.set_column(k, text, b.column(k).cast(whole.schema.field(k).type)), b.column(k).to_pylist()
        for b, shard in _searched(cuts(), list(files), window, details=False):
            clean = [not (h > 0 and share * h >= w) for h, w in zip(shard.hits(), shard.sizes.tolist(), strict=True)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
