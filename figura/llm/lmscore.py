"""Cross-entropy difference of documents under two matched n-gram models.

A target and a background bigram model share one vocabulary (all words of
either side, V of them) and one smoothing, and their counts are matched:
background counts are scaled by the ratio of the two token totals, so neither
model is sharper for having read more. With counts c, a token w after h costs
``log2(c(h) + a * V) - log2(c(h, w) + a)`` bits; the score of a document is the
mean over its tokens of target loss less background loss. Low scores look like
the target.

The loss is a sum of one term a context and one a bigram, each known from that
n-gram's own counts. So counting shuffles n-gram hashes (combined per chunk of
documents, packed), scoring sends a document's distinct n-grams to the shards
that hold their terms and adds up partial sums per chunk (packed; at most one
per n-gram that was asked). N-grams with a large share of
all tokens, a number bounded by that share, are scored where the document is;
those met once in the corpus and never in the target need no entry if the
background is the scored corpus itself (an n-gram that is asked but has no
entry was met there, once); a background of its own keeps them all. Counts
cover all data; models never reach the driver.

A sender tells ``2 ** FAN_BITS`` shards apart. With more shards than that, rows
go there in steps, as in a radix sort: first to the leading bits of the shard,
where the rows of many chunks are joined and cut by further bits, and partial
sums come back by the same steps. So a row stays about as long at any size,
and the number of rows grows with the n-grams, not with chunks times shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import stage, tasks

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
#: Bits of an n-gram's hash that are kept: 2 ** 40 n-grams share one by chance about once in 2 ** 17.
KEY_BITS = 56
#: Leading bits of the shard by which one step of the exchange parts its rows.
FAN_BITS = 9


def _levels(bits: int, fan: int) -> list[int]:
    """Leading bits known after each step of the way to ``bits``."""
    out = [min(bits, fan)]
    while out[-1] < bits:
        out.append(min(bits, out[-1] + fan))
    return out


def _group(chunk, bits: int):
    """The group of a chunk: its rows are joined with those of the same group."""
    h = (np.asarray(chunk).astype(np.uint64) * _MIX) >> np.uint64(36)
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def ngrams(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts (even) and bigrams (odd) of a text's lower-cased
    white-space words. The first word follows a start mark."""
    words = data.translate(_LOWER).split() if data else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    prev = np.concatenate([[_MIX], w[:-1]])
    x = (prev ^ (prev >> np.uint64(29))) * _MIX + w
    x = (x ^ (x >> np.uint64(32))) * _MIX
    drop = np.uint64(64 - KEY_BITS + 1)
    return (prev >> drop) << _ONE, ((x ^ (x >> np.uint64(29))) >> drop) << _ONE | _ONE


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences (which compress)."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return d.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpacked(data: bytes, dtype=np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list, list[np.ndarray], list[np.ndarray]]]:
    """Documents in chunks of about ``tokens`` words: ids, contexts, bigrams."""
    ids, ctx, big, held = [], [], [], 0
    for b in batches:
        for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c, g = ngrams(t.as_py())
            ids.append(doc)
            ctx.append(c)
            big.append(g)
            held += len(c) + 1
            if held >= tokens:
                yield ids, ctx, big
                ids, ctx, big, held = [], [], [], 0
    if ids:
        yield ids, ctx, big


def _by_shard(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Sorted keys cut by their top bits."""
    shard = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


_COUNTS = "shard int, grp int, target boolean, keys binary, counts binary"


def ngram_counts(texts: DataFrame, target: bool, bits: int, chunk_tokens: int, fan: int = FAN_BITS) -> DataFrame:
    """(shard, grp, target, keys, counts): packed counts, one row a chunk and
    shard, or leading bits of the shard if these are more than ``fan``."""
    first = _levels(bits, fan)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, (_, ctx, big) in enumerate(_chunks(batches, chunk_tokens)):
            keys, n = np.unique(np.concatenate(ctx + big), return_counts=True)
            rows = [(s, _packed(keys[at]), _planes(n[at].astype(np.uint32))) for s, at in _by_shard(keys, first)]
            if rows:
                s, k, c = zip(*rows, strict=True)
                grp = int(_group((part << 32) + seq, bits - first))
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array([grp] * len(s), pa.int32()), pa.array([target] * len(s)), pa.array(k), pa.array(c)],
                                                 names=["shard", "grp", "target", "keys", "counts"])

    return texts.mapInArrow(run, _COUNTS)


def _read_counts(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a row; counts of one chunk have four bytes, joined ones eight."""
    k = _unpacked(keys)
    return k, _from_planes(counts, np.uint32 if len(counts) == 4 * len(k) else np.int64).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def train(target: DataFrame, background: DataFrame, bits: int, chunk_tokens: int, least: int = 1, fan: int = FAN_BITS) -> DataFrame:
    """The two models, a row a shard: shard, keys, c_t and c_b (packed; without
    n-grams met less than ``least`` times in the background and never in the
    target), and the shard's totals: tokens of either side, words of the
    vocabulary."""
    counts = ngram_counts(target, True, bits, chunk_tokens, fan).unionAll(ngram_counts(background, False, bits, chunk_tokens, fan))
    n = tasks(target.sparkSession)

    def join(to: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t, mine in rows.groupby("target"):
                keys, c = _merge([_read_counts(k, x) for k, x in zip(mine["keys"], mine["counts"], strict=True)])
                grp = int(mine["grp"].iat[0]) & ((1 << bits - to) - 1)
                out += [(s, grp, bool(t), _packed(keys[at]), _planes(c[at])) for s, at in _by_shard(keys, to)]
            return pd.DataFrame(out, columns=["shard", "grp", "target", "keys", "counts"])
        return run

    for to in _levels(bits, fan)[1:]:
        counts = counts.repartition(max(n, 1 << bits), "shard", "grp").groupBy("shard", "grp").applyInPandas(join(to), _COUNTS)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = {}
        for t in (True, False):
            mine = rows[rows["target"] == t]
            side[t] = _merge([_read_counts(k, c) for k, c in zip(mine["keys"], mine["counts"], strict=True)])
        keys = np.union1d(side[True][0], side[False][0])
        c = {}
        for t, (k, n) in side.items():
            c[t] = np.zeros(len(keys), np.int64)
            c[t][np.searchsorted(keys, k)] = n
        context = keys & _ONE == 0
        rest = (c[False] >= least) | (c[True] > 0)
        return pd.DataFrame({
            "shard": [int(rows["shard"].iat[0])], "keys": [_packed(keys[rest])],
            "c_t": [_planes(c[True][rest])], "c_b": [_planes(c[False][rest])],
            "n_t": [int(c[True][context].sum())], "n_b": [int(c[False][context].sum())], "words": [int(context.sum())]})

    return stage(counts.repartition(max(n, 1 << bits) if bits else 1, "shard").groupBy("shard").applyInPandas(
        run, "shard int, keys binary, c_t binary, c_b binary, n_t bigint, n_b bigint, words bigint"), "lm-model")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, doc_id: str = "doc_id",
                             text: str = "text", add: float = 0.01, shard_bytes: int = 16 << 20,
                             chunk_tokens: int = 2_000_000, heavy: int = 1 << 17, fan: int = FAN_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and score, the mean of
    target loss less background loss in bits per token.

    ``background`` is ``docs`` unless given; n-grams of ``docs`` that a given
    background does not hold count as never met in it. Null, empty and wordless texts
    have no tokens and a null score. With an empty target, or an empty
    background, the other side's counts decide alone. Rows are scored one by one,
    whatever their ids. Other columns are ignored.
    """
    def texts(df: DataFrame) -> DataFrame:
        return df.select((F.col(doc_id) if doc_id in df.columns else F.lit(None)).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    own = background is None or background is docs
    background = docs if own else background
    read = texts(docs) if own else texts(docs).select("text").unionAll(texts(background).select("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0      # shards hold the model and the asked n-grams
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    unseen = 1 if own else 0                             # background count of an n-gram of docs without an entry
    levels = _levels(bits, fan)
    model = train(texts(target), texts(background), bits, chunk_tokens, unseen + 1, fan)
    total = model.agg(F.sum("n_t"), F.sum("n_b"), F.sum("words")).first()
    n_t, n_b, words = (int(x or 0) for x in total)
    scale = n_t / n_b if n_t and n_b else 1.0

    def terms(keys: np.ndarray, c_t: np.ndarray, c_b: np.ndarray) -> np.ndarray:
        """Target less background loss that a token has from an n-gram."""
        context = keys & _ONE == 0
        a = np.where(context, add * max(words, 1), add)
        return np.where(context, 1.0, -1.0) * (np.log2(c_t + a) - np.log2(c_b * scale + a))

    def load(keys, c_t, c_b):
        keys = _unpacked(keys)
        return keys, _from_planes(c_t, np.int64), _from_planes(c_b, np.int64)

    least = max(2, 2 * (n_t + n_b) // heavy)               # at most `heavy` n-grams are met so often

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, c_t, c_b = load(row["keys"], row["c_t"], row["c_b"])
                at = c_t + c_b >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(terms(keys[at], c_t[at], c_b[at]))], names=["key", "term"])

    hot = model.select("keys", "c_t", "c_b").mapInArrow(frequent, "key bigint, term double").toPandas()
    hot_keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot_keys)
    known = docs.sparkSession.sparkContext.broadcast((hot_keys[order], hot["term"].to_numpy(np.float64)[order]))
    kind = dict(texts(docs).dtypes)["doc_id"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk: its n-grams by shard, and a row (beyond the shards)
        with its documents' ids, token counts and sums of heavy n-grams."""
        hot_keys, hot_terms = known.value
        part = TaskContext.get().partitionId()
        for seq, (ids, ctx, big) in enumerate(_chunks(batches, chunk_tokens)):
            chunk = (part << 32) + seq                   # the same if the task runs again
            keys = np.concatenate([x for pair in zip(ctx, big, strict=True) for x in pair])
            sizes = np.array([len(c) for c in ctx], np.int64)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint32), 2 * sizes)
            sums = np.zeros(len(ids))
            if len(hot_keys) and len(keys):
                at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                is_hot = hot_keys[at] == keys
                sums = np.bincount(doc[is_hot], hot_terms[at[is_hot]], len(ids))
                keys, doc = keys[~is_hot], doc[~is_hot]
            home = (1 << bits) + xxhash.xxh32_intdigest(chunk.to_bytes(8)) % (1 << bits)
            yield _row(home, 0, chunk, sizes.tobytes(), sums.tobytes(), _ids_blob(ids, id_type))
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            grp = int(_group(chunk, bits - levels[0]))
            for s, at in _by_shard(keys, levels[0]):
                yield _row(s, grp, chunk, _packed(keys[at]), _planes(doc[at]), None)

    columns = ["shard", "grp", "chunk", "keys", "docs", "ids", "chunks"]
    kinds = "shard int, grp int, chunk bigint, keys binary, docs binary, ids binary, chunks binary"

    def _row(shard: int, grp: int, chunk: int, keys: bytes, docs: bytes, ids: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([grp], pa.int32()), pa.array([chunk], pa.int64()),
             *[pa.array([x], pa.binary()) for x in (keys, docs, ids, None)]], names=columns)

    def entries(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, documents and chunks of asking rows, of one chunk or joined."""
        parts = []
        for chunk, k, d, many in zip(rows["chunk"], rows["keys"], rows["docs"], rows["chunks"], strict=True):
            k = _unpacked(k)
            parts.append((k, _from_planes(d, np.uint32), np.full(len(k), chunk) if many is None else _from_planes(many, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def ask_on(to: int):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            if key[0] >= 1 << bits:
                return rows[columns]
            k, d, ch = entries(rows)
            order = np.argsort(k, kind="stable")
            k, d, ch = k[order], d[order], ch[order]
            grp = int(key[1]) & ((1 << bits - to) - 1)
            return pd.DataFrame([(s, grp, -1, _packed(k[at]), _planes(d[at]), None, _planes(ch[at])) for s, at in _by_shard(k, to)], columns=columns)
        return run

    def added(ch: np.ndarray, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of x by chunk and document, ascending."""
        order = np.lexsort((d, ch))
        ch, d, x = ch[order], d[order], x[order]
        first = np.flatnonzero(np.r_[True, (np.diff(ch) != 0) | (np.diff(d.astype(np.int64)) != 0)])
        return ch[first], d[first], np.add.reduceat(x, first)

    def back_to(level: int, shard: int, ch: np.ndarray, d: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        """Partial sums on their way to the chunks: rows for the groups of a level, or below the first for each chunk."""
        ch, d, x = added(ch, d, x)
        if level < 0:
            cuts = np.flatnonzero(np.r_[True, np.diff(ch) != 0, True])
            rows = [(0, 0, int(ch[a]), _packed(d[a:b]), x[a:b].tobytes(), None, None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        else:
            grp = _group(ch, bits - levels[level])
            rows = [(shard >> levels[min(level + 1, len(levels) - 1)] - levels[level], int(g), -1, _planes(d[at]), x[at].tobytes(), None, _planes(ch[at]))
                    for g in np.unique(grp) for at in (np.flatnonzero(grp == g),)]
        return pd.DataFrame(rows, columns=columns)

    def back_on(level: int):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            if key[0] >= 1 << bits:
                return rows[columns]
            ch, d, x = (np.concatenate([f(v) for v in rows[c]]) for c, f in
                        (("chunks", lambda v: _from_planes(v, np.int64)), ("keys", lambda v: _from_planes(v, np.uint32)), ("docs", np.frombuffer)))
            return back_to(level - 1, int(key[0]), ch, d, x)
        return run

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(texts(docs).schema["doc_id"].dataType)
    asked = texts(docs).mapInArrow(ask, kinds)
    n = max(tasks(docs.sparkSession), 2 << bits)
    for to in levels[1:]:
        asked = asked.repartition(n, "shard", "grp").groupBy("shard", "grp").applyInPandas(ask_on(to), kinds)

    def answer(key, asks: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        """The chunks' own rows as they are; for n-grams, the documents of the
        chunk that have some (keys) and what they add up to (docs)."""
        if key[0] >= 1 << bits or not len(asks):
            return asks[columns]
        if len(shard):
            keys, c_t, c_b = load(*shard[["keys", "c_t", "c_b"]].iloc[0])
        else:
            keys, c_t, c_b = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        term, out = terms(keys, c_t, c_b), []

        def worth(k: np.ndarray) -> np.ndarray:
            x = terms(k, np.zeros(len(k)), np.full(len(k), unseen))    # never in the target
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                x = np.where(keys[at] == k, term[at], x)
            return x

        if len(levels) > 1:
            k, d, ch = entries(asks)
            return back_to(len(levels) - 2, int(key[0]), ch, d, worth(k))
        for chunk, k, d in zip(asks["chunk"], asks["keys"], asks["docs"], strict=True):
            k, d = _unpacked(k), _from_planes(d, np.uint32)
            x = worth(k)
            here, d = np.unique(d, return_inverse=True)
            out.append((0, 0, chunk, _packed(here), np.bincount(d, x, len(here)).tobytes(), None, None))
        return pd.DataFrame(out, columns=columns)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["ids"].notna()].iloc[0]
        sizes, sums = np.frombuffer(own["keys"], np.int64), np.frombuffer(own["docs"]).copy()
        for k, d in rows.loc[rows["ids"].isna(), ["keys", "docs"]].itertuples(index=False):
            sums[_unpacked(k, np.uint32)] += np.frombuffer(d)
        with np.errstate(invalid="ignore"):
            return pd.DataFrame({"doc_id": _ids_list(own["ids"]), "n_tokens": sizes, "score": np.where(sizes > 0, sums / sizes, np.nan)})

    parts = (asked.repartition(n, "shard").groupBy("shard")
             .cogroup(model.select("shard", "keys", "c_t", "c_b").repartition(n, "shard").groupBy("shard"))
             .applyInPandas(answer, kinds))
    for level in range(len(levels) - 2, -1, -1):
        parts = parts.repartition(n, "shard", "grp").groupBy("shard", "grp").applyInPandas(back_on(level), kinds)
    return (parts.repartition(n, "chunk").groupBy("chunk").applyInPandas(total, f"doc_id {kind}, n_tokens bigint, score double")
            .withColumn("score", F.when(F.col("n_tokens") > 0, F.col("score"))))


def _ids_blob(ids: list, kind: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids, kind)], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ids_list(data: bytes) -> list:
    return pa.ipc.open_stream(data).read_all()["id"].to_pylist()
