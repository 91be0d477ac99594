"""Document vectors inferred against frozen word vectors.

A text's vector is fitted so that it predicts the text's words and not the
noise words: gradient steps on ``sum of log sigmoid(d . word)`` over its words
plus ``negative`` times the mean of ``log sigmoid(- d . noise)`` per word, with
a rate that falls linearly. The noise is a fixed pool of word vectors and enters
by its mean, so nothing is drawn at random on the way: the result depends on
the text and the seed only, not on batches, partitions or repeated runs.

Texts are fitted by array arithmetic in Arrow batches; word vectors are looked
up for many texts at a time, read in blocks (``product``) and never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from figura.functions.hashing import md5_int
from figura.operators import product

TOKENS = 50_000     # tokens of the texts whose words are looked up together


def noise_pool(vectors: DataFrame, key: str, vector: str, size: int = 64, seed: int = 0) -> np.ndarray:
    """``size`` vectors of the table, those whose keys have the smallest seeded
    hashes (a bounded number, which is all that reaches the driver)."""
    rows = (vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
            .select(md5_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("h"), F.col(key).cast("string").alias("k"),
                    F.col(vector).alias("v")).orderBy("h", "k").limit(size).select("v").collect())
    return np.array([r.v for r in rows], np.float64)


def _start(tokens: list, dim: int, seed: int) -> np.ndarray:
    """A small vector that the text and the seed decide."""
    h = zlib.crc32("\0".join(map(str, tokens)).encode(), seed)
    return (np.random.default_rng(h).random(dim) - 0.5) / dim


def fit(start: np.ndarray, doc: np.ndarray, word: np.ndarray, count: np.ndarray, table: np.ndarray, noise: np.ndarray, steps: int,
        alpha: float, min_alpha: float, negative: int) -> np.ndarray:
    """Vectors of texts from ``start``; entry i says that text ``doc[i]``
    (ascending) has word ``word[i]`` of ``table`` ``count[i]`` times.

    The rate of a step is ``alpha`` per word, at most that of guaranteed
    descent. A text without words keeps zeros. Texts are fitted one after
    another: a text's words stay in the processor's cache through its steps."""
    d = start.copy()
    n = np.bincount(doc, count, len(d))
    d[n == 0] = 0.0
    if not len(doc):
        return d
    first = np.flatnonzero(np.r_[True, np.diff(doc) > 0])
    loudest = np.square(noise).sum(1).max(initial=1e-12)
    sigmoid = lambda x: 0.5 * (1 + np.tanh(x / 2))
    for at, end in zip(first, [*first[1:], len(doc)], strict=True):
        i, u, times = doc[at], table[word[at:end]], count[at:end]
        most = 4.0 / ((1 + negative) * max(np.square(u).sum(1).max(), loudest))
        x = d[i]
        for t in range(steps):
            rate = min((alpha - (alpha - min_alpha) * t / max(steps - 1, 1)) * n[i], most)
            step = (times * (1 - sigmoid(u @ x))) @ u / n[i]
            if len(noise):
                step -= negative * sigmoid(noise @ x) @ noise / len(noise)
            x = x + rate * step
        d[i] = x
    return d


def infer_vectors(docs: DataFrame, key: str, tokens: str, files: list[str], noise: np.ndarray, dim: int, name: str = "vector",
                  steps: int = 1000, alpha: float = 0.01, min_alpha: float = 0.0001, negative: int = 5, seed: int = 0) -> DataFrame:
    """``(key, name)``, a row per row of ``docs``: the vector inferred from the
    keys in the array ``tokens``. Keys without a vector, null included, are
    passed over; a text without known words, null included, gets zeros."""
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        enc = lists.flatten().dictionary_encode()
        codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.full(len(enc.dictionary) + 1, -1, np.int64)
        parts, have = [np.zeros((0, dim))], 0
        for uri in files:
            keys, block = product.load_block(uri)
            if not len(keys) or not len(enc.dictionary):
                continue
            at = pc.fill_null(pc.index_in(enc.dictionary.cast(keys.type), value_set=keys), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(at >= 0)
            row[hit] = have + np.arange(len(hit))
            parts.append(block[at[hit]])
            have += len(hit)
        word = row[codes]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        known = word >= 0
        pair, count = np.unique(doc[known] * max(have, 1) + word[known], return_counts=True)
        start = np.array([_start(x or [], dim, seed) for x in lists.to_pylist()]).reshape(len(lengths), dim)
        got = fit(start, pair // max(have, 1), pair % max(have, 1), count.astype(float), np.concatenate(parts), noise, steps, alpha, min_alpha, negative)
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * dim, pa.int32()), pa.array(got.ravel(), pa.float32()))
        return pa.RecordBatch.from_arrays([b.column(0), out], names=[key, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, min(at + 4096, int(np.searchsorted(ends, before + TOKENS, "right"))))
                yield work(b.slice(at, to - at))
                at = to

    schema = StructType([StructField(key, docs.schema[key].dataType), StructField(name, ArrayType(FloatType()))])
    return docs.select(key, tokens).mapInArrow(run, schema)
