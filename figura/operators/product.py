"""Sparse x dense: documents' token counts times a table of vectors.

The vector table is written once in blocks of ``BLOCK`` rows to the shared
folder. Tasks keep their documents and go through the blocks in turn, adding
each block's share to their documents' sums, so that neither tokens nor
vectors are shuffled: what leaves a task is one vector per document. A task
holds one chunk of documents (``TOKENS`` tokens and ``SUMS`` numbers of sums,
or one document) and the blocks it met last (``HELD`` numbers).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from figura.session import shared_path
from figura.sources.files import locate

BLOCK = 16_384
SUMS = 1_000_000
HELD = 16_000_000
TOKENS = 400_000

_blocks: OrderedDict[str, tuple[pa.Array, np.ndarray]] = OrderedDict()     # this worker's blocks


def stage_blocks(vectors: DataFrame, key: str, vector: str, block: int = BLOCK) -> list[str]:
    """Files of a vector table, ``block`` rows each on average, null vectors
    left out. A key is in one block."""
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    n = rows.count()
    path = shared_path(vectors.sparkSession, "vector-blocks")
    rows.repartition(max(1, -(-n // block)), "k").write.parquet(path)
    return sorted(vectors.sparkSession.read.parquet(path).inputFiles())


def load_block(uri: str) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of a block, kept by the worker that read it."""
    if uri in _blocks:
        _blocks.move_to_end(uri)
        return _blocks[uri]
    fs, path = locate(uri)
    t = pq.read_table(path, filesystem=fs).combine_chunks()
    keys = t.column("k").combine_chunks() if t.num_rows else pa.array([], t.schema.field("k").type)
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, np.float32)
    _blocks[uri] = keys, flat.reshape(t.num_rows, -1).astype(np.float32) if t.num_rows else np.zeros((0, 0))
    while len(_blocks) > 1 and sum(v.size for _, v in _blocks.values()) > HELD:
        _blocks.popitem(last=False)
    return _blocks[uri]


def _multiply(keys: pa.Array, weights: np.ndarray | None, lengths: np.ndarray, files: list[str], dim: int) -> np.ndarray:
    """Sums of the vectors of each document's keys: documents x dim."""
    sums = np.zeros((len(lengths), dim))
    if not len(keys):
        return sums
    enc = keys.dictionary_encode()
    codes = enc.indices.fill_null(len(enc.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(enc.dictionary) + 1
    pair, where = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + codes, return_inverse=True)
    count = np.bincount(where.ravel(), weights=weights, minlength=len(pair)).astype(float)
    doc, code = pair // width, pair % width
    for uri in files:
        have, table = load_block(uri)
        if not len(have):
            continue
        row = np.append(pc.fill_null(pc.index_in(enc.dictionary.cast(have.type), value_set=have), -1).to_numpy(zero_copy_only=False), -1)[code]
        hit = np.flatnonzero(row >= 0)
        for part in np.array_split(hit, max(1, -(-len(hit) * dim // SUMS))):
            if len(part):
                values = table[row[part]].astype(np.float64) * count[part, None]
                first = np.flatnonzero(np.r_[True, np.diff(doc[part]) > 0])
                sums[doc[part][first]] += np.add.reduceat(values, first, axis=0)
    return sums


def mean_vectors(docs: DataFrame, key: str, tokens: str, files: list[str], dim: int, name: str, dtype: str = "float32",
                 weights: str | None = None) -> DataFrame:
    """``(key, name)``, a row per row of ``docs``: the mean vector of the
    tokens in the array ``tokens`` (keys of the vector table), each counted
    ``weights`` times if that array is given. A token without a vector, null
    included, counts as zeros; null and empty arrays give zeros."""
    number = FloatType() if dtype == "float32" else DoubleType()
    arrow = pa.float32() if dtype == "float32" else pa.float64()
    step = max(1, SUMS // max(dim, 1))

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column(1).combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        w = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False) if weights else None
        sums = _multiply(lists.flatten(), w, lengths, files, dim)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(doc, weights=w, minlength=len(lengths)).astype(float)
        mean = np.divide(sums, total[:, None], out=np.zeros_like(sums), where=total[:, None] > 0)
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * dim, pa.int32()), pa.array(mean.ravel(), arrow))
        return pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), out], names=[key, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:               # as many rows as fit, one at least
                before = ends[at - 1] if at else 0
                to = max(at + 1, min(at + step - rows, int(np.searchsorted(ends, before + TOKENS - size, "right"))))
                held.append(b.slice(at, to - at))
                rows, size, at = rows + to - at, size + int(ends[to - 1] - before), to
                if rows >= step or size >= TOKENS or at < b.num_rows:
                    yield finish(held)
                    held, rows, size = [], 0, 0
        if held:
            yield finish(held)

    schema = StructType([StructField(key, docs.schema[key].dataType), StructField(name, ArrayType(number))])
    return docs.select(key, tokens, *([F.col(weights).cast("array<double>")] if weights else [])).mapInArrow(run, schema)
