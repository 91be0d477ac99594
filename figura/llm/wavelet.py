"""Token-id shards as wavelet matrices.

A shard file holds the ids of consecutive documents as succinct bit-planes:
plane l has bit (top - l) of every id, ids being stably parted by that bit
before the next plane. Rank directories (counts per 512 bits) answer access,
rank, select and occurrence lookup from the one file; planes, directories and
document starts are stored as compressed sections behind a small header.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figura.llm.common import folder, read_file, stage, write_file
from figura.llm.tokens import encoder

MAGIC = b"WAVM0001"
BLOCK = 512


def _narrow(top: int) -> type:
    """The type that ids with a highest bit ``top`` are moved as."""
    return np.uint16 if top < 16 else np.uint32


class WaveletMatrix:
    """Access, rank and select over a sequence of ids below 2 ** planes."""

    def __init__(self, bits: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray], n: int):
        self.bits, self.zeros, self.ranks, self.n = bits, zeros, ranks, n
        self.top = len(bits) - 1

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        top = max(int(ids.max()).bit_length() if n else 1, 1) - 1
        kind = _narrow(top)
        bits, zeros, ranks, cur = [], [], [], ids.astype(kind, copy=False)
        for level in range(top, -1, -1):
            one = (cur & kind(1 << level)) != 0
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8) + BLOCK // 8, np.uint8)])
            per = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            bits.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.uint32))
            zeros.append(n - int(np.count_nonzero(one)))
            cur = np.concatenate([np.compress(~one, cur), np.compress(one, cur)])
        return cls(bits, zeros, ranks, n)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.bits[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position of a plane."""
        words = self.bits[level].view(np.uint64)
        base = self.ranks[level][at // BLOCK].astype(np.int64)
        word, first = at >> 6, (at // BLOCK) * (BLOCK // 64)
        for k in range(BLOCK // 64):
            w = first + k
            base += np.where(w < word, np.bitwise_count(words[w]), 0)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return base + np.bitwise_count(words[word] & mask)

    def access(self, at) -> np.ndarray:
        """The ids at the given positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(self.top + 1):
            one = self._bit(level, at).astype(bool)
            r = self._rank1(level, at)
            out = (out << np.uint32(1)) | one.astype(np.uint32)
            at = np.where(one, self.zeros[level] + r, at - r)
        return out

    def all(self) -> np.ndarray:
        """Every id in order: the parting is undone plane by plane, from the last."""
        kind = _narrow(self.top)
        cur = np.zeros(self.n, kind)
        for level in range(self.top, -1, -1):
            one = np.unpackbits(self.bits[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            nxt = np.empty(self.n, kind)
            nxt[np.flatnonzero(~one)] = cur[:z]
            nxt[np.flatnonzero(one)] = cur[z:] | kind(1 << (self.top - level))
            cur = nxt
        return cur.astype(np.uint32, copy=False)

    def _range(self, c: int, lo: int, hi: int) -> tuple[int, int]:
        if c >> (self.top + 1):
            return 0, 0
        for level in range(self.top + 1):
            r = self._rank1(level, np.array([lo, hi], np.int64))
            if c >> (self.top - level) & 1:
                lo, hi = self.zeros[level] + int(r[0]), self.zeros[level] + int(r[1])
            else:
                lo, hi = lo - int(r[0]), hi - int(r[1])
        return lo, hi

    def count(self, c: int, lo: int = 0, hi: int | None = None) -> int:
        """How often id ``c`` stands in positions lo..hi-1."""
        a, b = self._range(c, lo, self.n if hi is None else hi)
        return b - a

    rank = count

    def select(self, c: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``c``; -1 if there is none."""
        a, b = self._range(c, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for level in range(self.top, -1, -1):
            one = c >> (self.top - level) & 1
            at = self._select(level, at - self.zeros[level] if one else at, one)
        return at

    def _select(self, level: int, k: int, one: int) -> int:
        """Position of the k-th one (or zero) of a plane, by its rank directory."""
        have = self.ranks[level].astype(np.int64)
        if not one:
            have = np.arange(len(have), dtype=np.int64) * BLOCK - have
        block = int(np.searchsorted(have, k, "right")) - 1
        part = self.bits[level][block * BLOCK // 8:(block + 1) * BLOCK // 8]
        spots = np.flatnonzero(np.unpackbits(part, bitorder="little") == one)
        return block * BLOCK + int(spots[k - have[block]])

    def occurrences(self, c: int) -> np.ndarray:
        """All positions of ``c``, ascending."""
        return np.array([self.select(c, k) for k in range(self.count(c))], np.int64)


def _column(values: list, kind: pa.DataType | None) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(values, kind)], names=["doc_id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def dump(ids: np.ndarray, doc_ids: list, lengths: list[int], kind: pa.DataType | None = None) -> bytes:
    """Bytes of a shard file. Document ids are an Arrow column of any type."""
    m = WaveletMatrix.build(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    parts = [press(_column(doc_ids, kind)), press(np.array(lengths, np.int64).tobytes())]
    for b, r in zip(m.bits, m.ranks, strict=True):
        parts += [press(b.tobytes()), press(r.tobytes())]
    head = json.dumps({"n": m.n, "docs": len(lengths), "zeros": m.zeros, "sections": [len(p) for p in parts]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)


def load(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The wavelet matrix, document ids and lengths of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    size = int.from_bytes(data[8:12], "little")
    head = json.loads(data[12:12 + size])
    at, parts = 12 + size, []
    press = zstandard.ZstdDecompressor().decompress
    for n in head["sections"]:
        parts.append(press(data[at:at + n]))
        at += n
    bits = [np.frombuffer(p, np.uint8) for p in parts[2::2]]
    ranks = [np.frombuffer(p, np.uint32) for p in parts[3::2]]
    return WaveletMatrix(bits, head["zeros"], ranks, head["n"]), pa.ipc.open_stream(parts[0]).read_all()["doc_id"].to_pylist(), np.frombuffer(parts[1], np.int64)


def write_shards(docs: DataFrame, tokenizer: str, out: str, end: int = 2, doc_id: str = "doc_id", text: str = "text",
                 shard_tokens: int = 2_000_000, partitions: int | None = None) -> DataFrame:
    """Write shard files under ``out`` in ascending doc_id order; returns the
    manifest (shard, path, n_docs, n_tokens, start), shards in id order.

    Documents are range-partitioned by id; a task closes a file once it has
    ``shard_tokens`` ids, so memory is bounded by that and one document. Files
    of tasks that fail or run twice are not in the manifest and are not read.
    Null ids come first, repeated ids in any order of their texts.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    # ranges of (id, text hash): rows of one id, or without one, may spread over tasks
    dealt = src.repartitionByRange(partitions, *order) if partitions else src.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer, end)
        ids, doc_ids, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, lengths, held, seq
            path = f"{out}/shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wavm"
            write_file(path, dump(np.frombuffer(b"".join(ids), np.uint32), doc_ids, lengths, kind))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([path]), pa.array([len(lengths)]), pa.array([held])],
                names=["part", "seq", "path", "n_docs", "n_tokens"])
            ids, doc_ids, lengths, held, seq = [], [], [], 0, seq + 1
            return row

        kind = None
        for b in batches:
            kind = b.column(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = enc.encode(t.as_py())
                ids.append(x)
                doc_ids.append(doc)
                lengths.append(len(x) // 4)
                held += len(x) // 4
                if held >= shard_tokens:
                    yield flush()
        if lengths:
            yield flush()

    files = stage(dealt.sortWithinPartitions(*order)
                  .mapInArrow(run, "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint"), "wavelet-manifest")
    # one row per shard file: the running sum over them is small
    w = Window.orderBy("part", "seq")
    return files.select(
        (F.row_number().over(w) - 1).alias("shard"), "path", "n_docs", "n_tokens",
        F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("start"))


def read_shards(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read shard files back: doc_id, start (ids of all documents before it),
    n_tokens and ids_crc32 of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m, doc_ids, lengths = load(read_file(path))
                raw = m.all().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, b_type), pa.array(begins + start), pa.array(lengths),
                    pa.array([zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string
    b_type = to_arrow_type(_parse_datatype_string(id_type))
    return (manifest.select("path", "start").repartition(max(1, manifest.count()))
            .mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_files(docs: DataFrame, tokenizer: str, end: int = 2, doc_id: str = "doc_id", text: str = "text",
                out: str | None = None, shard_tokens: int = 2_000_000) -> DataFrame:
    """Write the shards of ``docs`` (to ``out`` or a shared folder) and read
    them back: one row per row of ``docs``. Null and empty texts have the end
    id alone; an empty table writes no file and gives no rows."""
    kind = dict(docs.dtypes)[doc_id]
    manifest = write_shards(docs, tokenizer, out or folder(docs.sparkSession, "wavelet"), end, doc_id, text, shard_tokens)
    return read_shards(stage(manifest, "wavelet-starts"), kind)
