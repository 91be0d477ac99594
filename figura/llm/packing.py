"""Best-fit packing planned on the histogram of piece lengths.

Tokenised documents are cut into pieces of at most ``capacity`` tokens. The
plan looks at how many pieces there are of each length (at most ``capacity``
numbers), never at the pieces: best-fit, longest first, moves whole ranges of
sequences with equal room at a time, so its size depends on ``capacity`` only.
Pieces then take the planned slots by a join on their rank within the length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import gapless_rank, stage
from figura.llm.tokens import encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset): pieces
    of that length with ranks first.. go to consecutive sequences, each at the
    offset. Best-fit decreasing: the fullest sequences with room come first.
    """
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)   # room left -> ranges (first sequence, how many)
    rooms: list[int] = []
    sequences = 0

    def add(left: int, first: int, n: int) -> None:
        if left and not room[left]:
            insort(rooms, left)
        if left:
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length                # fresh sequences, filled with this length alone
                full, rest = divmod(todo, each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    for slot in range(per if n else 0):
                        out.append((length, rank, n, sequences, slot * length))
                        rank += n
                    if n:
                        add(capacity - per * length, sequences, n)
                        sequences += n
                break
            left = rooms[k]
            first, n = room[left].pop()
            if not room[left]:
                rooms.pop(k)
            take = min(n, todo)
            out.append((length, rank, take, first, capacity - left))
            if take < n:
                add(left, first + take, n - take)
            add(left - length, first, take)
            rank, todo = rank + take, todo - take
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be short."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id",
           text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids,
    little-endian unsigned 32-bit numbers, with ``keep_ids``).

    Null and empty texts are the end id alone; rows are cut one by one, so
    repeated rows give repeated pieces; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end)
        for b in batches:
            rows, held = [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(t.as_py())
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * s:4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(part), *([part] if keep_ids else [])))
                    held += len(part)
                if keep_ids and held > 16 << 20:
                    yield _batch(rows, b.column(0).type, keep_ids)
                    rows, held = [], 0
            yield _batch(rows, b.column(0).type, keep_ids)

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start bigint, length bigint, "
                               "ids_crc32 bigint" + (", ids binary" if keep_ids else ""))


def _batch(rows: list, kind: pa.DataType, keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def pack(cuts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (column length).

    Lengths are counted with map-side sums; the histogram (``capacity`` rows
    at most) goes to the driver and the plan, whose size ``capacity`` bounds,
    to the tasks. A length that holds most pieces is ranked in buckets. Other
    columns pass through, whatever their names; a sequence_id or offset that
    the table has already is replaced.
    """
    counts = {r.length: r.n for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError(f"pieces must have 1 to {capacity} tokens")
    slots = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    first = {int(n): int(k) for n, k in zip(*np.unique(slots[:, 0], return_index=True), strict=True)}
    names = [c for c in cuts.columns if c not in ("sequence_id", "offset")]
    rows = cuts.select(F.struct(*[F.col(c) for c in names]).alias("row"), "length", "doc_id", "piece", "ids_crc32")
    ranked = gapless_rank(rows, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values())).select("row", "length", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {n: (k, k + int((slots[:, 0] == n).sum())) for n, k in first.items()}
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                lo, hi = bounds[n]
                mine = length == n
                at[mine] = lo + np.searchsorted(slots[lo:hi, 1], rank[mine], "right") - 1
            s = slots[at]
            yield pa.RecordBatch.from_arrays(
                [*b.column("row").flatten(), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])],
                names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema["row"].dataType.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, doc_id: str = "doc_id",
                   text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: the columns of ``pieces`` with sequence_id and
    offset. Every piece is in exactly one place; an empty table gives no rows."""
    return pack(stage(pieces(docs, tokenizer, capacity, end, doc_id, text, keep_ids), "pieces"), capacity)
