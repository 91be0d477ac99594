"""Removal of repeated byte strings by column-wise multi-document
construction of the Burrows-Wheeler transform and its common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts
elsewhere in the collection. The work is dealt so that equal windows of that
length meet in one task and others rarely do: every window has an anchor, its
``gram``-byte string with the smallest hash, and neighbouring windows with one
anchor make a passage (under 2 * length bytes). Anchors met once are done;
the passages of the others are dealt by anchor.

A task builds the collections of its anchors column by column. Passages lie
under each other at their anchors. Each round inserts one symbol of every
passage to the left of its suffix: the symbols in suffix order are that
column of the collection's BWT, sorting them (stably, within an anchor) gives
the order of the longer suffixes, and the common prefix of new neighbours is
one more than the smallest between them before. Neighbours with a common
prefix of ``length`` or more are repeated windows. The columns of symbols are
written once and read back round by round, and each round appends the suffixes
with long enough prefixes to a second file, which is read at the end to put
runs of windows together; both are sequential files in the shared folder, and
memory is a few numbers a passage. A column of the BWT lives for its round.

Equal passages are counted before their text is fetched and enter once with
their number. An anchor with more than ``max_group`` different passages (by
default half a task's share, 20,000 at most) is split: windows by where the anchor lies in them (halves), passages by the bytes
that all windows of a half have. Equal windows stay together; the halving ends
at single windows, whose equal passages are one.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import folder, open_fs, read_file, stage, tasks, write_file

LENGTH, GRAM = 200, 64
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = 24                                            # a piece is far shorter than 2 ** 24 bytes
PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if n not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers.clear()
        _powers[n] = tuple(out)
    return _powers[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by block-wise running minima."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def passages(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor in a buffer of documents that end
    at ``ends``: first start, starts, anchor's offset, anchor hash, text hash."""
    n = len(data)
    if n < length:
        return (np.empty(0, np.int64),) * 5
    power, inverse = _power(PIECE + 4 * length if n <= PIECE + 4 * length else n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    pos_mask = np.uint64((1 << _POS_BITS) - 1)
    low = _sliding_min((grams & ~pos_mask) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    anchor = (low & pos_mask).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    stop = np.repeat(ends, ends - starts)[:len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + length <= stop)
    if not len(valid):
        return (np.empty(0, np.int64),) * 5
    at = anchor[valid]
    new = np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(at) != 0)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    place, at = valid[first], at[first]
    text = _mix((sums[place + count - 1 + length] - sums[place]) * inverse[place] + count.astype(np.uint64))
    return place, count, at - place, grams[at].view(np.int64), text.view(np.int64)


def _pieces(sizes: list[int], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Cuts of a buffer of documents into pieces of about ``PIECE`` bytes:
    (begin, end, ends of the documents in it). A longer document is cut with
    ``length`` - 1 bytes of overlap, so each of its windows is in one piece."""
    at, begin, ends = 0, 0, []
    for n in sizes:
        if n > PIECE:
            if ends:
                yield begin, at, ends
            for s in range(0, max(1, n - length + 1), PIECE):
                e = min(n, s + PIECE + length - 1)
                yield at + s, at + e, [at + e]
            begin, ends = at + n, []
        else:
            if at + n - begin > PIECE and ends:
                yield begin, at, ends
                begin, ends = at, []
            ends.append(at + n)
        at += n
    if ends:
        yield begin, at, ends


def _chunk_path(out: str, chunk: int) -> str:
    return f"{out}/{chunk:016x}.parquet"


def stage_passages(docs: DataFrame, out: str, length: int, gram: int, chunk_bytes: int) -> DataFrame:
    """Write the documents in chunks of about ``chunk_bytes`` to ``out``;
    returns their passages: chunk, place (byte in the chunk), shape (starts *
    65536 + anchor offset), key, text hash; and a row without key per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, held
            chunk = uuid.uuid4().int >> 66               # 62 bits
            buf = io.BytesIO()
            pq.write_table(pa.table({"doc_id": pa.array(ids, id_type), "text": pa.array(texts, pa.binary())}), buf, compression="zstd")
            write_file(_chunk_path(out, chunk), buf.getvalue())
            whole = np.frombuffer(b"".join(texts), np.uint8)
            yield _rows(chunk, None)
            for a, b, ends in _pieces([len(t) for t in texts], length):
                place, count, off, key, text = passages(whole[a:b], np.array(ends, np.int64) - a, length, gram)
                if len(place):
                    yield _rows(chunk, (place + a, (count << 16) + off, key, text))
            ids, texts, held = [], [], 0

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(doc)
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= chunk_bytes or len(ids) >= 50_000:
                    yield from flush()
        if ids:
            yield from flush()

    def _rows(chunk: int, cols) -> pa.RecordBatch:
        n = 1 if cols is None else len(cols[0])
        rest = [pa.nulls(1, pa.int64())] * 4 if cols is None else [pa.array(c, pa.int64()) for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk, np.int64)), *rest], names=["chunk", "place", "shape", "key", "text"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return stage(docs.mapInArrow(run, "chunk bigint, place bigint, shape bigint, key bigint, text bigint"), "passages")


def _buffer(out: str, chunk: int) -> tuple[list, np.ndarray, bytes]:
    """Document ids, their ends, and the bytes of a chunk."""
    t = pq.read_table(io.BytesIO(read_file(_chunk_path(out, chunk))))
    texts = t["text"].to_pylist()
    return t["doc_id"].to_pylist(), np.cumsum([len(x) for x in texts]), b"".join(texts)


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of x[lo..hi] (both included) for each pair."""
    both = np.empty(2 * len(lo), np.int64)
    both[::2], both[1::2] = lo, hi + 1
    return np.minimum.reduceat(np.append(x, x.dtype.type(0)), both)[::2]


def repeated_windows(group: np.ndarray, many: np.ndarray, texts: list[bytes], offsets: np.ndarray, length: int,
                     files: str | None = None) -> list[list[tuple[int, int]]]:
    """Per passage, the ranges [s, e) of starts of windows that occur twice or
    more among the passages of its group. ``group`` is ascending, ``many``
    marks passages that stand for several equal ones.

    One symbol a round and passage, from the right; see the module's text.
    """
    m = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    right, left = size - offsets, -offsets               # columns left..right-1, the anchor at 0
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(size) - size + offsets              # byte of column 0
    top, bottom = int(right.max()), int(left.min())
    name = f"{files}/{uuid.uuid4().hex}" if files else None
    if name:                                             # the columns in the order of the rounds
        fs, path = open_fs(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path + ".columns") as f:
            for c in range(top - 1, bottom - 1, -1):
                here = np.flatnonzero((c < right) & (c >= left))
                f.write(data[base[here] + c].tobytes())
        del data
        columns = fs.open_input_stream(path + ".columns")
        prefixes = fs.open_output_stream(path + ".prefixes")
    enter = np.argsort(-right, kind="stable")            # passages by where they begin, from the right
    entered, symbols = 0, np.zeros(m, np.uint8)
    order, lcp = np.empty(0, np.int64), np.empty(0, np.int32)
    flags: list[tuple[int, np.ndarray]] = []
    for c in range(top - 1, bottom - 1, -1):
        gone = left[order] > c
        if gone.any():                                   # ended on the left: prefixes with the next shrink
            keep = np.flatnonzero(~gone)
            if len(keep):
                first = np.concatenate([[0], keep[:-1] + 1])
                lcp = _range_min(lcp, first, keep)
            else:
                lcp = lcp[:0]
            order = order[keep]
        stop = entered
        while stop < m and right[enter[stop]] == c + 1:
            stop += 1
        if stop > entered:                               # empty suffixes come first in their group
            new = np.sort(enter[entered:stop])
            where = np.searchsorted(group[order], group[new], "left")
            order = np.insert(order, where, new)
            lcp = np.insert(lcp, where, 0)
            # what followed an inserted passage in its group has nothing in common with it
            at = where + np.arange(len(new)) + 1
            at = at[at < len(lcp)]
            lcp[at] = 0
            entered = stop
        if not len(order):
            continue
        if name:
            here = np.flatnonzero((c < right) & (c >= left))
            symbols[here] = np.frombuffer(columns.read(len(here)), np.uint8)
            bwt = symbols[order]
        else:
            bwt = data[base[order] + c]
        key = (group[order] << 8) | bwt
        if (key[1:] >= key[:-1]).all():
            lcp = lcp + np.int32(1)
            lcp[0] = 0
            lcp[1:][key[1:] != key[:-1]] = 0
        else:
            to = np.argsort(key, kind="stable")
            key = key[to]
            nxt = np.zeros(len(to), np.int32)
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            lo, hi = to[same - 1] + 1, to[same]
            near = lo == hi
            nxt[same[near]] = lcp[hi[near]] + 1
            if not near.all():
                nxt[same[~near]] = _range_min(lcp, lo[~near], hi[~near]) + 1
            order, lcp = order[to], nxt
        twice = lcp >= length
        twice[:-1] |= twice[1:]
        hit = order[twice]
        if len(hit) and name:
            prefixes.write(np.array([c, len(hit)], np.int64).tobytes() + hit.astype(np.int32).tobytes())
        elif len(hit):
            flags.append((c, hit))
    if name:
        prefixes.close()
        columns.close()
        with fs.open_input_stream(path + ".prefixes") as f:
            runs = _window_runs(_rounds(f), left)
        for end in (".columns", ".prefixes"):
            fs.delete_file(path + end)
    else:
        runs = _window_runs(flags, left)
    out: list[list[tuple[int, int]]] = [[(0, int(n))] if x else [] for x, n in zip(many, size - length + 1, strict=True)]
    for i, s, e in runs:
        if not many[i]:
            out[i].append((s, e))
    return out


def _rounds(f) -> Iterator[tuple[int, np.ndarray]]:
    """The rounds of a file of prefixes: column, passages with a repeated window."""
    while head := f.read(16):
        c, n = np.frombuffer(head, np.int64)
        yield int(c), np.frombuffer(f.read(4 * int(n)), np.int32)


def _window_runs(rounds: Iterable[tuple[int, np.ndarray]], left: np.ndarray) -> list[tuple[int, int, int]]:
    """(passage, s, e) of runs of window starts, by passage, then start. Rounds
    go from right to left: a run goes on while each next start is one less."""
    low, high = np.full(len(left), -2, np.int64), np.zeros(len(left), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c, hit in rounds:
        start = c - left[hit]
        new = low[hit] != start + 1
        old = hit[new & (low[hit] >= 0)]
        if len(old):
            done.append((old, low[old], high[old]))
        high[hit[new]] = start[new] + 1
        low[hit] = start
    rest = np.flatnonzero(low >= 0)
    done.append((rest, low[rest], high[rest]))
    who, s, e = (np.concatenate(x) for x in zip(*done, strict=True))
    o = np.lexsort((s, who))
    return list(zip(who[o].tolist(), s[o].tolist(), e[o].tolist(), strict=True))


def _split_hot(work: DataFrame, length: int, gram: int, max_group: int) -> tuple[DataFrame, list[DataFrame]]:
    """Split anchors with over ``max_group`` passages; returns the work and
    what is found on the way. See the module's text."""
    found: list[DataFrame] = []
    done: list[DataFrame] = []
    kind = "akey bigint, key bigint, shape bigint, text bigint, many boolean, off int, first int, lo int, hi int, bytes binary"

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                mid = (r["lo"] + r["hi"]) // 2
                n = len(r["bytes"]) - length + 1
                for x, y in ((r["lo"], mid), (mid, r["hi"])):        # windows whose anchor lies x..y-1 bytes in
                    s1, s2 = max(0, r["off"] - y + 1), min(n - 1, r["off"] - x)
                    if y <= x or s2 < s1:
                        continue
                    common = r["bytes"][r["off"] - x:r["off"] - y + 1 + length]
                    key = xxhash.xxh64_intdigest(common, seed=(r["akey"] ^ (x << 8) ^ y) & ((1 << 64) - 1))
                    rows.append({**r, "akey": key - (1 << 64) if key >> 63 else key, "off": r["off"] - s1, "first": r["first"] + s1,
                                 "lo": x, "hi": y, "bytes": r["bytes"][s1:s2 + length]})
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    while True:
        sizes = work.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group).select("akey")
        hot = stage(sizes, "hot-anchors")
        if hot.isEmpty():
            return _union([*done, work]), found
        done.append(stage(work.join(hot, "akey", "left_anti"), "passage-work"))
        halves = stage(work.join(hot, "akey", "left_semi").select(*work.columns).mapInArrow(halve, kind), "passage-halves")
        # equal texts of a half: all their windows repeat; one stands for them from here on
        same = ["akey", F.xxhash64("bytes").alias("bh"), F.length("bytes").alias("bl")]
        marked = halves.select("*", *same[1:])
        many = (marked.groupBy("akey", "bh", "bl").agg(F.min(F.struct("key", "shape", "text", "first")).alias("head"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").drop("n"))
        t = stage(marked.join(many, ["akey", "bh", "bl"], "left").withColumn(
            "is_head", F.col("head") == F.struct("key", "shape", "text", "first")), "passage-halves")
        found.append(t.where("head IS NOT NULL").select("key", "shape", "text", F.array(F.struct(
            F.col("first").alias("s"), (F.col("first") + F.col("bl") - length + 1).cast("int").alias("e"))).alias("spans")))
        work = stage(t.where("head IS NULL OR is_head").withColumn("many", F.col("many") | F.col("head").isNotNull()).select(*work.columns), "passage-work")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repeated_spans(runs: DataFrame, out: str, length: int, gram: int, collection_bytes: int,
                   max_group: int | None) -> DataFrame:
    """(chunk, s, e): ranges of window starts, as bytes of their chunk, whose
    window occurs twice or more."""
    spark = runs.sparkSession
    n = tasks(spark)
    keyed = runs.where("key IS NOT NULL")
    # written before the join, which then may split a hot anchor's rows
    twice = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "met-anchors")
    met = stage(keyed.join(twice, "key"), "met-passages")
    heads = met.groupBy("key", "shape", "text").agg(F.count(F.lit(1)).alias("n"), F.first("chunk").alias("chunk"), F.first("place").alias("place"))

    def fetch(rows: pd.DataFrame) -> pd.DataFrame:
        _, _, data = _buffer(out, int(rows["chunk"].iat[0]))
        count, off = rows["shape"].to_numpy() >> 16, rows["shape"].to_numpy() & 0xFFFF
        return pd.DataFrame({
            "akey": rows["key"], "key": rows["key"], "shape": rows["shape"], "text": rows["text"], "many": rows["n"] > 1,
            "off": off.astype(np.int32), "first": np.int32(0), "lo": np.int32(0), "hi": np.int32(length - gram + 1),
            "bytes": [data[p:p + c + length - 1] for p, c in zip(rows["place"].tolist(), count.tolist(), strict=True)]})

    work = stage(heads.repartition(n, "chunk").groupBy("chunk").applyInPandas(
        fetch, "akey bigint, key bigint, shape bigint, text bigint, many boolean, off int, first int, lo int, hi int, bytes binary"), "passage-work")
    if max_group is None:                                # at most half of what a task gets: work only, the rows are the same
        max_group = min(20_000, max(512, work.count() // (2 * n)))
    work, found = _split_hot(work, length, gram, max_group)
    spans = "array<struct<s:int,e:int>>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def collection(t: pa.Table) -> pa.RecordBatch:
            akey = t["akey"].to_numpy()
            group = np.cumsum(np.concatenate([[0], (np.diff(akey) != 0).astype(np.int64)]))
            got = repeated_windows(group, t["many"].to_numpy(), t["bytes"].to_pylist(), t["off"].to_numpy().astype(np.int64), length, f"{out}/columns")
            keep = [i for i, x in enumerate(got) if x]
            first = t["first"].to_pylist()
            t = t.select(["key", "shape", "text"]).take(pa.array(keep, pa.int64())).combine_chunks()
            s = pa.array([[{"s": a + first[i], "e": b + first[i]} for a, b in got[i]] for i in keep], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else pa.array([], pa.int64()) for c in t.columns), s], names=["key", "shape", "text", "spans"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.column(b.schema.get_field_index("bytes")).nbytes
            if size >= collection_bytes:                 # whole anchors only; the last may go on
                t = pa.Table.from_batches(held)
                akey = t["akey"].to_numpy()
                cut = int(np.searchsorted(akey, akey[-1]))
                if cut:
                    yield collection(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(x.column(x.schema.get_field_index("bytes")).nbytes for x in held)
        if held:
            yield collection(pa.Table.from_batches(held))

    built = work.repartition(n, "akey").sortWithinPartitions("akey").mapInArrow(build, f"key bigint, shape bigint, text bigint, spans {spans}")
    found = stage(_union([built, *found]), "repeated-passages")
    return (met.join(found, ["key", "shape", "text"]).select("chunk", "place", F.explode("spans").alias("x"))
            .select("chunk", (F.col("place") + F.col("x.s")).alias("s"), (F.col("place") + F.col("x.e")).alias("e")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", gram: int | None = None,
                   chunk_bytes: int = 4 << 20, collection_bytes: int = 8 << 20,
                   max_group: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (maximal removed
    byte ranges [s, e)) and kept (the remaining bytes).

    Null and empty texts have no bytes. Copies are judged on the input, so
    all copies of a repeated string go, overlaps too; repeated rows are copies
    of each other. Other columns are ignored; an empty table gives no rows.
    """
    if length < 2:
        raise ValueError("length must be 2 at least")
    gram = gram or max(1, length * GRAM // LENGTH)
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    out = folder(docs.sparkSession, "suffix")
    runs = stage_passages(src, out, length, gram, chunk_bytes)
    starts = repeated_spans(runs, out, length, gram, collection_bytes, max_group)
    none = F.lit(None).cast("long")
    todo = starts.unionByName(runs.where("key IS NULL").select("chunk", none.alias("s"), none.alias("e")))

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ends, data = _buffer(out, int(rows["chunk"].iat[0]))
        rows = rows[rows["s"].notna()]
        edge = np.zeros(len(data) + length + 1, np.int32)
        np.add.at(edge, rows["s"].to_numpy(np.int64), 1)
        np.add.at(edge, rows["e"].to_numpy(np.int64) + length - 1, -1)
        gone = np.cumsum(edge[:len(data)]) > 0
        whole = np.frombuffer(data, np.uint8)
        spans, kept, sizes, begin = [], [], [], 0
        for end in ends.tolist():
            g = gone[begin:end]
            step = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            spans.append([{"s": int(a), "e": int(b)} for a, b in zip(step[::2], step[1::2], strict=True)])
            kept.append(whole[begin:end][~g].tobytes() if len(step) else data[begin:end])
            sizes.append(end - begin)
            begin = end
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object if None in ids else None), "n_bytes": sizes, "spans": spans, "kept": kept})

    return (todo.repartition(tasks(docs.sparkSession), "chunk").groupBy("chunk")
            .applyInPandas(cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary"))
