"""WARC archives and an external merge of their capture indexes.

Writing: every task writes gzip-member WARC files and, beside each, a capture
run: the file's records sorted by URL key and timestamp. Merging: runs are
joined by k-way loser-tree merges, ``fan_in`` runs at a time and pass by pass
until one run is left. A pass cuts each group of runs into key ranges of
bounded size (splitters from the runs' systematic samples) and merges every
range in a task of its own, streaming the slices of its runs; the ranges in
order are the next run. The last run is the globally ordered capture history.

Files are named by attempt and only those in the written manifest are read, so
lost executors and repeated tasks leave nothing behind but unread files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.llm.common import folder, open_fs, read_file, stage, write_file

MIN_REVISIT = 100
SAMPLES = 64
_RUN = pa.schema([("key", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()),
                  ("digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_MANIFEST = "run string, first string, last string, part int, n bigint, path string, tail bigint, archive string, samples array<string>"
#: The sort key's separator, U+0000, sorts before all that a URL key has in it.
_ESCAPES = (("\x01", "\x01\x02"), ("\x00", "\x01\x01"))


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then port, path and query; no
    scheme, user or fragment, host in lower case. Null is the empty key."""
    rest = (url or "").split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    if name.startswith("www."):
        name = name[4:]
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + path


def sort_key(key: str, ts: str, page_id: int | None) -> str:
    """One string that orders captures by URL key, timestamp and page."""
    page = 0 if page_id is None else page_id + (1 << 63)
    for c, e in _ESCAPES:
        key = key.replace(c, e)
    return f"{key}\x00{ts}\x00{page:020d}"


def _key_of(sort: str) -> str:
    """The URL key in a sort key."""
    key = sort.split("\x00", 1)[0]
    for c, e in reversed(_ESCAPES):
        key = key.replace(e, c)
    return key


def _record(headers: Sequence[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if body in ("", "none") else int(body)


def build_record(page_id: int | None, url: str | None, ts: str, payload: bytes, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """A response record, or a revisit (HTTP headers only) that names the
    response's record and keeps the payload's digest and length."""
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in (url or "") if c >= " ")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _page(page_id)),
               ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", _page(refers_to))]
    return _record(headers, http if revisit else http + payload)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of an archive file."""
    import zlib
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:at + (1 << 16)])
        nxt = at + (1 << 16)
        while not z.eof:                                 # a member longer than one read
            raw += z.decompress(data[nxt:nxt + (1 << 20)])
            nxt += 1 << 20
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield at, headers, rest[:int(headers["Content-Length"])]
        at = min(nxt, len(data)) - len(z.unused_data)


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
             ts: Column | None = None) -> DataFrame:
    """(page_id, url, ts, payload, digest, refers_to, revisit) of every page;
    ``ts`` is its capture time, a timestamp or Unix seconds in UTC (null: 0).

    Of payloads that are equal and have ``MIN_REVISIT`` bytes or more, the
    smallest page_id is the response (all rows with that id, if it repeats;
    null ids are always responses). Digests are grouped with map-side minima;
    only digests met twice are joined back, without the payloads' hot keys
    meeting in one task (the join may split them).
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    # without a capture time, pages are a second apart from 2024 on, by page_id
    ts = (F.coalesce(ts.cast("long"), F.lit(0)) if ts is not None else
          F.lit(DEFAULT_START) + F.least(F.greatest(F.coalesce(F.col(page_id), F.lit(0)).cast("long"), F.lit(0)), F.lit(1 << 36)))
    t = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                     ts.alias("ts"), data.alias("payload"), F.sha2(data, 256).alias("digest"))
    groups = (t.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
              .select("digest", "first"))
    groups = stage(groups, "payload-groups")
    t = t.join(groups, "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return t.select("page_id", "url", "ts", "payload", "digest",
                    F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


DEFAULT_START = 1_704_067_200
_YEARS = (-62_135_596_800, 253_402_300_799)              # the years 1 to 9999


def _stamp(seconds: int) -> str:
    """Unix seconds as fourteen digits; times outside four-digit years become the first or the last."""
    t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=min(max(seconds, _YEARS[0]), _YEARS[1]))
    return f"{t.year:04d}" + t.strftime("%m%d%H%M%S")


def _write_run(out: str, rows: list[tuple], keys: list[str], stem: str) -> tuple:
    """Write one sorted run; returns its manifest fields but the group."""
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)
    buf = io.BytesIO()
    pq.write_table(table, buf, row_group_size=4096, compression="zstd")
    path = f"{out}/{stem}.parquet"
    write_file(path, buf.getvalue())
    step = max(1, len(keys) // SAMPLES)
    tail = next((k for k, r in enumerate(reversed(rows)) if r[0] != rows[-1][0]), len(rows))      # rows of the last URL key
    return keys[0], keys[-1], len(rows), path, tail, keys[::step]


def write_archives(caps: DataFrame, out: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the captures as archives with a sorted run each; returns the
    manifest (run, first, last, part, n, path, tail, archive, samples). A file is closed
    at ``archive_bytes`` of uncompressed payload, so a task's memory is bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, rows, held = io.BytesIO(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal body, rows, held
            name = uuid.uuid4().hex
            archive = f"{out}/{name}.warc.gz"
            write_file(archive, body.getvalue())
            order = sorted((sort_key(r[0], r[2], r[3]), k) for k, r in enumerate(rows))
            got = _write_run(out, [(*rows[k][:5], archive, *rows[k][5:]) for _, k in order], [k for k, _ in order], name)
            body, rows, held = io.BytesIO(), [], 0
            return _manifest([(name, *got[:2], 0, *got[2:5], archive, got[5])])

        for b in batches:
            for p in b.to_pylist():
                ts = _stamp(p["ts"] or 0)
                rec = build_record(p["page_id"], p["url"], ts, p["payload"], p["digest"], p["refers_to"], p["revisit"])
                rows.append((url_key(p["url"]), p["url"], ts, p["page_id"], p["digest"], body.tell(), len(rec)))
                body.write(rec)
                held += len(p["payload"])
                if held >= archive_bytes:
                    yield flush()
        if rows:
            yield flush()

    return stage(caps.mapInArrow(run, _MANIFEST), "warc-manifest")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    names = ["run", "first", "last", "part", "n", "path", "tail", "archive", "samples"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


class LoserTree:
    """k-way merge of sorted iterators of (key, row): every inner node keeps
    the loser of its match, so the next winner takes one path of log k."""

    def __init__(self, sources: Sequence[Iterator[tuple]]):
        self.sources = list(sources)
        self.k = len(self.sources)
        self.head = [next(s, None) for s in self.sources]
        self.loser = [-1] * self.k
        for s in range(self.k):
            self._play(s)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, s: int) -> None:
        node = (s + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = s
                return
            if self._beats(self.loser[node], s):
                s, self.loser[node] = self.loser[node], s
            node //= 2
        self.loser[0] = s

    def __iter__(self) -> Iterator[tuple]:
        if self.k:
            while (top := self.head[self.loser[0]]) is not None:
                s = self.loser[0]
                yield top
                self.head[s] = next(self.sources[s], None)
                self._play(s)


def _slice(paths: list[str], lo: str | None, hi: str | None, rows: int) -> Iterator[tuple]:
    """(key, row) of a run's files in order, for keys in [lo, hi); only row
    groups that can hold such keys are read, ``rows`` rows at a time."""
    low, high = (None if k is None else _key_of(k) for k in (lo, hi))
    for path in paths:
        fs, p = open_fs(path)
        f = pq.ParquetFile(fs.open_input_file(p))
        groups = []
        for g in range(f.num_row_groups):
            stats = f.metadata.row_group(g).column(0).statistics
            least, most = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)   # long ones are left out
            if (low is None or most is None or most >= low) and (high is None or least is None or least <= high):
                groups.append(g)
        for batch in f.iter_batches(rows, row_groups=groups) if groups else ():
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = sort_key(r[0], r[2], r[3])
                if hi is not None and k >= hi:
                    return
                if lo is None or k >= lo:
                    yield k, r


def merge_pass(manifest: DataFrame, out: str, fan_in: int, range_rows: int) -> DataFrame:
    """One pass: runs (made of files in key order) are grouped by ``fan_in``;
    each group becomes one run of range files. Splitters are picked from the
    samples of a group, on the group's rows only. The files of a range are
    numbered (``part``): those that one sort key fills have the same ``first``."""
    runs = manifest.groupBy("run").agg(F.sum("n").alias("n"))
    # runs are few (one per archive); their numbers are taken by hash order in buckets of about fan_in
    count = runs.count()
    groups = -(-count // fan_in)
    dealt = manifest.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)))
    sample = dealt.select("grp", F.explode("samples").alias("s"), (F.col("n") / F.size("samples")).alias("w"))
    from pyspark.sql import Window
    upto = Window.partitionBy("grp").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (sample.withColumn("at", F.floor(F.sum("w").over(upto) / range_rows))
            .groupBy("grp", "at").agg(F.min("s").alias("lo")).select("grp", "lo"))
    # neighbours with the same splitter collapse; the first range has no lower end
    nxt = Window.partitionBy("grp").orderBy("lo")
    ranges = (cuts.distinct().withColumn("hi", F.lead("lo").over(nxt))
              .withColumn("lo", F.when(F.row_number().over(nxt) > 1, F.col("lo"))))
    # the ranges that a file's first and last keys fall into, found in key order; the file goes to these and those between
    ranges = ranges.withColumn("r", F.row_number().over(nxt))
    ends = (ranges.select("grp", F.coalesce("lo", F.lit("")).alias("k"), F.lit(0).alias("end"), "r", F.lit(None).cast("string").alias("path"))
            .unionByName(dealt.select("grp", "path", F.explode(F.array(F.struct(F.col("first").alias("k"), F.lit(1).alias("end")),
                                                                      F.struct(F.col("last").alias("k"), F.lit(2).alias("end")))).alias("x"))
                         .select("grp", "x.k", "x.end", F.lit(None).cast("int").alias("r"), "path")))
    met = ends.withColumn("r", F.last("r", True).over(Window.partitionBy("grp").orderBy("k", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = met.where("end > 0").groupBy("grp", "path").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    files = (dealt.select("grp", "run", "first", "part", "path").join(spans, ["grp", "path"])
             .withColumn("r", F.explode(F.sequence("a", "b"))).join(ranges, ["grp", "r"]))
    work = files.groupBy("grp", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("run", "first", "part", "path"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.to_pylist():
                by_run: dict[str, list[str]] = {}
                for f in task["files"]:
                    by_run.setdefault(f["run"], []).append(f["path"])
                size = max(64, 65536 // max(1, len(by_run)))
                rows, keys, done = [], [], []
                for k, r in LoserTree([_slice(p, task["lo"], task["hi"], size) for p in by_run.values()]):
                    rows.append(r)
                    keys.append(k)
                    if len(rows) >= 4 * range_rows:      # a range of many more rows than its samples foretold
                        done.append(_write_run(out, rows, keys, uuid.uuid4().hex))
                        rows, keys = [], []
                if rows:
                    done.append(_write_run(out, rows, keys, uuid.uuid4().hex))
                yield _manifest([(f"merged-{task['grp']}", *d[:2], part, *d[2:5], None, d[5]) for part, d in enumerate(done)])

    return stage(work.repartition(max(1, work.count())).mapInArrow(run, _MANIFEST), "merge-manifest")


def merge_index(manifest: DataFrame, out: str, fan_in: int = 64, range_rows: int = 20_000) -> DataFrame:
    """Merge all runs into one, pass by pass; returns its manifest. A pass
    that doesn't give the rows that it was given is an error."""
    want = manifest.agg(F.sum("n")).first()[0]
    while True:
        manifest = merge_pass(manifest, out, fan_in, range_rows)
        if (got := manifest.agg(F.sum("n")).first()[0]) != want:
            raise RuntimeError(f"{got} captures are left of {want}")
        if manifest.select("run").distinct().count() <= 1:
            return manifest


def read_index(merged: DataFrame) -> DataFrame:
    """The captures of a merged index with ``position``, their place in the
    global order, and ``capture``, their place in the history of the URL key
    (both from 0). Histories go on from file to file: a file's first key has
    the rows in earlier files that these end with (``tail``)."""
    from pyspark.sql import Window
    w = Window.orderBy("first", "part")                  # one row per range file
    head, last = (F.substring_index(c, "\x00", 1) for c in ("first", "last"))
    same = Window.partitionBy("ends").orderBy("first", "part")
    ends = merged.withColumn("ends", last).withColumn("upto", F.sum("tail").over(same))
    before = F.when(F.lag("ends").over(w) == head, F.lag("upto").over(w)).otherwise(0)
    starts = ends.select("path", (F.sum("n").over(w) - F.col("n")).alias("start"), before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, held = pq.read_table(io.BytesIO(read_file(path))), None
                for part in t.to_batches():
                    rank = np.empty(part.num_rows, np.int64)
                    for k, key in enumerate(part.column(0).to_pylist()):
                        before = before if held in (None, key) else 0
                        rank[k], held, before = before, key, before + 1
                    at = pa.array(np.arange(start, start + part.num_rows))
                    start += part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, at, pa.array(rank)], names=[*_RUN.names, "position", "capture"])

    return (starts.repartition(max(1, merged.count()))
            .mapInArrow(run, "key string, url string, ts string, page_id bigint, digest string, archive string, "
                             "offset bigint, length bigint, position bigint, capture bigint"))


def read_archives(paths: DataFrame) -> DataFrame:
    """Read archive files (column ``archive``) back: one row per record, its
    digest checked against the payload of responses, their number against
    ``n`` if that column is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, written in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for at, h, block in parse_records(read_file(path)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path} at {at}: the payload doesn't match its digest")
                    rows.append((_page_id(h["WARC-Record-ID"]), size, digest, h["WARC-Type"],
                                 _page_id(h.get("WARC-Refers-To")), path, at))
                if written is not None and len(rows) != written:
                    raise ValueError(f"{path} has {len(rows)} records of {written}")
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset"])

    written = F.col("n") if "n" in paths.columns else F.lit(None)
    return (paths.select("archive", written.cast("bigint").alias("n")).repartition(max(1, paths.count()))
            .mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                             "refers_to bigint, archive string, offset bigint"))


def archive_pages(pages: DataFrame, out: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  archive_bytes: int = 64 << 20, fan_in: int = 64, range_rows: int = 20_000, ts: Column | None = None) -> DataFrame:
    """Write, index, merge and read back: one row per page with its record
    (page_id, payload_bytes, payload_digest, record_type, refers_to) and its
    place in the merged index (url_key, timestamp, position, archive, offset).

    Null payloads are empty, null URLs have the empty key, other columns are
    ignored, repeated rows are records of their own; no pages give no rows.
    ``ts`` is the capture time (see ``captures``). An archive with another
    number of records than were written, or a record that the index lacks,
    fails the job.
    """
    out = out or folder(pages.sparkSession, "warc")
    manifest = write_archives(captures(pages, page_id, url, payload, ts), f"{out}/archives", archive_bytes)
    merged = merge_index(manifest, f"{out}/index", fan_in, range_rows)
    index = read_index(merged).select("archive", "offset", F.col("key").alias("url_key"), F.col("ts").alias("timestamp"), "position")
    # file names compress so well that the planner would take a long index for a small one
    got = read_archives(manifest).join(index.hint("merge"), ["archive", "offset"], "left")
    lost = F.raise_error(F.concat(F.lit("not in the index: "), "archive", F.lit(" "), F.col("offset").cast("string")))
    return got.withColumn("position", F.coalesce("position", lost.cast("bigint")))
