"""Spelling variants: words one inserted, deleted or replaced letter apart.

The vocabulary is indexed by bitsets, one per (position, letter), a bit per
word. A query word is read letter by letter; two sets of words are carried
along at once, 64 words an operation: those that agree so far (no error) and
those that agree but for one edit (one error, read at a position shifted by
one after an insertion).

Words meet by the text outside an interval of positions that holds the edit:
first the two halves of the word, and where such a group has more than
``group_words`` words, halves of its interval again, down to one position.
A group of one position is bounded by the alphabet. So a common beginning or
ending needs neither a hot task nor all pairs of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.llm.common import drop_staged, stage, tasks

_PARTIAL = 300_000       # distinct words a task counts before it hands them on
_CHARS = 400_000         # letters of one bitset index, if its groups allow
_CELLS = 200_000         # 64-bit cells that queries read at once
KEY = ["m", "a", "b", "head", "tail"]
NEAR = "word string, n_near bigint, best_n bigint, best string"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3,
                every: int = 97) -> DataFrame:
    """(word, n): the words of whole texts with ``min_length`` code points and
    ``min_count`` occurrences at least.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased.
    With h the crc32 of ``<doc_id>:<word>``, an occurrence whose h is divisible
    by ``every`` lacks the code point h % length. Null or empty texts have no
    words; a null doc_id is written as the empty string; a row given twice
    counts twice. Runs too short to reach ``min_length`` are left out early.
    """
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter[str] = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())],
                                           names=["word", "n"])
            got.clear()
            return b
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                if not t:
                    continue
                start = zlib.crc32(f"{i.as_py() or ''}:".encode())
                for w, n in Counter(run.findall(t.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    got[w] += n
                if len(got) >= _PARTIAL:
                    yield out()
        yield out()

    return (docs.select(F.col(doc_id).cast("string"), F.col(text))
            .mapInArrow(count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, query, m, a, b) with the text outside [a, b). A query
    word has one letter more than the m of the words it is compared with."""
    return rows.withColumn("head", F.expr("substring(word, 1, a)")).withColumn("tail", F.expr("substring(word, b + 1 + query, m)"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the left and the right half of its interval."""
    mid = F.expr("cast((a + b) div 2 as int)")
    both = F.array(F.struct(F.col("a").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("b").alias("y")))
    return _keyed(rows.select("word", "n", "query", "m", F.explode(both).alias("i"))
                  .select("word", "n", "query", "m", F.col("i.x").alias("a"), F.col("i.y").alias("b")))


def meeting_groups(words: DataFrame, group_words: int = 4096) -> DataFrame:
    """(word, n, query, m, a, b, head, tail): rows of words that may be near.

    A word stands as itself (query 0, m its length) and as a query for words
    one letter shorter (query 1). An edit lies in one interval only, so near
    words meet in a group; groups over ``group_words`` rows are halved until
    their interval is one position.
    """
    size = F.length("word")
    as_ = F.explode(F.array(F.lit(0), F.lit(1))).alias("query")
    rows = (words.select("word", "n", as_).withColumn("m", (size - F.col("query")).cast("int")).where("m > 0")
            .withColumn("a", F.lit(0)).withColumn("b", F.col("m")))
    level, done = _halves(rows), []
    while True:
        level = stage(level, "spelling-keys")
        hot = stage(level.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > group_words) & (F.col("b") - F.col("a") > 1))
                    .drop("c"), "spelling-hot")
        if hot.isEmpty():
            done.append(level)
            break
        done.append(level.join(hot, KEY, "left_anti"))
        level = _halves(level.join(hot, KEY, "left_semi"))
    got = done[0]
    for x in done[1:]:
        got = got.unionByName(x)
    return got


def _letters(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)


class BitIndex:
    """Bitsets per (position, letter) over words of one length, sorted by group."""

    def __init__(self, letters: np.ndarray):
        n, m = letters.shape
        self.letters, self.m = letters, m
        self.alphabet = np.unique(letters)
        at = np.arange(n)
        self.bits = np.zeros((m, len(self.alphabet) + 1, (n + 63) // 64), np.uint64)   # last letter: any other, no word has it
        codes, bit = self.code(letters), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
        for p in range(m):
            np.bitwise_or.at(self.bits[p], (codes[:, p], at >> 6), bit)

    def code(self, letters: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.alphabet, letters)
        inside = np.minimum(at, len(self.alphabet) - 1)
        return np.where(self.alphabet[inside] == letters, inside, len(self.alphabet))

    def _cells(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, 64-bit cell, mask) for every cell of each query's words lo..hi-1."""
        first, last = lo >> 6, (hi - 1) >> 6
        n = np.where(hi > lo, last - first + 1, 0)
        q = np.repeat(np.arange(len(lo)), n)
        cell = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask = np.full(len(q), full)
        head, tail = cell == first[q], cell == last[q]
        mask[head] &= np.left_shift(full, (lo[q[head]] & 63).astype(np.uint64))
        mask[tail] &= np.right_shift(full, (63 - ((hi[q[tail]] - 1) & 63)).astype(np.uint64))
        return q, cell, mask

    def one_edit(self, letters: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word): query rows have the words' length (one letter
        replaced) or one more (one letter deleted); words lo..hi-1 are asked.
        Queries of large groups read many cells, so they are taken in pieces."""
        upto = np.cumsum(np.where(hi > lo, ((hi - 1) >> 6) - (lo >> 6) + 1, 0))
        found, i = [], 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _CELLS, "right")))
            q, w = self._one_edit(letters[i:j], lo[i:j], hi[i:j])
            found.append((q + i, w))
            i = j
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _one_edit(self, letters: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longer = letters.shape[1] - self.m
        codes = self.code(letters)
        q, cell, none = self._cells(lo, hi)
        one = np.zeros_like(none)
        for p in range(self.m + longer):
            c = codes[q, p]
            if longer:
                shifted = self.bits[p - 1, c, cell] if p else np.uint64(0)
                one = (one & shifted) | none
                none = none & self.bits[p, c, cell] if p < self.m else np.zeros_like(none)
            else:
                same = self.bits[p, c, cell]
                one = (one & same) | (none & ~same)
                none = none & same
        some = np.flatnonzero(one)
        if not len(some):
            return some, some
        row, bit = np.nonzero(np.unpackbits(one[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return q[some[row]], (cell[some[row]] << 6) + bit


def _near_in_groups(t: pa.Table) -> pa.RecordBatch:
    """Near words within whole groups of one length: per word how many, and
    the one of largest n, then smallest in code-point order."""
    m = t.column("m")[0].as_py()
    words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
    query, a, b = (t.column(c).to_numpy() for c in ("query", "a", "b"))
    key = list(zip(a.tolist(), b.tolist(), t.column("head").to_pylist(), t.column("tail").to_pylist(), strict=True))
    group = np.cumsum([0, *(x != y for x, y in zip(key, key[1:], strict=False))])
    own, ask = np.flatnonzero(query == 0), np.flatnonzero(query == 1)
    pairs = []
    if len(own):
        index = BitIndex(_letters([words[i] for i in own], m))
        lo, hi = (np.searchsorted(group[own], group, side) for side in ("left", "right"))
        x, y = index.one_edit(index.letters, lo[own], hi[own])
        pairs.append((own[x], own[y]))
        if len(ask):
            letters = _letters([words[i] for i in ask], m + 1)
            x, y = index.one_edit(letters, lo[ask], hi[ask])
            differ = letters[x, :m] != index.letters[y]
            at = np.where(differ.any(axis=1), differ.argmax(axis=1), m)     # the last place where the letter may go
            x, y = ask[x], own[y]
            mine = (a[x] <= at) & ((at < b[x]) | (b[x] == m))               # found once, in the interval of that place
            pairs += [(x[mine], y[mine]), (y[mine], x[mine])]
    x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    by = np.lexsort((rank[y], x))
    x, y = x[by], y[by]
    head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    count = np.diff(np.r_[head, len(x)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in x[head]], pa.string()), pa.array(count, pa.int64()), pa.array(n[y[head]], pa.int64()),
         pa.array([words[i] for i in y[head]], pa.string())], names=["word", "n_near", "best_n", "best"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted; whole groups of one length are indexed together."""
    held: pa.Table | None = None

    def cut(t: pa.Table) -> int:
        """Where the last group begins."""
        last = [t.column(c)[len(t) - 1] for c in KEY]
        lo, hi = 0, len(t) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if [t.column(c)[mid] for c in KEY] == last:
                hi = mid
            else:
                lo = mid + 1
        return lo
    for batch in batches:
        t = pa.Table.from_batches([batch])
        lengths = t.column("m").to_numpy()
        for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(lengths)) + 1):
            if not len(part):
                continue
            piece = t.slice(part[0], len(part))
            if held is not None and held.column("m")[0] != piece.column("m")[0]:
                yield _near_in_groups(held)
                held = None
            held = piece if held is None else pa.concat_tables([held, piece])
            m = held.column("m")[0].as_py()
            if len(held) * m >= _CHARS and (at := cut(held)):
                yield _near_in_groups(held.slice(0, at))
                held = held.slice(at)
    if held is not None:
        yield _near_in_groups(held)


def near_words(words: DataFrame, group_words: int = 4096) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word."""
    rows = meeting_groups(words, group_words)
    found = stage(rows.repartition(tasks(words.sparkSession), *KEY).sortWithinPartitions(*KEY).mapInArrow(_near, NEAR), "spelling-near")
    drop_staged(rows)
    return (found.groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("x"))
            .select("word", "n_near", (-F.col("x.k")).alias("best_n"), F.col("x.best").alias("best")))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last by pointer
    doubling. A form's n at least doubles, so chains are short and end."""
    cur = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = cur.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = stage(cur.join(nxt, F.col("root") == F.col("at"), "left")
                     .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_staged(cur)
        cur = step.select("word", "root")
        if step.where("moved").isEmpty():
            return cur


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3, every: int = 97,
             times: int = 2, group_words: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word.

    ``form`` is the near word of largest n (ties: smallest in code-point
    order) if that is ``times`` the word's n at least, else null; ``root``
    follows forms to the last, the word itself if it has none. Nulls, empty
    texts and repeated rows as in ``word_counts``; an empty table gives no rows.
    """
    words = stage(word_counts(docs, doc_id, text, min_length, min_count, every), "spelling-words")
    got = words.join(near_words(words, group_words), "word", "left")
    has = F.col("best_n") >= F.col("n") * times
    got = stage(got.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                           F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = follow(got.where("form IS NOT NULL"))
    return (got.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
