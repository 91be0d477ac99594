"""Structural joins: which elements enclose which nodes.

A node table numbers nodes in document order (``pre``) and in closing order
(``post``), so one node encloses another if its ``pre`` is smaller and its
``post`` larger. Nodes of both sides of a join are sorted by (document,
``pre``) by Spark and read once, with a stack of the elements that are still
open: an element leaves the stack at the first node that closes later. That is
linear in the nodes (and in the output), whatever the depth; no node carries a
list of its ancestors and no pairs within a document are formed.

A task streams its documents one after another. It holds the open elements
and, for ``covered_text``, the text runs of the outermost open target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ROWS = 5_000      # output rows handed on at once


def _values(column: pa.Array) -> list:
    """``to_pylist``, by way of numpy for whole numbers and texts."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not pa.types.is_integer(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _merge(rows: DataFrame, doc: str, schema: StructType, start: Callable) -> DataFrame:
    """Stream ``rows`` (doc, pre, side, post, ...) in document order through
    one handler per document: ``start(emit)`` gives ``(node, finish)``, where
    ``node`` takes the columns after ``doc`` and ``finish`` ends a document.
    ``emit`` takes the output columns after ``doc``."""
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, node, finish = object(), None, None

        def flush():
            cols = list(zip(*out, strict=True)) if out else [()] * len(out_schema)
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)
            out.clear()
            return got

        for b in batches:
            for d, *rest in zip(*map(_values, b.columns), strict=True):
                if node is None or d != current:
                    if finish is not None:
                        finish()
                    current = d
                    node, finish = start(lambda *x, d=d: out.append((d, *x)))
                node(*rest)
                if len(out) >= _ROWS:
                    yield flush()
        if finish is not None:
            finish()
        yield flush()

    return rows.repartition(doc).sortWithinPartitions(doc, "pre", "side").mapInArrow(run, schema)


def _schema(df: DataFrame, doc: str, *fields: StructField) -> StructType:
    return StructType([StructField(doc, df.schema[doc].dataType), *fields])


def nearest(targets: DataFrame, candidates: DataFrame, kinds: list[str], value: Column, doc: str = "doc_id", pre: str = "pre",
            post: str = "post", kind: str = "kind") -> DataFrame:
    """``(doc, pre, *kinds)``: for every row of ``targets`` the ``value`` of
    its nearest enclosing candidate of each kind, null where there is none.
    A node does not enclose itself. Rows of ``targets`` that repeat stay."""
    c = candidates.where(F.col(kind).isin(*kinds)).select(
        doc, F.col(pre).alias("pre"), F.lit(1).alias("side"), F.col(post).alias("post"), F.col(kind).alias("kind"), value.alias("value"))
    kind_of = c.schema["value"].dataType
    t = targets.select(doc, F.col(pre).alias("pre"), F.lit(0).alias("side"), F.col(post).alias("post"),
                       F.lit(None).cast("string").alias("kind"), F.lit(None).cast(kind_of).alias("value"))

    def start(emit):
        open_: dict[str, list[tuple]] = {k: [] for k in kinds}

        def node(pre, side, post, kind, value):
            if side:
                stack = open_[kind]
                while stack and stack[-1][0] <= post:
                    stack.pop()
                stack.append((post, value))
                return
            found = []
            for k in kinds:
                stack = open_[k]
                while stack and stack[-1][0] <= post:
                    stack.pop()
                found.append(stack[-1][1] if stack else None)
            emit(pre, *found)
        return node, lambda: None

    schema = _schema(targets, doc, StructField(pre, LongType()), *[StructField(k, kind_of) for k in kinds])
    return _merge(t.unionByName(c), doc, schema, start)


def enclosing(targets: DataFrame, candidates: DataFrame, value: Column, doc: str = "doc_id", name: str = "value") -> DataFrame:
    """``(doc, pre, name)``: a row per target and candidate that encloses it."""
    c = candidates.select(doc, "pre", F.lit(1).alias("side"), "post", value.alias("value"))
    kind_of = c.schema["value"].dataType
    t = targets.select(doc, "pre", F.lit(0).alias("side"), "post", F.lit(None).cast(kind_of).alias("value"))

    def start(emit):
        stack: list[tuple] = []

        def node(pre, side, post, value):
            while stack and stack[-1][0] <= post:
                stack.pop()
            if side:
                stack.append((post, value))
            else:
                for _, v in stack:
                    emit(pre, v)
        return node, lambda: None

    return _merge(t.unionByName(c), doc, _schema(targets, doc, StructField("pre", LongType()), StructField(name, kind_of)), start)


def _targets(targets: DataFrame, doc: str) -> DataFrame:
    return targets.select(doc, "pre", F.lit(0).alias("side"), "post").distinct()


def covered_text(targets: DataFrame, runs: DataFrame, doc: str = "doc_id", name: str = "text", leaf: str | None = None) -> DataFrame:
    """``(doc, pre, name)``: the texts of all runs below each target, in
    document order. ``leaf`` names a column with the ``pre`` of a run's
    element: runs of different elements are then put a space apart, and runs
    that lie directly in the target do not count. A target inside a target
    shares its runs; each text is joined once per target that it belongs to."""
    r = runs.select(doc, "pre", F.lit(1).alias("side"), "post", F.col("text").alias("text"),
                    (F.col(leaf) if leaf else F.lit(None)).cast("long").alias("leaf"))
    t = _targets(targets, doc).withColumn("text", F.lit(None).cast("string")).withColumn("leaf", F.lit(None).cast("long"))
    spaced = leaf is not None

    def start(emit):
        pieces: list[str] = []
        open_: list[list] = []        # post, pre, first piece, whether runs lie directly in it
        last = None

        def close(post):
            while open_ and (post is None or open_[-1][0] <= post):
                _, pre, first, own = open_.pop()
                emit(pre, "" if own else "".join(pieces[first:]))
            if not open_:
                pieces.clear()

        def node(pre, side, post, text, leaf):
            nonlocal last
            close(post)
            if not side:
                open_.append([post, pre, len(pieces), False])
            elif open_:
                if spaced:
                    if leaf == open_[-1][1]:
                        open_[-1][3] = True
                    if leaf != last and pieces:
                        text = " " + text
                    last = leaf
                pieces.append(text)
        return node, lambda: close(None)

    return _merge(t.unionByName(r), doc, _schema(targets, doc, StructField("pre", LongType()), StructField(name, StringType())), start)


def covered_lengths(targets: DataFrame, runs: DataFrame, doc: str = "doc_id", name: str = "stripped_len") -> DataFrame:
    """``(doc, pre, name)``: the length of each target's text without the
    white space around it, from ``runs`` (doc, pre, post, len, blank, lead,
    trail) alone: no text is moved or joined."""
    numbers = ["len", "blank", "lead", "trail"]
    r = runs.select(doc, "pre", F.lit(1).alias("side"), "post", *[F.col(c).cast("long").alias(c) for c in numbers])
    t = _targets(targets, doc).select("*", *[F.lit(None).cast("long").alias(c) for c in numbers])

    def start(emit):
        total = 0
        solid: list[tuple[int, int]] = []      # first and last solid place of each run that is not blank
        open_: list[tuple[int, int, int]] = []

        def close(post):
            while open_ and (post is None or open_[-1][0] <= post):
                _, pre, first = open_.pop()
                emit(pre, solid[-1][1] - solid[first][0] if len(solid) > first else 0)
            if not open_:
                solid.clear()

        def node(pre, side, post, length, blank, lead, trail):
            nonlocal total
            close(post)
            if not side:
                open_.append((post, pre, len(solid)))
                return
            if not blank and open_:
                solid.append((total + lead, total + length - trail))
            total += length
        return node, lambda: close(None)

    return _merge(t.unionByName(r), doc, _schema(targets, doc, StructField("pre", LongType()), StructField(name, LongType())), start)
