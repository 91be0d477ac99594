"""First occurrences of many sentences in one context.

A context meets all its sentences in one row, once: an Aho-Corasick automaton
of the distinct sentences reads the context from left to right and stops when
each has been seen. The context is not copied onto its sentences, and the work
is its length plus theirs plus the matches met.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType


def first_places(text: str, sentences: set[str]) -> dict[str, int]:
    """The place (code points) of the first occurrence of each sentence that
    occurs; the empty sentence occurs at 0."""
    found = {"": 0} if "" in sentences else {}
    rest = sentences - {""}
    if len(rest) <= 2:
        return found | {s: at for s in rest if (at := text.find(s)) >= 0}
    machine = ahocorasick.Automaton()
    for s in rest:
        machine.add_word(s, s)
    machine.make_automaton()
    left = len(rest)
    for end, s in machine.iter(text):
        if s not in found:
            found[s] = end + 1 - len(s)
            left -= 1
            if not left:
                break
    return found


def first_occurrences(contexts: DataFrame, sentences: DataFrame, keys: list[str], text: str = "text", sentence: str = "sentence",
                      start: str = "sentence_start_idx", end: str = "sentence_end_idx") -> DataFrame:
    """``sentences`` without the sentence column, with the 0-based ``[start,
    end)`` of its first occurrence in its context (``keys``; one row each in
    ``contexts``); start is -1 where it doesn't occur. Both are null where the
    sentence or the context is null or missing."""
    ids = [c for c in sentences.columns if c not in (*keys, sentence)]
    grouped = sentences.groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*ids).alias("id"), F.col(sentence).alias("s"))).alias("_s"))
    rows = grouped.join(contexts.select(*keys, F.col(text).alias("_text")), keys, "left").select(*keys, "_text", "_s")
    schema = StructType([sentences.schema[c] for c in (*keys, *ids)] + [StructField(c, IntegerType()) for c in (start, end)])
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in out_schema]
            for *key, context, wanted in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = {} if context is None else first_places(context, {w["s"] for w in wanted if w["s"] is not None})
                for w in wanted:
                    s, known = w["s"], context is not None and w["s"] is not None
                    place = at.get(s, -1) if known else None
                    row = (*key, *[w["id"][c] for c in ids], place, place + len(s) if known else None)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    return rows.mapInArrow(run, schema)
