"""Verb arguments from dependency tables, and word-offset repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dependency labels read as subject / object / case marker.
SUBJECT_LABEL = "nsubj"
OBJECT_LABEL = "dobj"
CASE_LABEL = "case"

_DEPENDENCIES = 20_000     # dependencies of the sentences that are Python objects at once


def _py_get(arr: Column, i: Column) -> tuple[Column, Column]:
    """Python-style ``arr[i]`` (negative counts from the end): returns
    (in_range, lower-cased element)."""
    n = F.size(arr)
    ok = (i >= -n) & (i < n)
    return ok, F.lower(F.get(arr, F.when(i < 0, n + i).otherwise(i)))


def py_item(arr: Column, i: Column) -> tuple[Column, Column]:
    """``arr[i].lower()`` with Python indexing: (in_range, value)."""
    return _py_get(arr, i)


def repair_word_offset(raw: str | Column = "raw_sentence", offset: str | Column = "word_offset",
                       verb: str | Column = "verb") -> Column:
    """1-based verb offset repair against the raw tokens.

    Keep the offset if the token there is the verb; else try +1, then +2;
    else the verb's first position; keep the offset when the verb is not in
    the sentence. As soon as a probe falls outside the sentence the offset
    is kept unchanged (even if the verb occurs elsewhere), and so it is
    without a sentence or a verb.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    o = F.col(offset) if isinstance(offset, str) else offset
    v = F.col(verb) if isinstance(verb, str) else verb
    ok1, t1 = _py_get(raw, o - 1)
    ok2, t2 = _py_get(raw, o)
    ok3, t3 = _py_get(raw, o + 1)
    first = F.array_position(F.transform(raw, lambda t: F.lower(t)), v)
    return (F.when(raw.isNull() | v.isNull(), o).when(~ok1, o).when(t1 == v, o)
            .when(~ok2, o).when(t2 == v, o + 1)
            .when(~ok3, o).when(t3 == v, o + 2)
            .when(first == 0, o)
            .otherwise(first.cast("int")))


def extract_arguments(deps: DataFrame, keys: list[str], order: str = "dependent",
                      verbs: DataFrame | None = None) -> DataFrame:
    """Subject / object (gloss and lemma) of every candidate verb position.

    ``deps``: one row per dependency of a sentence, ``keys`` identify the
    sentence; columns ``dependent`` (1-based index, also the list order),
    ``governor`` (0 = root), ``dep``, ``dependent_gloss``,
    ``dependent_lemma``, ``governor_gloss``, ``governor_lemma``; ``order``
    is the position in the parser's dependency list (by default the
    dependent index, the order parsers list basic dependencies in).

    ``verbs`` lists the examples ``(keys..., word_offset)``; by default
    every dependent of every sentence is a candidate verb. Rules:
    among dependencies governed by the verb, the last ``nsubj`` is the
    subject and the last ``dobj`` the object. When the verb governs
    nothing, its first ``case`` relation puts the governor in the object
    slot. Otherwise all four are blank.
    """
    governed = (deps.where(F.col("governor") > 0)
                .groupBy(*keys, F.col("governor").alias("word_offset"))
                .agg(F.max(F.when(F.col("dep") == SUBJECT_LABEL,
                                  F.struct(F.col(order).alias("_ord"), "dependent_gloss", "dependent_lemma")))
                     .alias("_s"),
                     F.max(F.when(F.col("dep") == OBJECT_LABEL,
                                  F.struct(F.col(order).alias("_ord"), "dependent_gloss", "dependent_lemma")))
                     .alias("_o"),
                     F.lit(True).alias("_gov")))
    first_case = (deps.where(F.col("dep") == CASE_LABEL)
                  .groupBy(*keys, F.col("dependent").alias("word_offset"))
                  .agg(F.min(F.struct(F.col(order).alias("_ord"), "governor_gloss", "governor_lemma"))
                       .alias("_c")))
    if verbs is None:
        verbs = deps.select(*keys, F.col("dependent").alias("word_offset")).distinct()
    j = (verbs.join(governed, [*keys, "word_offset"], "left")
         .join(first_case, [*keys, "word_offset"], "left"))
    gov = F.coalesce(F.col("_gov"), F.lit(False))
    blank = F.lit("")

    def pick(gov_val, case_val):
        return F.when(gov, F.coalesce(F.lower(gov_val), blank)) \
            .otherwise(F.coalesce(F.lower(case_val), blank))

    return j.select(
        *keys, "word_offset",
        pick(F.col("_s.dependent_gloss"), F.lit(None)).alias("subject"),
        pick(F.col("_o.dependent_gloss"), F.col("_c.governor_gloss")).alias("object"),
        pick(F.col("_s.dependent_lemma"), F.lit(None)).alias("subject_lemma"),
        pick(F.col("_o.dependent_lemma"), F.col("_c.governor_lemma")).alias("object_lemma"))


def deps_long(parsed: DataFrame, key: str = "id") -> DataFrame:
    """Parser output in nested form (``tokens`` array of ``struct<lemma>``,
    ``deps`` array of ``struct<dep, governor, governorGloss, dependent,
    dependentGloss>``) -> one row per dependency with lemmas looked up by
    1-based index (list position kept as ``dep_pos``)."""
    lem = F.transform(F.col("tokens"), lambda t: t["lemma"])
    rows = parsed.select(key, lem.alias("_lem"), F.posexplode("deps").alias("dep_pos", "d"))
    gov = F.col("d.governor")
    return rows.select(
        key, "dep_pos", F.col("d.dependent").alias("dependent"), gov.alias("governor"),
        F.col("d.dep").alias("dep"), F.col("d.dependentGloss").alias("dependent_gloss"),
        F.try_element_at(F.col("_lem"), F.col("d.dependent")).alias("dependent_lemma"),
        F.col("d.governorGloss").alias("governor_gloss"),
        F.when(gov > 0, F.try_element_at(F.col("_lem"), gov)).alias("governor_lemma"))


def arguments_in_row(tokens: str | Column = "tokens", deps: str | Column = "deps", offset: str | Column = "word_offset") -> list[Column]:
    """``subject, object, subject_lemma, object_lemma`` of the verb at
    ``offset``, by the rules of ``extract_arguments``, from the parser's nested
    form in the same row: no row is exploded and nothing is shuffled. Without
    a parse or an offset all four are blank."""
    tokens, deps, offset = (F.col(c) if isinstance(c, str) else c for c in (tokens, deps, offset))
    governed = F.filter(deps, lambda d: (d["governor"] == offset) & (d["governor"] > 0))
    last = lambda label: F.try_element_at(F.filter(governed, lambda d: d["dep"] == label), F.lit(-1))
    case = F.get(F.filter(deps, lambda d: (d["dep"] == CASE_LABEL) & (d["dependent"] == offset)), 0)
    subj, obj = last(SUBJECT_LABEL), last(OBJECT_LABEL)
    lemma = lambda i: F.when(i > 0, F.get(tokens, i - 1)["lemma"])
    governs = F.coalesce(F.size(governed), F.lit(0)) > 0

    def pick(gov_val, case_val, name):
        return F.coalesce(F.lower(F.when(governs, gov_val).otherwise(case_val)), F.lit("")).alias(name)
    return [pick(subj["dependentGloss"], F.lit(None), "subject"), pick(obj["dependentGloss"], case["governorGloss"], "object"),
            pick(lemma(subj["dependent"]), F.lit(None), "subject_lemma"), pick(lemma(obj["dependent"]), lemma(case["governor"]), "object_lemma")]


def all_arguments(parses: DataFrame, keys: list[str], deps: str = "deps") -> DataFrame:
    """``(keys, word_offset, subject, object, subject_lemma, object_lemma)`` of
    every dependent of every sentence taken as the verb, by the rules of
    ``extract_arguments``.

    ``parses`` has a row per sentence with ``deps``, an array in list order of
    ``struct<dep, governor, dependent, dependent_gloss, dependent_lemma,
    governor_gloss, governor_lemma>``. Each sentence is read once, in its row:
    linear in its length and without a shuffle; a batch is taken through in
    pieces of ``_DEPENDENCIES`` dependencies. Null and empty parses give no
    rows."""
    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        at: list[int] = []
        out: list[tuple] = []
        for i, parse in enumerate(b.column(len(keys)).to_pylist()):
            parse = parse or ()
            subj, obj, case, governs = {}, {}, {}, set()
            for d in parse:
                if d["governor"] and d["governor"] > 0:
                    governs.add(d["governor"])
                    if d["dep"] == SUBJECT_LABEL:
                        subj[d["governor"]] = (d["dependent_gloss"], d["dependent_lemma"])
                    elif d["dep"] == OBJECT_LABEL:
                        obj[d["governor"]] = (d["dependent_gloss"], d["dependent_lemma"])
                if d["dep"] == CASE_LABEL:
                    case.setdefault(d["dependent"], (d["governor_gloss"], d["governor_lemma"]))
            for verb in dict.fromkeys(d["dependent"] for d in parse):
                s = subj.get(verb, ("", ""))
                o = (obj if verb in governs else case).get(verb, ("", ""))
                at.append(i)
                out.append((verb, *[(x or "").lower() for x in (s[0], o[0], s[1], o[1])]))
        verb, *texts = zip(*out, strict=True) if out else [()] * 5
        ids = [c.take(pa.array(at, pa.int64())) for c in b.columns[:len(keys)]]
        return pa.RecordBatch.from_arrays([*ids, pa.array(verb, pa.int32()), *[pa.array(t, pa.string()) for t in texts]],
                                          names=[*keys, "word_offset", "subject", "object", "subject_lemma", "object_lemma"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(len(keys))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:               # as many sentences as fit, one at least
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _DEPENDENCIES, "right")))
                yield work(b.slice(at, to - at))
                at = to

    rows = parses.select(*keys, deps)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keys)])
    return rows.mapInArrow(run, f"{kinds}, word_offset int, subject string, object string, subject_lemma string, object_lemma string")
