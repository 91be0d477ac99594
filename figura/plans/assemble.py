"""Corpus assembly as one Spark job: labelled verb examples + annotated
corpus + source corpus + dependency parses + lemmas -> the example table.

Inputs are DataFrames (see ``figura.sources`` for the readers):

* ``train_index`` (``id``, ``genre``, ``partition``, ``fold_no``, ...) and
  ``train_labels`` (``id``, ``y``); ``test_labels`` (``id``, ``y``);
* ``annotated`` node table, one document per fragment (``doc_id`` = the
  fragment's ``xml:id``), e.g. ``node_table(scan_fragments(...))``;
* ``source`` node table, one document per source file (``doc_id`` = the
  3-character corpus part, e.g. ``A1B``);
* ``deps`` in the parser's nested form (``id``, ``tokens`` array of
  ``struct<lemma>``, ``deps`` array of ``struct<dep, governor,
  governorGloss, dependent, dependentGloss>``), first sentence only;
* ``lemmas`` (``verb_lemma``, ``id``), e.g. the union of two lemma files.

Every step is a join, aggregation or column expression; the only Python
runs inside the markup scan that produced the node tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from figura.functions import ids
from figura.functions import text as T
from figura.operators import arguments, context, corpus, structural
from figura.session import staged
from figura.sources import markup

KINDS = ["p", "u", "div_4", "div_3", "div_2"]
LEVEL_COLS = {"p": "paragraph", "u": "utterance", "div_4": "div_4", "div_3": "div_3", "div_2": "div_2"}
# Fixed value: elements that carry a source document's text type.
TEXT_UNITS = ("wtext", "stext")


def annotated_sentences(nodes: DataFrame) -> DataFrame:
    """``(text_segment_id, sentence_number, pre, raw_sentence, sentence)``
    for every ``s[@n]`` of each fragment (lookups take the first by
    ``pre``)."""
    s = (markup.elements(nodes).where(F.col("tag") == "s")
         .select("doc_id", "pre", "post", F.col("attrs").getItem("n").alias("sentence_number")))
    toks = markup.leaf_tokens(nodes, s, "raw_sentence")
    full = toks.drop("post").withColumnRenamed("doc_id", "text_segment_id")
    return full.withColumn("sentence", T.word_tokens(T.join_tokens("raw_sentence")))


def source_genres(nodes: DataFrame) -> DataFrame:
    """Genre per source document from its single text unit's type; docs
    with zero or several text units are flagged."""
    units = markup.elements(nodes).where(F.col("tag").isin(*TEXT_UNITS))
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        corpus.genre_of(F.min(F.col("attrs").getItem("type"))).alias("genre"))


def source_contexts(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request ``(bnc_file, bnc_file_n, sentence_number)``: the
    smallest enclosing context (paragraph, utterance, level-4/3/2 div, or
    the fragment; shortest stripped text, ties to the earlier kind), its
    kind, the sentence span inside it, the document genre and how many text
    units the document has (``n_units``).

    Candidates are compared by stripped length computed from text-run
    statistics; only the winning element's text is ever built, so a large
    fragment is not copied onto every sentence that asks for it."""
    el = markup.elements(nodes)
    divs = el.where(F.col("tag") == "div").select("doc_id", "pre", "post", F.col("attrs").getItem("level").alias("level"))
    frags = context.fragment_ordinals(divs)
    req = requests.select(F.col("bnc_file").alias("doc_id"), "bnc_file", "bnc_file_n", "sentence_number",
                          corpus.source_sentence_number("sentence_number").alias("n")).distinct()
    # sentences whose number is asked for, with every fragment around them
    s = el.where(F.col("tag") == "s").select("doc_id", "pre", "post", F.col("attrs").getItem("n").alias("n"))
    s = s.join(req.select("doc_id", "n").distinct(), ["doc_id", "n"])
    inside = structural.enclosing(s, frags, F.struct("fragment_n", "pre", "post"), name="frag")
    s_in_frag = s.join(inside, ["doc_id", "pre"]).select(
        "doc_id", "n", F.col("frag.fragment_n").alias("bnc_file_n"), F.struct("pre", "post").alias("s"),
        F.struct("frag.pre", "frag.post").alias("f"))
    hit = (req.join(s_in_frag, ["doc_id", "bnc_file_n", "n"])
           .groupBy("doc_id", "bnc_file", "bnc_file_n", "sentence_number")
           .agg(F.min(F.struct("s", "f")).alias("_h"))
           .select("doc_id", "bnc_file", "bnc_file_n", "sentence_number", "_h.s", "_h.f"))
    hit = staged(hit, "requested-sentences")     # read by four branches below
    targets = hit.select("doc_id", "s.pre", "s.post").distinct()
    near = context.nearest_ancestors(targets, context.context_candidates(nodes), KINDS, value=F.struct("pre", "post"))
    # candidate contexts of every sentence, in tie-break order
    cand = near.select("doc_id", F.col("pre").alias("s_pre"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("prio"), F.lit(LEVEL_COLS[k]).alias("kind"), F.col(k).alias("a"))
        for i, k in enumerate(KINDS)])).alias("x")) \
        .select("doc_id", "s_pre", "x.prio", "x.kind", "x.a").where(F.col("a").isNotNull())
    cand = staged(cand.unionByName(hit.select("doc_id", F.col("s.pre").alias("s_pre"), F.lit(len(KINDS)).alias("prio"),
                                              F.lit("div_1").alias("kind"), F.col("f").alias("a"))),
                  "context-candidates")
    lens = markup.element_stripped_lengths(nodes, cand.select("doc_id", "a.pre", "a.post").distinct(), "slen")
    best = (cand.join(lens.select("doc_id", F.struct("pre", "post").alias("a"), "slen"), ["doc_id", "a"])
            .groupBy("doc_id", "s_pre").agg(F.min(F.struct("slen", "prio", "kind", "a")).alias("_b"))
            .select("doc_id", "s_pre", F.col("_b.kind").alias("min_kind"), F.col("_b.a").alias("a")))
    best = staged(best, "context-winners")
    # texts of the winners and of the sentences only
    need = best.select("doc_id", "a.pre", "a.post").unionByName(hit.select("doc_id", "s.pre", "s.post")).distinct()
    texts = staged(markup.element_text(nodes, need), "context-texts")
    win = best.join(texts.select("doc_id", F.struct("pre", "post").alias("a"), F.col("text").alias("_ctx")), ["doc_id", "a"])
    sent = texts.select("doc_id", F.col("pre").alias("s_pre"), F.col("text").alias("_sent"))
    hit = hit.withColumn("s_pre", F.col("s.pre")).drop("s", "f")
    out = (hit.join(win, ["doc_id", "s_pre"], "left").join(sent, ["doc_id", "s_pre"], "left")
           .withColumn("min_context", T.normalize_whitespace("_ctx")))
    span = T.char_span(F.col("min_context"), T.normalize_whitespace(F.col("_sent")))
    return (out.withColumn("sentence_start_idx", span["start"]).withColumn("sentence_end_idx", span["end"])
            .join(source_genres(nodes), "doc_id", "left")
            .drop("doc_id", "s_pre", "a", "_ctx", "_sent"))


def assemble_examples(train_index: DataFrame, train_labels: DataFrame, test_labels: DataFrame,
                      annotated: DataFrame, source: DataFrame, deps: DataFrame,
                      lemmas: DataFrame, keep_kind: bool = False, audit: bool = False,
                      observation: Observation | None = None, part_length: int | None = ids.PART_LENGTH) -> DataFrame:
    """The example table (one row per labelled verb), with ``keep_kind`` also
    the kind of context chosen (``min_kind``). What several
    branches read (node tables, sentences, examples) is written once to the
    shared folder.

    ``audit`` adds ``reject``, the first reason of ``REJECTS`` that a row
    falls under (null for none); ``observation`` gets the number of examples
    and of each reason from the job that writes the table, without a scan of
    its own. ``part_length`` is the length of a corpus part in a valid id
    (None: any). A sentence has one parse in ``deps``."""
    annotated = staged(annotated, "annotated-nodes")
    source = staged(source, "source-nodes")
    keys = ["bnc_file", "bnc_file_n", "sentence_number"]
    sents = staged(annotated_sentences(annotated), "annotated-sentences")   # train and test
    train = corpus.join_labels(corpus.parse_train_ids(train_index), train_labels)
    train = context.lookup_sentences(train, sents).drop("pre")
    test = corpus.parse_test_ids(test_labels)
    ok, token = arguments.py_item(F.col("raw_sentence"), F.col("word_offset") - 1)
    test = context.lookup_sentences(test, sents).drop("pre").withColumn("verb", F.when(ok, token))
    train, test = staged(train, "train-examples"), staged(test, "test-examples")
    requests = train.select(*keys).unionByName(test.select(*keys))
    ctx = staged(source_contexts(source, requests), "contexts")     # train and test
    train = train.join(ctx.drop("genre"), keys, "left")
    test = (test.join(ctx, keys, "left")
            .withColumn("partition", F.lit("test")).withColumn("fold_no", F.lit(0)))
    ex = corpus.union_examples(train, test)
    ex = staged(ex.withColumn("word_offset", arguments.repair_word_offset()), "examples")
    parses = deps.select("id", "tokens", "deps")
    ex = ex.join(parses, "id", "left").select("*", *arguments.arguments_in_row()).drop("tokens", "deps")
    ex = corpus.join_lemmas(ex, lemmas).withColumn("reject", reject_reason(part_length))
    if observation is not None:
        ex = ex.observe(observation, F.count(F.lit(1)).alias("examples"),
                        *[F.count_if(F.col("reject") == r).alias(r) for r in REJECTS])
    ex = corpus.finalize_examples(ex if keep_kind else ex.drop("min_kind"))
    return ex.drop("n_units") if audit else ex.drop("n_units", "reject")


# Why the job would have stopped at an example, in the order it would find out.
REJECTS = ("id", "sentence", "context", "span", "text units")


def reject_reason(part_length: int | None = ids.PART_LENGTH):
    """The first of ``REJECTS``: a malformed id, no such sentence, no context,
    a sentence that is not inside its context, a source document without
    exactly one text unit. Null for a good row."""
    ok = F.coalesce(ids.segment_valid("text_segment_id", part_length), F.lit(False)) & F.col("bnc_file_n").isNotNull() \
        & F.col("sentence_number").isNotNull() & F.col("word_offset").isNotNull()
    tests = (~ok, F.col("sentence").isNull(), F.col("min_context").isNull(),
             F.coalesce(F.col("sentence_start_idx") < 0, F.lit(True)), F.coalesce(F.col("n_units") != 1, F.lit(True)))
    return F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REJECTS, strict=True)])


def is_reject():
    """True where the job would have stopped: no sentence, no context, or a
    sentence that is not inside its chosen context."""
    return (F.col("sentence").isNull() | F.col("min_context").isNull()
            | F.coalesce(F.col("sentence_start_idx") < 0, F.lit(True)))


def assembly_rejects(examples: DataFrame) -> DataFrame:
    """The rejected examples."""
    return examples.where(is_reject())
