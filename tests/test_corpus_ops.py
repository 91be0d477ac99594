"""Offset repair, argument extraction, context selection, markup node
table, nearest ancestors and fragments."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from figura.operators import arguments, context
from figura.sources import markup

# FIXTURES.md: raw sentence, 1-based offset, verb -> repaired offset
REPAIR_CASES = [
    ("He Went home", 2, "went", 2),
    ("a He went", 2, "went", 3),
    ("a b He went", 2, "went", 4),
    ("x y z q r", 2, "went", 2),
    ("went x y z q", 4, "went", 4),
    ("went x", 2, "went", 2),
    ("went x", 3, "went", 3),
    ("went y x", 2, "went", 2),
    ("a b went", 0, "went", 0),
    ("went b c", 0, "went", 1),
    ("b went c", 0, "went", 2),
    ("b c d went z", 0, "went", 4),
    ("a", 0, "b", 0),
    ("", 1, "b", 1),
]


def _repair(spark, cases):
    df = spark.createDataFrame([(i, s.split(), o, v) for i, (s, o, v) in enumerate(cases)],
                               "i int, raw_sentence array<string>, word_offset int, verb string")
    out = df.select("i", arguments.repair_word_offset().alias("r")).orderBy("i").collect()
    return [r.r for r in out]


def test_offset_repair_fixture(spark):
    assert _repair(spark, [(s, o, v) for s, o, v, _ in REPAIR_CASES]) == [r for *_, r in REPAIR_CASES]


def _brute(tokens, off, verb):
    """Plain restatement: probe positions off-1, off, off+1 (Python
    indexing, negatives from the end); stop at the first probe outside the
    list."""
    low = [t.lower() for t in tokens]
    for probe, result in ((off - 1, off), (off, off + 1), (off + 1, off + 2)):
        if not -len(low) <= probe < len(low):
            return off
        if low[probe] == verb:
            return result
    return low.index(verb) + 1 if verb in low else off


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "went", "Went", "x"]), max_size=6),
       st.integers(min_value=0, max_value=7), st.sampled_from(["went", "x", "zz"]))
def test_offset_repair_matches_brute_force(spark, toks, off, verb):
    got = _repair(spark, [(" ".join(toks), off, verb)])[0]
    assert got == _brute(toks, off, verb)


def _deps(spark, rows):
    return spark.createDataFrame(
        rows, "sid int, pos int, dependent int, governor int, dep string, dependent_gloss string, "
              "dependent_lemma string, governor_gloss string, governor_lemma string")


def test_argument_rules(spark):
    rows = [
        # 1: subject and object
        (1, 1, 1, 3, "nsubj", "They", "they", "eat", "eat"), (1, 2, 5, 3, "dobj", "Idea", "idea", "eat", "eat"),
        # 2: last nsubj wins
        (2, 1, 1, 3, "nsubj", "He", "he", "x", "x"), (2, 2, 2, 3, "nsubj", "She", "she", "x", "x"),
        # 3: governed, but neither label
        (3, 1, 4, 3, "advmod", "fast", "fast", "x", "x"),
        # 4: verb governs nothing; case relation with governor House
        (4, 1, 3, 6, "case", "of", "of", "House", "house"),
        # 5: two case relations: the first in list order wins
        (5, 1, 3, 7, "case", "of", "of", "Zebra", "zebra"), (5, 2, 3, 6, "case", "of", "of", "Apple", "apple"),
    ]
    verbs = F.broadcast(_deps(spark, rows).select("sid").distinct()).withColumn("word_offset", F.lit(3))
    verbs = verbs.unionByName(verbs.sparkSession.createDataFrame([(6, 3)], "sid int, word_offset int"))
    got = arguments.extract_arguments(_deps(spark, rows), ["sid"], order="pos", verbs=verbs)
    res = {r.sid: (r.subject, r.object, r.subject_lemma, r.object_lemma) for r in got.collect()}
    assert res == {1: ("they", "idea", "they", "idea"), 2: ("she", "", "she", ""), 3: ("", "", "", ""),
                   4: ("", "house", "", "house"), 5: ("", "zebra", "", "zebra"), 6: ("", "", "", "")}


def test_smallest_context_rules(spark):
    df = spark.createDataFrame(
        [(1, "abc", None, "abd", None, None, "abcdefgh", "abc"),
         (2, "ab ", " ab", None, None, None, "zzzzzz", "ab"),
         (3, None, None, None, None, "x  y", "x y z", "y")],
        "k int, paragraph string, utterance string, div_4 string, div_3 string, div_2 string, "
        "div_1 string, sentence_text string")
    out = {r.k: (r.min_kind, r.min_context, r.sentence_start_idx, r.sentence_end_idx)
           for r in context.with_min_context(df).collect()}
    assert out == {1: ("paragraph", "abc", 0, 3), 2: ("paragraph", "ab", 0, 2), 3: ("div_2", "x y", 2, 3)}


LEAF_XML = '<s n="1"><w>The </w><w>Bank</w><w><seg>swallowed</seg></w><c>,</c><gap/><c>.</c></s>'


def test_leaf_tokens_fixture(spark):
    docs = spark.createDataFrame([("d", LEAF_XML)], "doc_id string, content string")
    nodes = markup.node_table(docs)
    target = markup.elements(nodes).where(F.col("tag") == "s").select("doc_id", "pre")
    assert markup.leaf_tokens(nodes, target).first().tokens == ["The", "Bank", "swallowed", ",", "."]


def test_mixed_content_dropped(spark):
    docs = spark.createDataFrame([("d", "<s>lost<w>kept</w><x>a<y>b</y></x></s>")], "doc_id string, content string")
    nodes = markup.node_table(docs)
    target = markup.elements(nodes).where(F.col("tag") == "s").select("doc_id", "pre")
    assert markup.leaf_tokens(nodes, target).first().tokens == ["kept", "b"]


TREE = ('<wtext type="NEWS"><div level="1"><div level="2"><p><s n="1"><w>The</w> <w>cat</w></s></p></div>'
        '<u><s n="2"><w>Hi</w></s></u></div></wtext>')


def test_nearest_ancestors_and_text(spark):
    docs = spark.createDataFrame([("d", TREE)], "doc_id string, content string")
    nodes = markup.node_table(docs).persist()
    el = markup.elements(nodes)
    cands = context.context_candidates(nodes)
    sents = el.where(F.col("tag") == "s").select("doc_id", "pre", "post", F.col("attrs")["n"].alias("n"))
    near = context.nearest_ancestors(sents, cands, ["p", "u", "div_4", "div_3", "div_2"])
    pre_of = {r.tag + (r.attrs.get("level") or ""): r.pre for r in el.collect()}
    got = {r.n: (r.p, r.u, r.div_4, r.div_2) for r in near.join(sents.select("doc_id", "pre", "n"),
                                                                 ["doc_id", "pre"]).collect()}
    assert got == {"1": (pre_of["p"], None, None, pre_of["div2"]), "2": (None, pre_of["u"], None, None)}
    txt = markup.element_text(nodes, el.where(F.col("tag") == "div").select("doc_id", "pre"))
    assert sorted(r.text for r in txt.collect()) == ["The cat", "The catHi"]


def test_fragment_ordinals_fallback(spark):
    divs = spark.createDataFrame([("a", 5, "1"), ("a", 2, "1"), ("a", 3, "2"), ("b", 7, None), ("b", 4, None)],
                                 "doc_id string, pre int, level string")
    got = sorted((r.doc_id, r.fragment_n, r.pre) for r in context.fragment_ordinals(divs).collect())
    assert got == [("a", 1, 2), ("a", 2, 5), ("b", 1, 4), ("b", 2, 7)]


def test_unbalanced_markup_does_not_fail(spark):
    docs = spark.createDataFrame([("d", "<p><b>x<br><p>y</p></i>&amp;")], "doc_id string, content string")
    rows = markup.node_table(docs).collect()
    assert [r.text for r in rows if r.tag == "#text"] == ["x", "y", "&"]
    assert all(r.post is not None for r in rows)


@pytest.mark.parametrize("n", [1, 17])
def test_first_sentence_is_first_in_document_order(spark, n):
    s = spark.createDataFrame([("f", "1", 9, "late"), ("f", "1", 3, "early"), ("f", "2", 5, "other")],
                              "text_segment_id string, sentence_number string, pre int, sentence string")
    ex = spark.createDataFrame([("f", "1"), ("f", "3")], "text_segment_id string, sentence_number string")
    got = sorted((r.sentence_number, r.sentence) for r in
                 context.lookup_sentences(ex, s.repartition(n)).collect())
    assert got == [("1", "early"), ("3", None)]


def test_stripped_lengths_match_text(spark):
    from figura.functions.text import strip
    docs = spark.createDataFrame(
        [("a", "<d><p>  </p><p> x y \n</p><q>\t</q></d>"),
         ("b", "<d>\n<s> </s>\n</d>"),
         ("c", "<d><w>ab</w> <w> c </w></d>"),
         ("e", "<d></d>")], "doc_id string, content string")
    nodes = markup.node_table(docs).persist()
    el = markup.elements(nodes).select("doc_id", "pre")
    got = {(r.doc_id, r.pre): r.stripped_len for r in markup.element_stripped_lengths(nodes, el).collect()}
    want = {(r.doc_id, r.pre): r.n for r in markup.element_text(nodes, el)
            .select("doc_id", "pre", F.length(strip("text")).alias("n")).collect()}
    assert got == want
