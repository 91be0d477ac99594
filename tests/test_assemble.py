"""End to end: a tiny annotated corpus (one file, two fragments) and a
tiny source corpus (one file per key) assembled into the example table."""

from figura.plans.assemble import assemble_examples, assembly_rejects
from figura.sources import markup, readers

ANNOTATED = (
    '<TEI><teiHeader/>'
    '<text xml:id="a1b-fragment01"><body><s n="1"><w>The</w> <w>bank</w> <w>swallowed</w> <w>it</w>'
    '<c>.</c></s><s n="2"><w>Money</w> <w>talks</w></s></body></text>\n'
    '<text xml:id="kdb-fragment02"><s n="675a"><w>He</w> <w>ran</w></s></text></TEI>')
SOURCE = {
    "A1B": ('<bncDoc><wtext type="NEWS"><div level="1"><head>x</head><p><s n="1"><w hw="the">The </w>'
            '<w>bank </w><w>swallowed </w><w>it</w><c>.</c></s><s n="2"><w>Money </w><w>talks</w></s></p>'
            '</div></wtext></bncDoc>'),
    "KDB": ('<bncDoc><stext type="CONVRSN"><div><u who="A"><s n="1"><w>Hi</w></s></u></div>'
            '<div><u who="B"><s n="675"><w>He </w><w>ran</w></s></u></div></stext></bncDoc>'),
}


def test_assemble_tiny_corpus(spark, tmp_path):
    (tmp_path / "VUAMC.xml").write_text(ANNOTATED)
    for key, xml in SOURCE.items():
        d = tmp_path / "source" / key[0] / key[:2]
        d.mkdir(parents=True)
        (d / f"{key}.xml").write_text(xml)
    frags = readers.scan_fragments(spark, str(tmp_path / "VUAMC.xml"))
    annotated = markup.node_table(frags.withColumnRenamed("fragment_id", "doc_id"))
    keys = spark.createDataFrame([("A1B",), ("KDB",)], "k string")
    src = readers.scan_keyed_files(spark, str(tmp_path / "source"), keys, "k")
    source = markup.node_table(src.withColumnRenamed("key", "doc_id"))

    index = spark.createDataFrame(
        [("a1b-fragment01_1_0_3_0_swallowed", "news", "train", 1),
         ("a1b-fragment01_2_0_1_0_talks", "news", "train", 2)],
        "id string, genre string, partition string, fold_no int")
    labels = spark.createDataFrame([("a1b-fragment01_1_0_3_0_swallowed", 1),
                                    ("a1b-fragment01_2_0_1_0_talks", 0)], "id string, y int")
    test_labels = spark.createDataFrame([("kdb-fragment02_675a_2", 0)], "id string, y int")
    dep_t = "struct<dep:string,governor:int,governorGloss:string,dependent:int,dependentGloss:string>"
    deps = spark.createDataFrame(
        [("a1b-fragment01_1_0_3_0_swallowed", [("the",), ("bank",), ("swallow",), ("it",), (".",)],
          [("det", 2, "bank", 1, "The"), ("nsubj", 3, "swallowed", 2, "bank"),
           ("dobj", 3, "swallowed", 4, "it")]),
         ("a1b-fragment01_2_0_1_0_talks", [("money",), ("talk",)], [("nsubj", 2, "talks", 1, "Money")])],
        f"id string, tokens array<struct<lemma:string>>, deps array<{dep_t}>")
    lemmas = spark.createDataFrame([("swallow", "a1b-fragment01_1_0_3_0_swallowed"),
                                    ("talk", "a1b-fragment01_2_0_1_0_talks"),
                                    ("run", "kdb-fragment02_675a_2")], "verb_lemma string, id string")

    ex = assemble_examples(index, labels, test_labels, annotated, source, deps, lemmas).persist()
    got = {r.id: r for r in ex.collect()}
    assert set(got) == {"a1b-fragment01_1_0_3_0_swallowed", "a1b-fragment01_2_0_1_0_talks",
                        "kdb-fragment02_675a_2"}
    a = got["a1b-fragment01_1_0_3_0_swallowed"]
    assert a.sentence == "The bank swallowed it ."
    assert a.min_context == "The bank swallowed it.Money talks"
    assert (a.sentence_start_idx, a.sentence_end_idx) == (0, 22)
    assert (a.subject, a.object, a.subject_lemma, a.object_lemma) == ("bank", "it", "bank", "it")
    assert (a.word_offset, a.verb_lemma, a.genre, a.partition, a.bnc_file, a.bnc_file_n) == \
        (3, "swallow", "news", "train", "A1B", 1)
    # offset 1 points at "Money"; the verb "talks" is one further: repaired to 2
    b = got["a1b-fragment01_2_0_1_0_talks"]
    assert b.word_offset == 2 and (b.sentence_start_idx, b.sentence_end_idx) == (22, 33)
    # the repaired offset governs "Money"
    assert (b.subject, b.object, b.subject_lemma) == ("money", "", "money")
    t = got["kdb-fragment02_675a_2"]
    assert (t.verb, t.word_offset, t.genre, t.partition, t.sentence_number) == \
        ("ran", 2, "conversation", "test", "675a")
    assert t.min_context == "He ran" and (t.subject, t.object) == ("", "")
    assert assembly_rejects(ex).count() == 0
