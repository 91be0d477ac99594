"""Structural joins against ancestor lists; deep nesting; fragments around
others; keyed files that are never opened."""

import random

import pytest
from pyspark.sql import functions as F

from figura.operators import context, structural
from figura.sources import markup, readers


def tree(rng, n):
    out, open_ = [], []
    for _ in range(n):
        x = rng.random()
        if x < .35 or not open_:
            tag = rng.choice(["a", "b", "s", "p"])
            out.append(f"<{tag}>")
            open_.append(tag)
        elif x < .6:
            out.append(f"</{open_.pop()}>")
        else:
            out.append(rng.choice(["x", " y ", "  ", "\n", "z&amp;", "é"]))
    return "".join(out)


def plain(rows):
    """Nodes of one document with their ancestors, from the parent column."""
    by = {r["pre"]: r for r in rows}
    for r in rows:
        up, p = [], r["parent"]
        while p is not None:
            up.append(p)
            p = by[p]["parent"]
        r["up"] = up
    return by


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs = [(f"d{i}", tree(rng, rng.randint(0, 80))) for i in range(25)] + [("none", None), ("empty", "")]
    nodes = markup.node_table(spark.createDataFrame(docs, "doc_id string, content string").repartition(3)).persist()
    return nodes, {d: plain(markup.parse_markup(d, c)) for d, c in docs}


def test_no_ancestor_lists(corpus):
    assert "ancestors" not in corpus[0].columns


def test_nearest(corpus):
    nodes, want = corpus
    el = markup.elements(nodes)
    near = context.nearest_ancestors(nodes.where("tag = 's'"), el.select("doc_id", "pre", "post", F.col("tag").alias("kind")), ["a", "p", "zz"])
    got = {(r.doc_id, r.pre): (r.a, r.p, r.zz) for r in near.collect()}
    tag = lambda by, r, t: next((p for p in r["up"] if by[p]["tag"] == t), None)
    assert got == {(d, r["pre"]): (tag(by, r, "a"), tag(by, r, "p"), None) for d, by in want.items() for r in by.values() if r["tag"] == "s"}


def test_enclosing(corpus):
    nodes, want = corpus
    a = nodes.where("tag = 'a'")
    got = sorted((r.doc_id, r.pre, r.v) for r in structural.enclosing(nodes.where("tag = 's'"), a, F.col("pre"), name="v").collect())
    assert got == sorted((d, r["pre"], p) for d, by in want.items() for r in by.values() if r["tag"] == "s" for p in r["up"] if by[p]["tag"] == "a")


def test_texts(corpus):
    nodes, want = corpus
    el = markup.elements(nodes).select("doc_id", "pre")
    got = {(r.doc_id, r.pre): r.text for r in markup.element_text(nodes, el).collect()}
    runs = lambda by, r: [x for x in sorted(by.values(), key=lambda x: x["pre"]) if x["tag"] == "#text" and r["pre"] in x["up"]]
    every = [(d, by, r) for d, by in want.items() for r in by.values() if r["tag"] != "#text"]
    assert got == {(d, r["pre"]): "".join(x["text"] for x in runs(by, r)) for d, by, r in every}
    lengths = {(r.doc_id, r.pre): r.stripped_len for r in markup.element_stripped_lengths(nodes, el).collect()}
    assert lengths == {k: len(t.strip()) for k, t in got.items()}
    tokens = {(r.doc_id, r.pre): r.tokens for r in markup.leaf_tokens(nodes, el).collect()}

    def leaves(by, r):
        found = {}
        for x in runs(by, r):
            if x["in_leaf"] and x["parent"] != r["pre"]:
                found[x["parent"]] = found.get(x["parent"], "") + x["text"]
        return " ".join(found.values()).split()
    assert tokens == {(d, r["pre"]): leaves(by, r) for d, by, r in every}


def test_repeated_targets_and_extra_columns(corpus):
    nodes, _ = corpus
    t = markup.elements(nodes).where("tag = 'p'").select("doc_id", "pre", "post", F.lit(1).alias("side"), F.lit("x").alias("leaf"))
    twice = t.unionAll(t)
    got = markup.element_text(nodes, twice, "out")
    assert got.count() == twice.count() and set(got.columns) == {"doc_id", "pre", "post", "side", "leaf", "out"}


def test_a_hundred_thousand_nested_tags(spark):
    n = 100_000
    doc = "<d>" * n + "<s>deep</s>" + "</d>" * n + "</zz>" * n
    nodes = markup.node_table(spark.createDataFrame([("deep", doc)], "doc_id string, content string")).persist()
    assert nodes.count() == n + 2
    s = nodes.where("tag = 's'")
    near = context.nearest_ancestors(s, nodes.where("tag = 'd'").withColumn("kind", F.lit("d")), ["d"]).first()
    assert near.d == n - 1
    top = nodes.where("pre IN (0, 5, 99999)").select("doc_id", "pre", "post")
    assert {r.text for r in markup.element_text(nodes, top).collect()} == {"deep"}
    lengths = markup.element_stripped_lengths(nodes, markup.elements(nodes).select("doc_id", "pre", "post"))
    assert lengths.where("stripped_len <> 4").isEmpty()


NESTED = """<corpus><text><group>
<text xml:id="a1"><s>one</s></text>
<text xml:id='out'>before<text xml:id="in1">i1</text>mid<text type="x" xml:id = 'in2'>i2<textual/></text>after</text>
<textx xml:id="no">not</textx><text/>
<text xml:id="o1"><text xml:id="o2"><text xml:id="o3">deep</text></text><text>anon</text>tail</text>
<text xml:id="z">last</text>
</group></text></corpus>
"""


@pytest.mark.parametrize("split", [None, "70"])
def test_fragments_at_any_nesting(spark, tmp_path, split):
    (tmp_path / "c.xml").write_text(NESTED)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.fragment_id: r.content for r in readers.scan_fragments(spark, str(tmp_path / "c.xml")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.pop("") == "<text>anon</text>"
    assert got == {
        "a1": '<text xml:id="a1"><s>one</s></text>', "in1": '<text xml:id="in1">i1</text>',
        "in2": "<text type=\"x\" xml:id = 'in2'>i2<textual/></text>",
        "out": "<text xml:id='out'>before<text xml:id=\"in1\">i1</text>mid<text type=\"x\" xml:id = 'in2'>i2<textual/></text>after</text>",
        "o3": '<text xml:id="o3">deep</text>', "o2": '<text xml:id="o2"><text xml:id="o3">deep</text></text>',
        "o1": '<text xml:id="o1"><text xml:id="o2"><text xml:id="o3">deep</text></text><text>anon</text>tail</text>',
        "z": '<text xml:id="z">last</text>'}


def test_long_outer_fragment(spark, tmp_path):
    inner = "".join(f'<text xml:id="i{k}">{k}</text>\n' for k in range(500))
    (tmp_path / "c.xml").write_text(f'<text xml:id="all">{inner}</text>')
    got = {r.fragment_id: r.content for r in readers.scan_fragments(spark, str(tmp_path / "c.xml")).collect()}
    assert len(got) == 501 and got["all"] == f'<text xml:id="all">{inner}</text>' and got["i77"] == '<text xml:id="i77">77</text>'


def test_unwanted_files_are_never_opened(spark, tmp_path):
    for key in ("ABC", "ABD", "XYZ"):
        d = tmp_path / key[0] / key[:2]
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{key}.xml").write_text(f"<x>{key} é</x>")
    with open(tmp_path / "A" / "AB" / "BIG.xml", "wb") as f:
        f.truncate(1 << 42)          # 4 TB of nothing: opening it would end the test
    keys = spark.createDataFrame([("ABC",), ("XYZ",), ("XYZ",), ("NONE",), (None,)], "k string")
    got = readers.scan_keyed_files(spark, str(tmp_path), keys, "k")
    assert sorted((r.key, r.content) for r in got.collect()) == [("ABC", "<x>ABC é</x>"), ("XYZ", "<x>XYZ é</x>")]
    assert readers.scan_keyed_files(spark, str(tmp_path), keys.limit(0), "k").isEmpty()
