"""One file per key without a folder, a rename or a listing on the driver; plain tags read once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from figura.sources import markup, readers


def test_keyed_files_share_folders_and_come_back(spark, tmp_path):
    rows = [(f"c{i}-fragment01", f"<text>{i} é</text>") for i in range(600)] + [("twice", "a"), ("twice", None), (None, "lost")]
    docs = spark.createDataFrame(rows, "key string, content string")
    layout = readers.write_keyed_files(docs, str(tmp_path / "source"))
    folders = list((tmp_path / "source").iterdir())
    assert len(folders) <= readers.FOLDERS and sum(len(list(d.iterdir())) for d in folders) == 601
    want = docs.where("key <> 'c7-fragment01'").select("key")
    got = {r.key: r.content for r in readers.scan_keyed_files(spark, str(tmp_path / "source"), want, "key", layout).collect()}
    assert sorted(got.pop("twice").splitlines()) == ["", "a"]
    assert got == {k: f"{x}\n" for k, x in rows[:600] if k != "c7-fragment01"}


def test_files_are_listed_by_tasks(spark, tmp_path):
    shown = ["a.xml", "x/b.xml", "x/y/c.xml", "key=1/_d=1", "key=1/part-0"]
    for name in [*shown, ".a.xml.crc", "_SUCCESS", "_hidden/e.xml", ".f/g.xml", "h._COPYING_"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    spark_lists = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    got = sorted(r.path for r in readers._list_files(spark, str(tmp_path)).collect())
    assert got == sorted(r.path for r in spark_lists.collect()) == sorted(f"file:{tmp_path}/{x}" for x in shown)
    assert [r.path for r in readers._list_files(spark, str(tmp_path / "a.xml")).collect()] == [f"file:{tmp_path}/a.xml"]


def _scanned(docs):
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([c for _, c in docs], pa.string())], names=["doc_id", "content"])
    rows = [r for b in markup._parse_batches(iter([batch])) for r in b.to_pylist()]
    return [r | {"attrs": r["attrs"] if r["attrs"] is None else dict(r["attrs"])} for r in rows]


PLAIN = ["<w>", "</w>", "<W>", "</s>", '<s n="1">', "<br>", "</br>", '<u who="é x"/>', '<text xml:id="a" b="" B="2">', "word", " ", "&amp;", "&#x1;", "&", "> ", "\r\n"]
OTHER = ["<", "<!-- c -->", "<?x?>", "<script>", "</script>", "<title>", "<style>a<b>c</style>", "<a b='1'>", "<a b=1>", '<a b="x>y">', '<a b="&lt;">',
         "<a b>", "</>", "<1>", "<![CDATA[x]]>", "</w >", '<a b="1"c="2">', "<a/b>", "tail &am"]


def test_plain_tags_give_the_nodes_of_the_tokenizer():
    r = random.Random(11)
    docs = [(str(i), "".join(r.choice(PLAIN if i % 2 else PLAIN + OTHER) for _ in range(r.randint(0, 14)))) for i in range(4_000)]
    assert _scanned(docs) == [x for d, c in docs for x in markup.parse_markup(d, c)]


def test_plain_documents_do_not_go_through_the_tokenizer(monkeypatch):
    doc = '<text xml:id="c1"><u who="user"><s n="1"><w>one</w> <w>two &amp; three</w></s></u></text>'
    want = markup.parse_markup("a", doc)

    def whole(*_):
        raise AssertionError("tokenized")
    monkeypatch.setattr(markup, "_TreeBuilder", whole)
    assert _scanned([("a", doc)]) == want
    with pytest.raises(AssertionError, match="tokenized"):
        _scanned([("a", doc + "<!-- no plain tag -->")])


def test_corpus_scan_with_null_ids_and_markup_in_words(spark, tmp_path):
    from figura.plans.q_markup import xml_corpus_scan
    rows = [(i, t, "user", f"a <b> & {i}\nline {t}") for i in range(40) for t in range(2)] + [(None, 0, "user", "x"), (50, 0, None, "y")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.fragment_id: r for r in xml_corpus_scan(spark, str(tmp_path)).collect()}
    whole = [got[f"c{i}-fragment01"] for i in range(40)]
    assert {(r.n_sentences, r.n_words) for r in whole} == {(4, 12)}
    assert {r.source_words_md5 == r.words_md5 for r in whole if r.source_found} == {True}
    assert 0 < sum(not r.source_found for r in whole) < 20
