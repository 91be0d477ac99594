"""Driver queries: markup node table (pages, derived XML corpora) and the
file-format round trips (nested JSON lines, CSV blanks).

Files are staged under the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text as T
from figura.functions.hashing import bucket
from figura.operators import corpus
from figura.plans.catalog import register
from figura.plans.q_features import _ROLES_SQL, _roles, drawn_word, sql_drawn_word
from figura.plans.q_text import SQL_WORD_TOKENS, SQL_WS_TOKENS
from figura.plans.tables import read, read_spread, sql_bucket
from figura.session import shared_path, staged
from figura.sources import markup, readers

NL = "chr(10)"


def _page_nodes(spark, sf_dir):
    """Parsed pages, written once: the node table feeds several joins."""
    pages = read(spark, sf_dir, "pages")
    return staged(markup.node_table(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")),
                                    min_partitions=spark.sparkContext.defaultParallelism), "page-nodes")


# Words that lie in an element beside its children, and in nested elements.
MIXED = "<ul>loose <b>kept <i>inner</i> lost</b> text<li><a href=\"x\">link </a>beside</li></ul>"


def leaf_tokens(spark, sf_dir):
    """Tokens of each list: texts of its leaf descendants in document order.
    Each page's navigation list is followed by a list with mixed content, of
    which only the leaves' words count."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat("html", F.lit(MIXED)).alias("content"))
    nodes = staged(markup.node_table(pages, min_partitions=spark.sparkContext.defaultParallelism), "page-nodes")
    targets = markup.elements(nodes).where(F.col("tag") == "ul").select("doc_id", "pre", "post")
    toks = markup.leaf_tokens(nodes, targets)
    return toks.select(F.col("doc_id").cast("bigint").alias("page_id"),
                       F.size("tokens").alias("n_tokens"), T.join_tokens("tokens").alias("tokens"))


_LINK_TEXTS = """array_to_string(regexp_extract_all(substr(html, instr(html, '<ul>'),
                   instr(html, '</ul>') - instr(html, '<ul>')), '<a href="[^"]*">([^<]*)</a>', 1), ' ')"""
register("leaf_tokens", f"""
SELECT page_id, CAST(len({SQL_WS_TOKENS.format(_LINK_TEXTS)}) AS INTEGER) AS n_tokens,
       array_to_string({SQL_WS_TOKENS.format(_LINK_TEXTS)}, ' ') AS tokens
FROM pages
UNION ALL
SELECT page_id, 2, 'inner link' FROM pages WHERE html IS NOT NULL
""")(leaf_tokens)


def attr_extract(spark, sf_dir):
    """``a/@href`` values of every page, in document order."""
    nodes = _page_nodes(spark, sf_dir)
    vals = markup.attribute_values(nodes, "a", "href")
    pairs = F.array_sort(F.collect_list(F.struct("pre", "value")))
    agg = vals.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_href"),
                                     F.array_join(F.transform(pairs, lambda x: x["value"]), " ").alias("hrefs"))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"))
    return (pages.join(agg, "doc_id", "left")
            .select(F.col("doc_id").cast("bigint").alias("page_id"),
                    F.coalesce("n_href", F.lit(0)).alias("n_href"),
                    F.coalesce("hrefs", F.lit("")).alias("hrefs")))


register("attr_extract", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS BIGINT) AS n_href,
       array_to_string(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), ' ') AS hrefs
FROM pages
""")(attr_extract)


def node_text(spark, sf_dir):
    """Text of every ``<style>`` element (it has no element children)."""
    nodes = _page_nodes(spark, sf_dir)
    styles = markup.elements(nodes).where(F.col("tag") == "style").select("doc_id", "pre")
    txt = markup.child_text(nodes, styles, "style_text")
    return txt.select(F.col("doc_id").cast("bigint").alias("page_id"), "style_text")


register("node_text", r"""
SELECT page_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) AS style_text
FROM pages
""")(node_text)


# ------------------------------------------------------------- XML corpora

def _xml_escape(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def conversation_xml(conv):
    """One XML fragment per conversation: ``text[@xml:id] > u[@who] >
    s[@n] > w`` (built with Spark string functions)."""
    lines = F.split(F.col("text"), "\n")
    sents = F.transform(lines, lambda ln, i: F.concat(
        F.lit('<s n="'), (i + 1).cast("string"), F.lit('">'),
        F.array_join(F.transform(T.whitespace_tokens(ln), lambda w: F.concat(F.lit("<w>"), _xml_escape(w), F.lit("</w>"))), " "),
        F.lit("</s>")))
    turn_xml = F.concat(F.lit('<u who="'), F.col("role"), F.lit('">'), F.array_join(sents, ""), F.lit("</u>"))
    body = corpus.ordered_text(conv.select("conv_id", "turn", turn_xml.alias("x")), ["conv_id"], "turn", "x",
                               sep="", name="body")
    fid = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-fragment01"))
    return body.select("conv_id", fid.alias("fragment_id"),
                       F.concat(F.lit('<text xml:id="'), fid, F.lit('">'), F.col("body"), F.lit("</text>")).alias("xml"))


def _fragment_words(nodes):
    sents = markup.elements(nodes).where(F.col("tag") == "s").select("doc_id", "pre")
    toks = markup.leaf_tokens(nodes, sents)
    pairs = F.array_sort(F.collect_list(F.struct("pre", "tokens")))
    return toks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.flatten(F.transform(pairs, lambda x: x["tokens"])).alias("_w")) \
        .select("doc_id", "n_sentences", F.size("_w").alias("n_words"), F.md5(F.array_join("_w", " ")).alias("words_md5"))


# Of how many conversations one is named by no example.
UNNAMED = 8


def xml_corpus_scan(spark, sf_dir):
    """Conversations written as (a) one big annotated corpus file read back
    fragment by fragment and (b) one source file per key read back only for
    the keys that examples name (seven conversations in eight), the other
    files unopened; both parsed into node tables; sentences and words per
    fragment, and the same words from its source file."""
    conv = read_spread(spark, sf_dir, "conversations")
    xml = staged(conversation_xml(conv), "conversation-xml")             # read twice
    root = shared_path(spark, "xml-corpus")
    xml.select("xml").write.mode("overwrite").text(f"{root}/annotated")
    layout = readers.write_keyed_files(xml, f"{root}/source", "fragment_id", "xml")
    frags = readers.scan_fragments(spark, f"{root}/annotated")
    nodes = staged(markup.node_table(frags.withColumnRenamed("fragment_id", "doc_id")), "fragment-nodes")
    words = _fragment_words(nodes)
    named = bucket(F.concat(F.lit("named:"), F.col("conv_id").cast("string")), UNNAMED) > 0
    wanted = conv.where(named).select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-fragment01")).alias("k"))
    src = readers.scan_keyed_files(spark, f"{root}/source", wanted, "k", layout)
    source = staged(markup.node_table(src.withColumnRenamed("key", "doc_id")), "source-nodes")
    found = _fragment_words(source).select("doc_id", F.col("words_md5").alias("source_words_md5"))
    return (words.join(found, "doc_id", "left")
            .select(F.col("doc_id").alias("fragment_id"), "n_sentences", "n_words", "words_md5",
                    F.col("source_words_md5").isNotNull().alias("source_found"), "source_words_md5"))


_NAMED = sql_bucket("'named:' || CAST(ss.conv_id AS VARCHAR)", UNNAMED) + " > 0"
register("xml_corpus_scan", f"""
WITH l AS (
  SELECT conv_id, turn, unnest(range(0, len(string_split(text, {NL})))) AS line,
         unnest(string_split(text, {NL})) AS ln
  FROM conversations
), w AS (
  SELECT conv_id, turn, line, unnest(range(0, len({SQL_WS_TOKENS.format('ln')}))) AS pos,
         unnest({SQL_WS_TOKENS.format('ln')}) AS tok
  FROM l
), ws AS (
  SELECT conv_id, count(*) AS n_words, md5(string_agg(tok, ' ' ORDER BY turn, line, pos)) AS words_md5
  FROM w GROUP BY conv_id
), ss AS (SELECT conv_id, count(*) AS n_sentences FROM l GROUP BY conv_id)
SELECT 'c' || CAST(ss.conv_id AS VARCHAR) || '-fragment01' AS fragment_id, ss.n_sentences,
       CAST(coalesce(ws.n_words, 0) AS INTEGER) AS n_words,
       coalesce(ws.words_md5, md5('')) AS words_md5, {_NAMED} AS source_found,
       CASE WHEN {_NAMED} THEN coalesce(ws.words_md5, md5('')) END AS source_words_md5
FROM ss LEFT JOIN ws ON ss.conv_id = ws.conv_id
""")(xml_corpus_scan)


# ------------------------------------------------------------- JSON lines, CSV

def jsonl_nested_scan(spark, sf_dir):
    """Labels and nested lemma records written as JSON lines, read back
    with explicit schemas (two lemma files unioned) and joined."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    root = shared_path(spark, "jsonl")
    lemma = F.nullif(drawn_word(T.word_tokens("text"), "lemma", "doc_id"), F.lit(""))
    rec = docs.select(F.struct(lemma.alias("U-lemmaByPOS")).alias("x"),
                      F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
                      F.col("lang"))
    rec.where(F.col("lang") == "en").drop("lang").write.mode("overwrite").json(f"{root}/lemmas_a")
    rec.where(F.col("lang") != "en").drop("lang").write.mode("overwrite").json(f"{root}/lemmas_b")
    labels.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
                  F.col("quality").alias("y")).write.mode("overwrite").json(f"{root}/labels")
    lem = readers.read_lemmas_jsonl(spark, [f"{root}/lemmas_a", f"{root}/lemmas_b"])
    lab = readers.read_labels_jsonl(spark, f"{root}/labels")
    return corpus.join_labels(lab, lem)


register("jsonl_nested_scan", f"""
SELECT 'doc_' || CAST(l.doc_id AS VARCHAR) AS id, l.quality AS y,
       nullif({sql_drawn_word(SQL_WORD_TOKENS.format('d.text'), 'lemma', 'd.doc_id')}, '') AS verb_lemma
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")(jsonl_nested_scan)


CSV_SCHEMA = "id bigint, line int, v string, s string, o string, sentence string"


def csv_roundtrip_blanks(spark, sf_dir):
    """Examples written as three CSV files and read back: a header index
    (id, genre, partition), headerless labels (id, y) and a row for every line
    of every example's text, with blank arguments and quoted, comma-bearing
    sentences, read in both null regimes (blanks stay '' in one and become
    null in the other; the word ``NA`` stays a word in the first)."""
    roles = _roles(spark, sf_dir)
    path = shared_path(spark, "csv")
    readers.write_csv(roles.select("id", "genre", "partition"), f"{path}/index")
    (roles.select(F.col("id").cast("string").alias("id"), "y").write.mode("overwrite")
     .csv(f"{path}/labels"))                                   # no header row
    lines = roles.select("id", "v", "s", "o", F.posexplode(F.split("text", "\n")).alias("line", "sentence"))
    readers.write_csv(lines.select("id", "line", "v", "s", "o", "sentence"), f"{path}/examples")
    index = readers.read_index_csv(spark, f"{path}/index", "id bigint, genre string, partition string")
    labels = readers.read_headerless_labels_csv(spark, f"{path}/labels") \
        .select(F.col("id").cast("bigint").alias("id"), "y")
    keep = readers.read_csv_keep_blanks(spark, f"{path}/examples", CSV_SCHEMA)
    nulls = readers.read_csv_default_na(spark, f"{path}/examples", CSV_SCHEMA).select(
        "id", "line", *[F.col(c).isNull().alias(f"{c}_null") for c in ("s", "o", "sentence")])
    return (index.join(labels, "id").join(keep, "id").join(nulls, ["id", "line"])
            .select("id", "line", "y", "genre", "partition", "v", "s", "o",
                    F.md5("sentence").alias("sentence_md5"), "s_null", "o_null", "sentence_null"))


_NA = ", ".join(f"'{x}'" for x in readers.NA_STRINGS)
register("csv_roundtrip_blanks", f"""
WITH {_ROLES_SQL.strip()}
SELECT id, CAST(line AS INTEGER) AS line, y, genre, partition, v, s, o, md5(sentence) AS sentence_md5,
       s IN ({_NA}) AS s_null, o IN ({_NA}) AS o_null, sentence IN ({_NA}) AS sentence_null
FROM (SELECT *, unnest(range(0, len(string_split(text, {NL})))) AS line, unnest(string_split(text, {NL})) AS sentence FROM roles)
""")(csv_roundtrip_blanks)
