"""Driver query: the whole corpus assembly job.

Conversations become both corpora, written by Spark as XML. A conversation is
a source document; four consecutive turns (numbered from 0) are a fragment
(level-1 div), two an exchange (level-2 div), an assistant turn is a paragraph,
a user turn an utterance. Any other turn shows the remaining kinds of context:
by ``conv_id % 4`` it is a level-4 div, a level-3 div, bare text of its
exchange, or bare text of its fragment before the exchange. Each line is a
sentence ``turn.line``, and each line with a token is an example, its verb, its
offset (up to two off) and its parse drawn by md5. One conversation in ten also
asks for a sentence that doesn't exist, one in ten has an example with a
malformed id, and one source document in twenty has a second text unit: all of
these must come back as rejects with their reason.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text as T
from figura.functions.hashing import bucket
from figura.functions.ids import two_digits
from figura.operators import corpus
from figura.plans.assemble import assemble_examples, is_reject
from figura.plans.catalog import register
from figura.plans.q_corpus import _ok1, _ok2, _ok3, _t1, _t2, _t3, DEP_LABELS, LEMMA_STRIP
from figura.plans.q_markup import _xml_escape
from figura.plans.q_text import SQL_NORM, SQL_WS_TOKENS
from figura.plans.tables import TEST_BUCKETS, read_spread, sql_bucket
from figura.session import shared_path, staged
from figura.sources import markup, readers

NL = "chr(10)"
# Text-type codes dealt to the source documents; the last has no genre.
CODES = ("ACPROSE", "NEWS", "FICTION", "CONVRSN", "OTHERSP")


def _pick(values, i):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _turns(conv):
    """Turns with their place in the tree and their sentences as XML."""
    sents = F.transform(F.split("text", "\n"), lambda ln, i: F.concat(
        F.lit('<s n="'), F.col("turn").cast("string"), F.lit("."), (i + 1).cast("string"), F.lit('">'),
        F.array_join(F.transform(T.whitespace_tokens(ln), lambda w: F.concat(F.lit("<w>"), _xml_escape(w), F.lit("</w>"))), " "),
        F.lit("</s>")))
    return conv.select(
        "conv_id", "turn", "role", "text", F.floor(F.col("turn") / 2).cast("bigint").alias("exchange"),
        F.floor(F.col("turn") / 4).cast("bigint").alias("part"), F.array_join(sents, "\n").alias("xml"))


def _segment(part):
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-fragment"), two_digits(part + 1))


def annotated_corpus(turns):
    """``(conv_id, part, xml)``: one ``text`` element per fragment."""
    body = corpus.ordered_text(turns, ["conv_id", "part"], "turn", "xml", sep="\n", name="body")
    return body.select("conv_id", "part", F.concat(
        F.lit('<text xml:id="'), _segment(F.col("part")), F.lit('"><body>'), F.col("body"), F.lit("</body></text>")).alias("xml"))


def source_corpus(turns):
    """``(doc_id, content)``: one document per conversation."""
    def tagged(name, attrs=""):
        return F.concat(F.lit(f"<{name}{attrs}>"), F.col("xml"), F.lit(f"</{name}>"))
    m = F.col("conv_id") % 4
    plain = ~F.coalesce(F.col("role").isin("assistant", "user"), F.lit(False))
    unit = (F.when(F.col("role") == "assistant", tagged("p")).when(F.col("role") == "user", tagged("u", ' who="A"'))
            .when(m == 0, tagged("div", ' level="4"')).when(m == 1, tagged("div", ' level="3"')).otherwise(F.col("xml")))
    t = turns.select("conv_id", "part", "exchange", "turn", (~(plain & (m == 3))).alias("inside"), unit.alias("xml"))
    groups = corpus.ordered_text(t, ["conv_id", "part", "exchange", "inside"], "turn", "xml", sep="\n")
    level2 = F.when(F.col("inside"), F.concat(F.lit('<div level="2">'), F.col("text"), F.lit("</div>"))).otherwise(F.col("text"))
    parts = corpus.ordered_text(groups.select("conv_id", "part", F.struct("exchange", "inside").alias("at"), level2.alias("x")),
                                ["conv_id", "part"], "at", "x", sep="\n")
    parts = parts.select("conv_id", "part", F.concat(F.lit('<div level="1">'), F.col("text"), F.lit("</div>")).alias("x"))
    docs = corpus.ordered_text(parts, ["conv_id"], "part", "x", sep="\n")
    second = F.concat(F.lit('<stext type="'), _pick(CODES, F.col("conv_id") % len(CODES)), F.lit('"></stext>'))
    return docs.select(
        F.concat(F.lit("C"), F.col("conv_id").cast("string")).alias("doc_id"),
        F.concat(F.lit('<bncDoc><wtext type="'), _pick(CODES, F.col("conv_id") % len(CODES)), F.lit('">'),
                 F.col("text"), F.lit("</wtext>"), F.when(F.col("conv_id") % 20 == 9, second).otherwise(F.lit("")),
                 F.lit("</bncDoc>")).alias("content"))


def requests(turns):
    """Examples with their drawn verb, offset, parse, label and partition."""
    lines = turns.select("conv_id", "turn", "part", F.posexplode(F.split("text", "\n")).alias("line", "s")) \
        .withColumn("raw", T.whitespace_tokens("s")).where(F.size("raw") > 0)
    number = F.concat_ws(".", F.col("turn").cast("string"), (F.col("line") + 1).cast("string"))
    k = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), (F.col("line") + 1).cast("string"))
    ex = lines.select("conv_id", "raw", _segment(F.col("part")).alias("seg"), number.alias("sn"), k.alias("k"),
                      F.size("raw").alias("n"))
    ex = ex.withColumn("vi", bucket(F.concat(F.lit("verb:"), F.col("k")), F.col("n")).cast("int")) \
        .withColumn("is_test", bucket(F.concat(F.lit("split:"), F.col("k")), TEST_BUCKETS) == 0) \
        .withColumn("token", F.lower(F.get("raw", F.col("vi"))))
    off = F.greatest(F.col("vi") + 1 + bucket(F.concat(F.lit("off:"), F.col("k")), 5) - 2, F.lit(0))
    train_id = F.concat(F.col("seg"), F.lit("_"), F.col("sn"), F.lit("_0_"), off.cast("string"), F.lit("_0_"),
                        F.replace(F.col("token"), F.lit("_"), F.lit("")))
    test_id = F.concat_ws("_", "seg", "sn", (F.col("vi") + 1).cast("string"))
    lemma = F.lower(F.regexp_replace("token", LEMMA_STRIP, ""))

    def dependency(tok, i):
        key = F.concat(F.col("k"), F.lit(":"), (i + 1).cast("string"))
        g = bucket(F.concat(F.lit("gov:"), key), F.col("n") + 1).cast("int")
        lab = _pick(DEP_LABELS, bucket(F.concat(F.lit("dep:"), key), len(DEP_LABELS)))
        return F.struct(F.when(g == 0, F.lit("root")).otherwise(lab).alias("dep"), g.alias("governor"),
                        F.when(g == 0, F.lit("ROOT")).otherwise(F.get("raw", g - 1)).alias("governorGloss"),
                        (i + 1).cast("int").alias("dependent"), tok.alias("dependentGloss"))
    return ex.select(
        F.when(F.col("is_test"), test_id).otherwise(train_id).alias("id"), "is_test",
        F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")).alias("genre"),
        bucket(F.concat(F.lit("fold:"), F.col("k")), 5).cast("int").alias("fold_no"),
        bucket(F.concat(F.lit("y:"), F.col("k")), 2).cast("int").alias("y"),
        F.nullif(lemma, F.lit("")).alias("verb_lemma"),
        F.transform("raw", lambda t: F.struct(F.lower(F.regexp_replace(t, LEMMA_STRIP, "")).alias("lemma"))).alias("tokens"),
        F.transform("raw", dependency).alias("deps"))


def corpus_assembly(spark, sf_dir):
    """Both corpora, index, labels, parses and lemmas assembled into the
    example table, with the kind of context chosen and the rejects marked."""
    turns = _turns(read_spread(spark, sf_dir, "conversations"))
    path = f"{shared_path(spark, 'assembly')}/annotated"
    annotated_corpus(turns).select("xml").write.text(path)
    annotated = markup.node_table(readers.scan_fragments(spark, path).withColumnRenamed("fragment_id", "doc_id"))
    source = markup.node_table(source_corpus(turns))
    req = staged(requests(turns), "assembly-requests")     # the index, label, parse and lemma files
    train = req.where(~F.col("is_test"))
    index = train.select("id", "genre", F.lit("train").alias("partition"), "fold_no")
    lost = turns.where((F.col("conv_id") % 10 == 7) & (F.col("turn") == 0)).select(
        F.concat(_segment(F.col("part")), F.lit("_0.0_1")).alias("id"), F.lit(0).alias("y"), F.lit("none").alias("verb_lemma"))
    bad = turns.where((F.col("conv_id") % 10 == 3) & (F.col("turn") == 0)).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("fragment01_0.0_1")).alias("id"), F.lit(0).alias("y"),
        F.lit("none").alias("verb_lemma"))
    lost = lost.unionByName(bad)
    test_labels = req.where("is_test").select("id", "y").unionByName(lost.select("id", "y"))
    lemmas = req.where(F.col("verb_lemma").isNotNull()).select("verb_lemma", "id").unionByName(lost.select("verb_lemma", "id"))
    ex = assemble_examples(index, train.select("id", "y"), test_labels, annotated, source,
                           req.select("id", "tokens", "deps"), lemmas, keep_kind=True, audit=True, part_length=None)
    return ex.select(
        "id", "y", "partition", "fold_no", "genre", "bnc_file", "bnc_file_n", "sentence_number", "sentence_offset",
        "subword_offset", "word_offset", "verb", "verb_lemma", "subject", "object", "subject_lemma", "object_lemma",
        "min_kind", F.md5("sentence").alias("sentence_md5"), F.md5("min_context").alias("context_md5"),
        "sentence_start_idx", "sentence_end_idx", is_reject().alias("rejected"), "reject")


_labels = ", ".join(f"'{x}'" for x in DEP_LABELS)
_codes = ", ".join(f"'{x}'" for x in CODES)
_genres = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.GENRE_MAP.items())
_SEG = "'c' || conv_id || '-fragment' || lpad(CAST(part + 1 AS VARCHAR), greatest(2, length(CAST(part + 1 AS VARCHAR)))::INTEGER, '0')"
register("corpus_assembly", f"""
WITH t AS (
  SELECT conv_id, turn, role, text, turn // 2 AS exch, turn // 4 AS part,
         CASE WHEN role = 'assistant' THEN 'paragraph' WHEN role = 'user' THEN 'utterance'
              WHEN conv_id % 4 = 0 THEN 'div_4' WHEN conv_id % 4 = 1 THEN 'div_3'
              WHEN conv_id % 4 = 2 THEN 'div_2' ELSE 'div_1' END AS kind
  FROM conversations
), d2 AS (
  SELECT conv_id, exch, string_agg(text, {NL} ORDER BY turn) AS x FROM t WHERE kind <> 'div_1' GROUP BY ALL
), d1 AS (
  SELECT conv_id, part, string_agg(text, {NL} ORDER BY exch, kind <> 'div_1', turn) AS x FROM t GROUP BY ALL
), ctx AS (
  SELECT t.conv_id, t.turn, t.kind, {SQL_NORM.format("CASE t.kind WHEN 'div_2' THEN d2.x WHEN 'div_1' THEN d1.x ELSE t.text END")} AS c
  FROM t LEFT JOIN d2 ON t.conv_id = d2.conv_id AND t.exch = d2.exch
         JOIN d1 ON t.conv_id = d1.conv_id AND t.part = d1.part
), l AS (
  SELECT conv_id, turn, part, unnest(range(1, len(string_split(text, {NL})) + 1)) AS ln, unnest(string_split(text, {NL})) AS line FROM t
), w AS (
  SELECT *, {SQL_WS_TOKENS.format('line')} AS raw, conv_id || ':' || turn || ':' || ln AS k, {_SEG} AS seg FROM l
), e AS (
  SELECT *, len(raw) AS n, {sql_bucket("'verb:' || k", "len(raw)")} AS vi, {sql_bucket("'off:' || k", 5)} - 2 AS delta,
         {sql_bucket("'split:' || k", TEST_BUCKETS)} = 0 AS is_test
  FROM w WHERE len(raw) > 0
), v AS (
  SELECT *, CASE WHEN is_test THEN lower(raw[vi + 1]) ELSE replace(lower(raw[vi + 1]), '_', '') END AS verb,
         CASE WHEN is_test THEN vi + 1 ELSE greatest(vi + 1 + delta, 0) END AS o,
         list_transform(raw, lambda t: lower(regexp_replace(t, '{LEMMA_STRIP}', '', 'g'))) AS lem
  FROM e
), f AS (
  SELECT *, seg || '_' || turn || '.' || ln || CASE WHEN is_test THEN '_' || o ELSE '_0_' || o || '_0_' || verb END AS id,
         CASE WHEN NOT {_ok1} THEN o WHEN {_t1} = verb THEN o
              WHEN NOT {_ok2} THEN o WHEN {_t2} = verb THEN o + 1
              WHEN NOT {_ok3} THEN o WHEN {_t3} = verb THEN o + 2
              ELSE coalesce(nullif(list_position(list_transform(raw, lambda t: lower(t)), verb), 0), o) END AS wo
  FROM v
), u AS (
  SELECT id, k, raw, lem, wo, n, unnest(range(1, n + 1)) AS i FROM f
), d AS (
  SELECT id, wo, raw, lem, i, {sql_bucket("'gov:' || k || ':' || i", "(n + 1)")} AS g,
         [{_labels}][{sql_bucket("'dep:' || k || ':' || i", len(DEP_LABELS))} + 1] AS lab
  FROM u
), gov AS (
  SELECT id, arg_max(raw[i], i) FILTER (WHERE lab = 'nsubj') AS sg, arg_max(lem[i], i) FILTER (WHERE lab = 'nsubj') AS sl,
         arg_max(raw[i], i) FILTER (WHERE lab = 'dobj') AS og, arg_max(lem[i], i) FILTER (WHERE lab = 'dobj') AS ol
  FROM d WHERE g > 0 AND g = wo GROUP BY id
), cs AS (
  SELECT id, arg_min(raw[g], i) AS cg, arg_min(lem[g], i) AS cl FROM d WHERE g > 0 AND lab = 'case' AND i = wo GROUP BY id
), code AS (
  SELECT DISTINCT conv_id, coalesce(CASE [{_codes}][conv_id % {len(CODES)} + 1] {_genres} END, '{corpus.UNKNOWN_GENRE}') AS genre
  FROM conversations
)
SELECT f.id, CAST({sql_bucket("'y:' || f.k", 2)} AS INTEGER) AS y, CASE WHEN is_test THEN 'test' ELSE 'train' END AS partition,
       CAST(CASE WHEN is_test THEN 0 ELSE {sql_bucket("'fold:' || f.k", 5)} END AS INTEGER) AS fold_no,
       CASE WHEN is_test THEN code.genre ELSE 'g' || (f.conv_id % 3) END AS genre,
       'C' || f.conv_id AS bnc_file, CAST(part + 1 AS INTEGER) AS bnc_file_n, f.turn || '.' || ln AS sentence_number,
       0 AS sentence_offset, 0 AS subword_offset, CAST(wo AS INTEGER) AS word_offset, verb, lem[vi + 1] AS verb_lemma,
       CASE WHEN gov.id IS NOT NULL THEN coalesce(lower(sg), '') ELSE '' END AS subject,
       CASE WHEN gov.id IS NOT NULL THEN coalesce(lower(og), '') ELSE coalesce(lower(cg), '') END AS object,
       CASE WHEN gov.id IS NOT NULL THEN coalesce(lower(sl), '') ELSE '' END AS subject_lemma,
       CASE WHEN gov.id IS NOT NULL THEN coalesce(lower(ol), '') ELSE coalesce(lower(cl), '') END AS object_lemma,
       ctx.kind AS min_kind, md5(array_to_string(raw, ' ')) AS sentence_md5, md5(c) AS context_md5,
       CAST(instr(c, {SQL_NORM.format('line')}) - 1 AS INTEGER) AS sentence_start_idx,
       CAST(instr(c, {SQL_NORM.format('line')}) - 1 + length({SQL_NORM.format('line')}) AS INTEGER) AS sentence_end_idx,
       false AS rejected, CASE WHEN f.conv_id % 20 = 9 THEN 'text units' END AS reject
FROM f JOIN ctx ON f.conv_id = ctx.conv_id AND f.turn = ctx.turn JOIN code ON f.conv_id = code.conv_id
       LEFT JOIN gov ON f.id = gov.id LEFT JOIN cs ON f.id = cs.id
WHERE lem[vi + 1] <> ''
UNION ALL
SELECT {_SEG} || '_0.0_1', 0, 'test', 0, NULL, 'C' || conv_id, CAST(part + 1 AS INTEGER), '0.0', 0, 0, 1, NULL, 'none',
       '', '', '', '', NULL, NULL, NULL, NULL, NULL, true, 'sentence'
FROM t WHERE conv_id % 10 = 7 AND turn = 0
UNION ALL
SELECT 'c' || conv_id || 'fragment01_0.0_1', 0, 'test', 0, NULL, 'C' || conv_id || 'FRAGMENT01', NULL, '0.0', 0, 0, 1, NULL, 'none',
       '', '', '', '', NULL, NULL, NULL, NULL, NULL, true, 'id'
FROM t WHERE conv_id % 10 = 3 AND turn = 0
""")(corpus_assembly)
