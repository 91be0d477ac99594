"""One driver query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figura.llm import (decontaminate, divergence, linededup, lmscore, packing, pii, quality, sharding, simhash, spelling,
                        suffixdedup, warc, wavelet)
from figura.llm.catalog import register, table
from figura.llm.tokens import vocabulary

MIN_RUN_WORDS = 50
TARGET_SOURCE = "src1"


@register("op1_warc_index_merge")
def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back, with its place in the merged index."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "position")


@register("op2_cross_entropy_difference")
def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of one source against one of all."""
    docs = table(spark, sf_dir, "documents")
    got = lmscore.cross_entropy_difference(docs, docs.where(F.col("source") == TARGET_SOURCE))
    return got.withColumn("score", F.round("score", 6))


@register("op3_line_runs", sql=f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT doc_id, unnest(range(len(l))) AS o, unnest(l) AS line FROM d),
c AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w,
         sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY o) AS upto
  FROM p),
win AS (
  SELECT a.doc_id, a.o AS s, min(b.o) AS e FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.w + {MIN_RUN_WORDS} AND b.o >= a.o GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.o) AS s, b.o AS e FROM c b JOIN c a
    ON a.doc_id = b.doc_id AND a.upto - a.w <= b.upto - {MIN_RUN_WORDS} AND a.o <= b.o GROUP BY b.doc_id, b.o),
k AS (
  SELECT win.doc_id, s, e, array_to_string(l[s + 1:e + 1], chr(10)) AS t FROM win JOIN d USING (doc_id)),
later AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM k),
gone AS (
  SELECT DISTINCT c.doc_id, c.o FROM c JOIN later ON c.doc_id = later.doc_id AND r > 1 AND c.o BETWEEN s AND e),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.o = g.o - 1)) AS n_runs FROM gone g GROUP BY doc_id),
kept AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.o) AS t
  FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.o = gone.o WHERE gone.o IS NULL GROUP BY c.doc_id)
SELECT x.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(runs.n_removed, 0)::BIGINT AS n_removed,
       coalesce(runs.n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept.t, '')) AS kept_lines_sha256
FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more deleted: counts and the
    digest of the non-blank lines that stay."""
    got = linededup.delete_repeats(table(spark, sf_dir, "documents"), MIN_RUN_WORDS, details=True)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return got.select("doc_id", "n_lines", "n_removed", "n_runs",
                      F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("kept_lines_sha256"))


@register("op4_host_rules", sql=r"""
WITH t AS (
  SELECT doc_id, coalesce(trim(source), '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
c AS (
  SELECT doc_id, host, len(words) AS n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_symbols > n_words * 0.1::DOUBLE AS bad_symbols, n_dup_lines > n_lines * 0.3::DOUBLE AS bad_lines FROM c),
h AS (
  SELECT host, count(*) AS n, unnest([
           {r: 0, f: count(*) FILTER (WHERE base_failed)},
           {r: 1, f: count(*) FILTER (WHERE bad_symbols)},
           {r: 2, f: count(*) FILTER (WHERE bad_lines)}]) AS x FROM f GROUP BY host),
m AS (
  SELECT x.r AS r, avg(x.f / n) AS m, var_pop(x.f / n) AS v FROM h GROUP BY x.r),
s AS (
  SELECT r, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1000.0) ELSE 1000.0 END AS s FROM m),
p AS (
  SELECT host, n + s AS k, (x.f + m * s) / (n + s) AS rate FROM h JOIN s ON h.x.r = s.r),
v AS (
  SELECT host, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (k + 1)) > 0.5) AS bad FROM p GROUP BY host)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept
FROM f JOIN v USING (host)
""")
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and host verdict of every document."""
    return quality.host_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_simhash_bktree")
def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op6_wavelet_shards")
def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as wavelet shards and read back."""
    return wavelet.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2)


@register("op7_rendezvous_shards")
def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard with one more."""
    return sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op8_suffix_decontamination")
def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op9_column_suffix_dedup")
def op9_column_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from every document."""
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), 200).select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op10_bestfit_packing")
def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024, end=2)


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its form, root and near words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@register("op12_source_divergence", sql=r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(c)::BIGINT AS c FROM c GROUP BY ALL),
s AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM l GROUP BY ALL),
m AS (SELECT lang, source, sum(c)::BIGINT AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (coalesce(m.n, 0) + 2 * s.v) AS p
  FROM g JOIN k USING (lang) JOIN s USING (lang) LEFT JOIN m USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p, 1 + (1000000000 * (l.c + 2)) // (s.n + 2 * s.v) AS q
  FROM p JOIN l USING (lang, term) JOIN s USING (lang) WHERE p.c > 0),
term AS (
  SELECT lang, source, part, item, ((p - q) * (p - q)) // (p + q) AS value FROM t WHERE p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of a language's sources, and the terms that
    set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, all spans."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))
