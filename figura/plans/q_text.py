"""Driver queries: ids, whitespace, tokenisers, spans, decoding, genre map."""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text
from figura.operators import corpus
from figura.operators.occurrences import first_occurrences
from figura.operators.text_ops import token_offsets
from figura.plans.catalog import register
from figura.functions.hashing import bucket
from figura.functions.ids import two_digits
from figura.plans.tables import read, read_spread, sql_bucket

# Stand-in corpus type codes drawn per document (the last one is not in
# the genre map and must come out as 'unknown').
TYPE_CODES = ("ACPROSE", "NEWS", "FICTION", "CONVRSN", "OTHER")


def q(s: str) -> str:
    """A pattern as a SQL string literal body (quotes doubled)."""
    return s.replace("'", "''")


WS = q(text.WS_CLASS_SQL)


class _Tpl:
    """A SQL snippet with one ``{x}`` hole (patterns contain braces, so
    ``str.format`` cannot be used)."""

    def __init__(self, s: str):
        self.s = s

    def format(self, x: str) -> str:
        return self.s.replace("{x}", x)


SQL_STRIP = _Tpl("regexp_replace({x}, '^" + WS + "+|" + WS + "+$', '', 'g')")
SQL_NORM = _Tpl(SQL_STRIP.format("regexp_replace({x}, '" + WS + "+', ' ', 'g')"))
SQL_WS_TOKENS = _Tpl("list_filter(string_split_regex({x}, '" + WS + "+'), lambda t: t <> '')")
SQL_WORD_TOKENS = _Tpl("list_filter(regexp_extract_all(lower({x}), '(" + q(text.WORD_CLASS) + "+)', 1), "
                       f"lambda w: length(w) BETWEEN {text.WORD_MIN_LEN} AND {text.WORD_MAX_LEN} "
                       "AND NOT starts_with(w, '_'))")
SQL_INFIX_TOKENS = _Tpl(SQL_WS_TOKENS.format(
    "regexp_replace({x}, '(" + q(text.INFIX_CLASS) + ")', ' \\1 ', 'g')"))


# ------------------------------------------------------------- whitespace

def whitespace_norm(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    norm = text.normalize_whitespace("text")
    return d.select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).alias("norm_len"),
                    F.length(text.strip("text")).alias("strip_len"))


register("whitespace_norm", f"""
SELECT doc_id, md5({SQL_NORM.format(x='text')}) AS norm_md5,
       CAST(length({SQL_NORM.format(x='text')}) AS INTEGER) AS norm_len,
       CAST(length({SQL_STRIP.format(x='text')}) AS INTEGER) AS strip_len
FROM documents
""")(whitespace_norm)


def word_tokens(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    toks = text.word_tokens("text")
    return d.select("doc_id", F.size(toks).alias("n_tokens"), text.join_tokens(toks).alias("tokens"))


register("word_tokens", f"""
SELECT doc_id, CAST(len({SQL_WORD_TOKENS.format(x='text')}) AS INTEGER) AS n_tokens,
       array_to_string({SQL_WORD_TOKENS.format(x='text')}, ' ') AS tokens
FROM documents
""")(word_tokens)


def infix_tokens(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    toks = text.infix_tokens("text")
    return d.select("doc_id", F.size(toks).alias("n_tokens"), text.join_tokens(toks).alias("tokens"))


register("infix_tokens", f"""
SELECT doc_id, CAST(len({SQL_INFIX_TOKENS.format(x='text')}) AS INTEGER) AS n_tokens,
       array_to_string({SQL_INFIX_TOKENS.format(x='text')}, ' ') AS tokens
FROM documents
""")(infix_tokens)


def affix_tokens(spark, sf_dir):
    """Tokens of the rule set: marks off both ends, exceptions whole, infixes."""
    d = read_spread(spark, sf_dir, "documents")
    toks = text.affix_tokens("text")
    return d.select("doc_id", F.size(toks).alias("n_tokens"), F.md5(text.join_tokens(toks)).alias("tokens_md5"))


_EXCEPT = ", ".join(f"'{q(x)}'" for x in text.EXCEPTIONS)
_PRE, _SUF = q(text.PREFIXES), q(text.SUFFIXES)
register("affix_tokens", f"""
WITH RECURSIVE ch AS MATERIALIZED (
  SELECT DISTINCT unnest({SQL_WS_TOKENS.format(x='text')}) AS c FROM documents
), peel(c, pre, core, suf, more) AS (
  SELECT c, []::VARCHAR[], c, []::VARCHAR[], true FROM ch
  UNION ALL
  SELECT c, CASE WHEN front THEN list_append(pre, core[1]) ELSE pre END,
         CASE WHEN back THEN left(rest, length(rest) - 1) ELSE rest END,
         CASE WHEN back THEN list_prepend(right(rest, 1), suf) ELSE suf END, front OR back
  FROM (
    SELECT *, rest <> '' AND NOT (front AND rest IN ({_EXCEPT})) AND NOT (core = '' OR core IN ({_EXCEPT}))
              AND contains('{_SUF}', right(rest, 1)) AS back
    FROM (
      SELECT *, CASE WHEN front THEN substr(core, 2) ELSE core END AS rest
      FROM (SELECT *, core <> '' AND core NOT IN ({_EXCEPT}) AND contains('{_PRE}', core[1]) AS front FROM peel WHERE more)))
), cut AS (
  SELECT c, list_concat(list_concat(pre, CASE WHEN core IN ({_EXCEPT}) THEN [core] ELSE list_filter(string_split(
           regexp_replace(core, '({q(text.INFIX_CLASS)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') END), suf) AS toks
  FROM peel WHERE NOT more
), t AS (
  SELECT doc_id, unnest({SQL_WS_TOKENS.format(x='text')}) AS c, unnest(range(0, len({SQL_WS_TOKENS.format(x='text')}))) AS i FROM documents
), g AS (
  SELECT doc_id, flatten(list(toks ORDER BY i)) AS toks FROM t JOIN cut USING (c) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(toks), 0) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(toks, ' '), '')) AS tokens_md5
FROM documents d LEFT JOIN g USING (doc_id) WHERE d.text IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL
""")(affix_tokens)


def token_join_roundtrip(spark, sf_dir):
    """Raw tokens -> joined sentence; equals the whitespace-normalised text."""
    d = read(spark, sf_dir, "documents")
    toks = text.whitespace_tokens("text")
    joined = text.join_tokens(toks)
    return d.select("doc_id", F.size(toks).alias("n_tokens"), F.md5(joined).alias("sentence_md5"),
                    (joined == text.normalize_whitespace("text")).alias("same_as_norm"))


register("token_join_roundtrip", f"""
SELECT doc_id, CAST(len({SQL_WS_TOKENS.format(x='text')}) AS INTEGER) AS n_tokens,
       md5(array_to_string({SQL_WS_TOKENS.format(x='text')}, ' ')) AS sentence_md5,
       array_to_string({SQL_WS_TOKENS.format(x='text')}, ' ') = {SQL_NORM.format(x='text')} AS same_as_norm
FROM documents
""")(token_join_roundtrip)


def token_offsets_q(spark, sf_dir):
    """Character offset of every whitespace token of every document."""
    return token_offsets(read_spread(spark, sf_dir, "documents"), "doc_id")


_NWS = q("[^" + text.WS_CLASS_SQL[1:])
register("token_offsets", f"""
WITH pieces AS (
  SELECT doc_id,
         regexp_extract_all(text, '({WS}*)({_NWS}+)', 1) AS gap,
         regexp_extract_all(text, '({WS}*)({_NWS}+)', 2) AS tok
  FROM documents
), rows AS (
  SELECT doc_id, unnest(range(0, len(tok))) AS pos,
         unnest(tok) AS token, unnest(gap) AS g
  FROM pieces
)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, token,
       CAST(sum(length(g) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(token) AS INTEGER) AS start
FROM rows
""")(token_offsets_q)


def utf8_decode(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    dec = text.utf8_roundtrip("text")
    return d.select("doc_id", F.md5(dec).alias("text_md5"), (dec == F.col("text")).alias("unchanged"))


register("utf8_decode", """
SELECT doc_id, md5(decode(encode(text))) AS text_md5, decode(encode(text)) = text AS unchanged
FROM documents
""")(utf8_decode)


# ------------------------------------------------------------- spans

def char_span(spark, sf_dir):
    """Span of each (normalised) turn inside its (normalised) conversation."""
    conv = read(spark, sf_dir, "conversations")
    ctx = corpus.ordered_text(conv, ["conv_id"], "turn", "text", sep="\n") \
        .select("conv_id", text.normalize_whitespace("text").alias("ctx"))
    sent = conv.select("conv_id", "turn", text.normalize_whitespace("text").alias("sent"))
    return first_occurrences(ctx, sent, ["conv_id"], "ctx", "sent")


register("char_span", f"""
WITH ctx AS (
  SELECT conv_id, {SQL_NORM.format(x="string_agg(text, chr(10) ORDER BY turn)")} AS ctx
  FROM conversations GROUP BY conv_id
), sent AS (
  SELECT conv_id, turn, {SQL_NORM.format(x='text')} AS sent FROM conversations
)
SELECT s.conv_id, s.turn,
       CAST(instr(c.ctx, s.sent) - 1 AS INTEGER) AS sentence_start_idx,
       CAST(instr(c.ctx, s.sent) - 1 + length(s.sent) AS INTEGER) AS sentence_end_idx
FROM sent s JOIN ctx c ON s.conv_id = c.conv_id
""")(char_span)


# ------------------------------------------------------------- ids

def _conv_ids(conv):
    seg = F.concat(F.lit("c"), F.substring(F.md5(F.col("conv_id").cast("string")), 1, 2),
                   F.lit("-fragment"), two_digits("turn"))
    raw = text.whitespace_tokens("text")
    toks = F.size(raw)
    drawn = F.get(raw, bucket(F.concat_ws(":", F.lit("verb"), F.col("conv_id").cast("string"), F.col("turn").cast("string")),
                             F.greatest(toks, F.lit(1))).cast("int"))
    verb = F.coalesce(F.regexp_replace(F.lower(drawn), r"[^\p{L}]", ""), F.lit(""))
    sent_no = F.length("text").cast("string")
    train_id = F.concat_ws("_", seg, sent_no, F.col("turn").cast("string"), toks.cast("string"),
                           F.lit("0"), verb)
    test_id = F.concat_ws("_", seg, sent_no, toks.cast("string"))
    return conv.select("conv_id", "turn", train_id.alias("train_id"), test_id.alias("test_id"))


def id_split_typed(spark, sf_dir):
    """Composite ids in both layouts, split and typed, with the corpus part
    and fragment number parsed out of the segment id."""
    built = _conv_ids(read(spark, sf_dir, "conversations"))
    train = corpus.parse_train_ids(built.withColumnRenamed("train_id", "id").drop("test_id"))
    test = corpus.parse_test_ids(built.withColumnRenamed("test_id", "id").drop("train_id"))
    cols = ["conv_id", "turn", "id", "text_segment_id", "sentence_number", "sentence_offset",
            "word_offset", "subword_offset", "verb", "bnc_file", "bnc_file_n"]
    return (train.withColumn("form", F.lit("train")).select("form", *cols)
            .unionByName(test.withColumn("form", F.lit("test")).select("form", *cols)))


_SQL_SEG = "'c' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 2) || '-fragment' || lpad(CAST(turn AS VARCHAR), greatest(2, length(CAST(turn AS VARCHAR)))::INTEGER, '0')"
_SQL_DRAWN = f"{SQL_WS_TOKENS.format(x='text')}[" + sql_bucket("'verb:' || conv_id || ':' || turn", f"greatest(len({SQL_WS_TOKENS.format(x='text')}), 1)") + " + 1]"
_SQL_VERB = r"coalesce(regexp_replace(lower(" + _SQL_DRAWN + r"), '[^\p{L}]', '', 'g'), '')"
_SQL_NTOK = f"CAST(len({SQL_WS_TOKENS.format(x='text')}) AS VARCHAR)"
register("id_split_typed", f"""
WITH built AS (
  SELECT conv_id, turn,
         concat_ws('_', {_SQL_SEG}, CAST(length(text) AS VARCHAR), CAST(turn AS VARCHAR),
                   {_SQL_NTOK}, '0', {_SQL_VERB}) AS train_id,
         concat_ws('_', {_SQL_SEG}, CAST(length(text) AS VARCHAR), {_SQL_NTOK}) AS test_id
  FROM conversations
), tr AS (
  SELECT 'train' AS form, conv_id, turn, train_id AS id, string_split(train_id, '_') AS p FROM built
), te AS (
  SELECT 'test' AS form, conv_id, turn, test_id AS id, string_split(test_id, '_') AS p FROM built
), parsed AS (
  SELECT form, conv_id, turn, id, p[1] AS text_segment_id, p[2] AS sentence_number,
         CAST(p[3] AS INTEGER) AS sentence_offset, CAST(p[4] AS INTEGER) AS word_offset,
         CAST(p[5] AS INTEGER) AS subword_offset, p[6] AS verb
  FROM tr
  UNION ALL
  SELECT form, conv_id, turn, id, p[1], p[2], 0, CAST(p[3] AS INTEGER), 0, NULL FROM te
)
SELECT *, upper(split_part(text_segment_id, '-', 1)) AS bnc_file,
       CAST(substr(split_part(text_segment_id, '-', 2), 9) AS INTEGER) AS bnc_file_n
FROM parsed
""")(id_split_typed)


def id_validate_rejects(spark, sf_dir):
    """Segment ids that fail validation (3-char part, ``fragment`` prefix,
    exactly two parts), with the reason; valid rows are not returned."""
    conv = read(spark, sf_dir, "conversations")
    seg = F.concat(F.lower(F.substring(F.md5(F.col("text")), F.lit(1),
                                       (F.lit(2) + F.col("turn") % 3).cast("int"))),
                   F.lit("-"),
                   F.when(F.col("role") == "system", F.lit("frag")).otherwise(F.lit("fragment")),
                   F.col("turn").cast("string"))
    return corpus.segment_rejects(conv.select("conv_id", "turn", seg.alias("text_segment_id")),
                                  "text_segment_id")


register("id_validate_rejects", """
WITH built AS (
  SELECT conv_id, turn,
         lower(substr(md5(text), 1, CAST(2 + turn % 3 AS INTEGER))) || '-'
         || CASE WHEN role = 'system' THEN 'frag' ELSE 'fragment' END || CAST(turn AS VARCHAR)
         AS text_segment_id
  FROM conversations
), chk AS (
  SELECT *, string_split(text_segment_id, '-') AS p FROM built
)
SELECT conv_id, turn, text_segment_id,
       CASE WHEN len(p) <> 2 THEN 'parts'
            WHEN length(p[1]) <> 3 THEN 'part_length'
            ELSE 'fragment_prefix' END AS reason
FROM chk
WHERE NOT (len(p) = 2 AND length(p[1]) = 3 AND coalesce(starts_with(p[2], 'fragment'), false))
""")(id_validate_rejects)


# ------------------------------------------------------------- genre

def genre_map(spark, sf_dir):
    """Corpus type code -> genre (unknown codes map to 'unknown'), and the
    sentence-number quirk remap used for the source-corpus lookup."""
    d = read(spark, sf_dir, "documents")
    codes = F.array(*[F.lit(c) for c in TYPE_CODES])
    code = F.element_at(codes, (bucket(F.concat(F.lit("type:"), F.col("doc_id").cast("string")),
                                       len(TYPE_CODES)) + 1).cast("int"))
    sent_no = F.concat(F.col("doc_id").cast("string"), F.lit("a"))
    return d.select("doc_id", code.alias("type_code"), corpus.genre_of(code).alias("genre"),
                    sent_no.alias("sentence_number"),
                    corpus.source_sentence_number(sent_no).alias("lookup_sentence_number"))


_codes = ", ".join(f"'{c}'" for c in TYPE_CODES)
_genre_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.GENRE_MAP.items())
_quirk_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.SENTENCE_QUIRKS.items())
register("genre_map", f"""
WITH c AS (
  SELECT doc_id, [{_codes}][{sql_bucket("'type:' || CAST(doc_id AS VARCHAR)", len(TYPE_CODES))} + 1]
         AS type_code, CAST(doc_id AS VARCHAR) || 'a' AS sentence_number
  FROM documents
)
SELECT doc_id, type_code, CASE type_code {_genre_case} ELSE 'unknown' END AS genre,
       sentence_number,
       CASE sentence_number {_quirk_case} ELSE sentence_number END AS lookup_sentence_number
FROM c
""")(genre_map)
