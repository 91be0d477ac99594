"""Driver queries: vector lookup, mean pooling, context dictionary and
gather, layer slicing, feature concatenation, feature-store round trip.

Vectors are returned in long form ``(key, pos, value)`` with values rounded
to ``DIGITS`` so the oracle compare is value based.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.functions import text as T
from figura.functions.vectors import first_token, last_layer, reshape3
from figura.operators import features as FT
from figura.plans.catalog import register
from figura.plans.extract import extract_with_vocabulary
from figura.plans.q_text import SQL_INFIX_TOKENS, SQL_WORD_TOKENS
from figura.functions.hashing import bucket
from figura.plans.tables import (DIGITS, EXAMPLES_SQL, VOCAB_SQL, examples, read, read_spread,
                                 sql_bucket, sql_vocab_key, vocabulary)
from figura.session import shared_path, staged

R = DIGITS
NL = "chr(10)"


def _long(df, key, vec, extra=()):
    return df.select(*key, *extra, F.posexplode(vec).alias("pos", "_v")) \
        .select(*key, *extra, "pos", F.round(F.col("_v").cast("double"), R).alias("value"))


# ------------------------------------------------------------- mean pooling

def mean_pool(spark, sf_dir):
    """Mean word vector of every document (infix tokenizer; unknown tokens
    count as zeros; no tokens gives zeros)."""
    docs = read_spread(spark, sf_dir, "documents")
    vocab = vocabulary(spark, sf_dir)
    pooled = FT.mean_pool_arrays(docs, "doc_id", T.infix_tokens("text"), vocab, dtype="float64")
    return _long(pooled, ["doc_id"], "ctx_emb")


_MEAN_POOL_SQL = f"""
t AS (SELECT doc_id, unnest({SQL_INFIX_TOKENS.format('text')}) AS tok FROM documents),
c AS (SELECT doc_id, {sql_vocab_key('tok')} AS k, count(*) AS w FROM t GROUP BY 1, 2),
x AS (
  SELECT c.doc_id, c.w, dims.pos, coalesce(CAST(e.embedding[dims.pos + 1] AS DOUBLE), 0.0) AS val
  FROM c LEFT JOIN embeddings e ON c.k = e.vec_id, dims
),
pooled AS (SELECT doc_id, pos, sum(w * val) / sum(w) AS value FROM x GROUP BY 1, 2)"""

register("mean_pool", f"""
WITH {VOCAB_SQL}, {_MEAN_POOL_SQL}
SELECT d.doc_id, CAST(dims.pos AS INTEGER) AS pos, (round(coalesce(p.value, 0.0), {R}) + 0.0) AS value
FROM documents d CROSS JOIN dims LEFT JOIN pooled p ON d.doc_id = p.doc_id AND dims.pos = p.pos
""")(mean_pool)


# ------------------------------------------------------------- term vectors

# Of how many examples one has no subject, and one no object.
BLANKS = 4


def drawn_word(words, kind: str, key="id"):
    """A word of the whole text drawn by md5 ('' if the text has none)."""
    at = bucket(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")), F.greatest(F.size(words), F.lit(1)))
    return F.coalesce(F.get(words, at.cast("int")), F.lit(""))


def sql_drawn_word(words: str, kind: str, key: str = "id") -> str:
    return f"coalesce({words}[{sql_bucket(f"'{kind}:' || CAST({key} AS VARCHAR)", f'greatest(len({words}), 1)')} + 1], '')"


def _roles(spark, sf_dir):
    """Per labelled document: verb, subject and object drawn from all words of
    its text; one example in four has no subject, one no object."""
    docs = read(spark, sf_dir, "documents")
    ex = examples(spark, sf_dir).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").withColumn("_w", T.word_tokens("text"))

    def argument(kind):
        blank = bucket(F.concat(F.lit(f"no {kind}:"), F.col("id").cast("string")), BLANKS) == 0
        return F.when(blank, F.lit("")).otherwise(drawn_word(F.col("_w"), kind)).alias(kind)
    return ex.select("id", "y", "partition", "genre", "text", drawn_word(F.col("_w"), "v").alias("v"), argument("s"), argument("o"))


def _as_examples(spark, sf_dir):
    """The same rows under the column names of the example table."""
    return _roles(spark, sf_dir).withColumnsRenamed(
        {"text": "min_context", "v": "verb_lemma", "s": "subject", "o": "object"}).where(F.col("min_context").isNotNull())


_ROLES_SQL = EXAMPLES_SQL + f""",
worded AS (
  SELECT e.*, d.text, {SQL_WORD_TOKENS.format('d.text')} AS words FROM examples e JOIN documents d ON e.id = d.doc_id
),
roles AS (
  SELECT * EXCLUDE (words), {sql_drawn_word('words', 'v')} AS v,
         {", ".join(f"CASE WHEN {sql_bucket(f"'no {r}:' || CAST(id AS VARCHAR)", BLANKS)} = 0 THEN '' ELSE {sql_drawn_word('words', r)} END AS {r}"
                    for r in ("s", "o"))}
  FROM worded
)"""


def blank_zero_vector(spark, sf_dir):
    """Verb/subject/object vectors; blank or unknown terms are zeros."""
    vecs = FT.term_vectors(_roles(spark, sf_dir), ["v", "s", "o"], vocabulary(spark, sf_dir))
    stacked = vecs.select("id", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r).alias("term"), F.col(f"{r}_emb").alias("vec"))
        for r in ("v", "s", "o")])).alias("r"))
    return _long(stacked.select("id", "r.role", "r.term", "r.vec"), ["id", "role", "term"], "vec")


_TERM_VEC_SQL = """
stack AS (
  SELECT id, 'v' AS role, v AS term FROM roles UNION ALL
  SELECT id, 's', s FROM roles UNION ALL SELECT id, 'o', o FROM roles
),
tv AS (
  SELECT s.id, s.role, s.term, dims.pos,
         CASE WHEN s.term = '' THEN 0.0 ELSE coalesce(CAST(e.embedding[dims.pos + 1] AS DOUBLE), 0.0) END AS value
  FROM stack s CROSS JOIN dims
  LEFT JOIN embeddings e ON s.term <> '' AND e.vec_id = """ + sql_vocab_key("s.term") + """
)"""

register("blank_zero_vector", f"""
WITH {VOCAB_SQL}, {_ROLES_SQL}, {_TERM_VEC_SQL}
SELECT id, role, term, CAST(pos AS INTEGER) AS pos, (round(value, {R}) + 0.0) AS value FROM tv
""")(blank_zero_vector)


# ------------------------------------------------------------- layers

LAYERS, TOKENS = 4, 2   # a 64-wide stand-in vector read as 4 layers x 2 tokens x 8


def layer_slice(spark, sf_dir):
    """Reshape each vector into layers x tokens x dims, keep the last layer
    (index 2 of a 3+ layer encoding) and its first token."""
    emb = read(spark, sf_dir, "embeddings")
    d = emb.agg(F.max(F.size("embedding"))).first()[0]
    width = d // (LAYERS * TOKENS)
    layered = emb.select("vec_id", reshape3("embedding", LAYERS, TOKENS, width).alias("layers"))
    picked = layered.select("vec_id", first_token(F.array(last_layer("layers"))).alias("tok"))
    return _long(picked, ["vec_id"], "tok")


register("layer_slice", f"""
WITH w AS (SELECT max(len(embedding)) // {LAYERS * TOKENS} AS width FROM embeddings)
SELECT vec_id, CAST(g.pos AS INTEGER) AS pos,
       (round(CAST(embedding[2 * {TOKENS} * w.width + g.pos + 1] AS DOUBLE), {R}) + 0.0) AS value
FROM embeddings, w, (SELECT unnest(range(0, (SELECT width FROM w))) AS pos) g
""")(layer_slice)


# ------------------------------------------------------------- assembly

def _features(spark, sf_dir):
    roles = staged(_roles(spark, sf_dir), "roles")       # read by the term list, its join and the contexts
    vocab = vocabulary(spark, sf_dir)
    vecs = FT.term_vectors(roles.drop("text"), ["v", "s", "o"], vocab)
    ctx = FT.mean_pool_arrays(roles, "id", T.infix_tokens("text"), vocab, dtype="float32")
    # reused by several branches of the calling plans
    return staged(vecs.join(ctx, "id"), "features")


def feature_concat(spark, sf_dir):
    """LAC feature vector (verb, subject, object, context) per example."""
    f = FT.assemble(_features(spark, sf_dir), FT.FEATURE_SETS["lac"])
    return _long(f, ["id"], "features", extra=["n_features"])


register("feature_concat", f"""
WITH {VOCAB_SQL}, {_ROLES_SQL}, {_TERM_VEC_SQL},
t AS (SELECT id AS doc_id, unnest({SQL_INFIX_TOKENS.format('text')}) AS tok FROM roles),
c AS (SELECT doc_id, {sql_vocab_key('tok')} AS k, count(*) AS w FROM t GROUP BY 1, 2),
x AS (
  SELECT c.doc_id, c.w, dims.pos, coalesce(CAST(e.embedding[dims.pos + 1] AS DOUBLE), 0.0) AS val
  FROM c LEFT JOIN embeddings e ON c.k = e.vec_id, dims
),
pooled AS (SELECT doc_id AS id, pos, CAST(CAST(sum(w * val) / sum(w) AS FLOAT) AS DOUBLE) AS value
           FROM x GROUP BY 1, 2),
parts AS (
  SELECT id, CASE role WHEN 'v' THEN 0 WHEN 's' THEN 1 ELSE 2 END AS part, pos, value FROM tv
  UNION ALL
  SELECT r.id, 3, dims.pos, coalesce(p.value, 0.0) FROM roles r CROSS JOIN dims
  LEFT JOIN pooled p ON r.id = p.id AND dims.pos = p.pos
)
SELECT id, CAST(4 * (SELECT d FROM vsize) AS INTEGER) AS n_features,
       CAST(part * (SELECT d FROM vsize) + pos AS INTEGER) AS pos, (round(value, {R}) + 0.0) AS value
FROM parts
""")(feature_concat)


# ------------------------------------------------------------- dictionary

def context_dictionary(spark, sf_dir):
    """Distinct document texts numbered in first-seen (doc_id) order."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("min_context"))
    d = FT.context_dictionary(docs)
    return d.select("ctx_id", "first_seen", "n_rows", F.md5("min_context").alias("context_md5"))


register("context_dictionary", """
WITH g AS (SELECT text, min(doc_id) AS first_seen, count(*) AS n_rows FROM documents GROUP BY text)
SELECT row_number() OVER (ORDER BY first_seen) - 1 AS ctx_id, first_seen, n_rows, md5(text) AS context_md5
FROM g
""")(context_dictionary)


def context_gather(spark, sf_dir):
    """Each example's context id in the dictionary of example contexts,
    and how many examples share that context."""
    roles = _roles(spark, sf_dir).select("id", F.col("text").alias("min_context"))
    d = FT.context_dictionary(roles)
    g = FT.gather_contexts(roles, d)
    return g.join(d.select("ctx_id", F.col("n_rows").alias("ctx_examples")), "ctx_id") \
        .select("id", "ctx_id", "ctx_examples")


_DICT_SQL = """
dict AS (
  SELECT text, row_number() OVER (ORDER BY min(id)) - 1 AS ctx_id, count(*) AS ctx_examples
  FROM roles GROUP BY text
)"""

register("context_gather", f"""
WITH {VOCAB_SQL}, {_ROLES_SQL}, {_DICT_SQL}
SELECT r.id, d.ctx_id, d.ctx_examples FROM roles r JOIN dict d ON r.text = d.text
""")(context_gather)


def feature_store_roundtrip(spark, sf_dir):
    """Write the context dimension and the example facts (partitioned by
    split partition, bucketed by context) to the shared store, read them back
    and gather."""
    facts, dims = extract_with_vocabulary(_as_examples(spark, sf_dir), vocabulary(spark, sf_dir))
    path = shared_path(spark, "feature-store")
    name = "store_" + path.rsplit("-", 1)[1]
    FT.write_bucketed_store(facts, dims, path, name, int(spark.conf.get("spark.sql.shuffle.partitions")))
    back = FT.gather_from_store(spark, name)
    return back.select("id", "ctx_id", "y", "partition", "genre",
                       (F.size("v_emb") + F.size("s_emb") + F.size("o_emb") + F.size("ctx_emb"))
                       .alias("n_features"))


register("feature_store_roundtrip", f"""
WITH {VOCAB_SQL}, {_ROLES_SQL}, {_DICT_SQL}
SELECT r.id, d.ctx_id, r.y, r.partition, r.genre, CAST(4 * (SELECT d FROM vsize) AS INTEGER) AS n_features
FROM roles r JOIN dict d ON r.text = d.text
""")(feature_store_roundtrip)
