"""Dense features: term-vector lookup, mean pooling of token vectors,
first-seen context dictionary, context gather, feature assembly and the
Parquet feature store.

Vectors are ``array<float>``; they become ML vectors only at the model
boundary. Mean pooling is a blocked product of token counts and vectors
(``figura.operators.product``), so no vector is shuffled per token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.functions.vectors import blank_to_zero, zero_vector
from figura.operators import product
from figura.operators.sampling import dense_index

KeyFn = Callable[[Column], Column]


def identity_key(term: Column) -> Column:
    return term


class Vocabulary:
    """A vector table ``(key, vector)`` plus the function that maps a term
    to its key (the term itself for a word-vector table)."""

    def __init__(self, vectors: DataFrame, key_col: str, vec_col: str, dim: int,
                 key_fn: KeyFn = identity_key):
        self.vectors = vectors.select(F.col(key_col).alias("_key"), F.col(vec_col).alias("_vec"))
        self.dim = dim
        self.key_fn = key_fn
        self._files: list[str] | None = None

    def blocks(self) -> list[str]:
        """The vector table's files, written once (see ``product``)."""
        if self._files is None:
            self._files = product.stage_blocks(self.vectors, "_key", "_vec")
        return self._files


def spread_blanks(term: str, columns: list[str], ways: int = 4096) -> Column:
    """Join key of a term column whose blanks (the commonest value) match
    nothing: they are dealt to ``ways`` keys that no term has (a NUL first) by
    a hash of the row, so that no task gets all of them."""
    deal = F.pmod(F.xxhash64(*columns), F.lit(ways)).cast("string")
    return F.when(F.coalesce(F.col(term), F.lit("")) != "", F.col(term)).otherwise(F.concat(F.lit("\0"), deal))


def term_vectors(df: DataFrame, roles: list[str], vocab: Vocabulary,
                 suffix: str = "_emb", zero_roles: list[str] | None = None) -> DataFrame:
    """Attach a vector per role column (verb, subject, object ...).

    The terms of all roles are stacked in one pass, looked up once each and
    joined back. A blank of a role in ``zero_roles`` (default: all roles) is
    never looked up and gets zeros; a blank of another role is a term like any
    other. Terms without a vector get zeros.
    """
    zero_roles = roles if zero_roles is None else zero_roles
    looked_up = F.array(*[F.when(F.col(r) != "", F.col(r)) if r in zero_roles else F.col(r) for r in roles])
    terms = df.select(F.explode(looked_up).alias("_term")).where(F.col("_term").isNotNull())
    looked = (terms.distinct().withColumn("_key", vocab.key_fn(F.col("_term")))
              .join(vocab.vectors, "_key", "left").select("_term", "_vec"))
    out = df
    for r in roles:
        v = looked.select(F.col("_term").alias("_jk"), F.col("_vec").alias(f"{r}{suffix}"))
        key = spread_blanks(r, df.columns) if r in zero_roles else F.col(r)
        out = out.withColumn("_jk", key).join(v, "_jk", "left").drop("_jk")
        vec = F.col(f"{r}{suffix}")
        fill = blank_to_zero(F.col(r), vec, vocab.dim) if r in zero_roles \
            else F.coalesce(vec, zero_vector(vocab.dim))
        out = out.withColumn(f"{r}{suffix}", fill)
    return out


def mean_pool(tokens: DataFrame, key: str, token: str, vocab: Vocabulary,
              docs: DataFrame | None = None, name: str = "ctx_emb",
              dtype: str = "float32") -> DataFrame:
    """Mean of the token vectors of each ``key`` group of a token table;
    unknown tokens count as zero vectors, and groups without tokens (rows of
    ``docs``) get zeros.

    Tokens are counted per (group, token) first; a group's distinct tokens and
    counts become one row, which meets the vectors in
    ``product.mean_vectors``. Where texts are at hand, ``mean_pool_arrays``
    needs no shuffle of tokens at all.
    """
    counts = (tokens.groupBy(key, F.col(token).alias("_tok")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
              .select(key, F.struct(vocab.key_fn(F.col("_tok")).alias("k"), F.col("_w").alias("w")).alias("_p"))
              .groupBy(key).agg(F.collect_list("_p").alias("_p"))
              .select(key, F.col("_p.k").alias("_k"), F.col("_p.w").alias("_w")))
    pooled = product.mean_vectors(counts, key, "_k", vocab.blocks(), vocab.dim, name, dtype, weights="_w")
    if docs is not None:
        zeros = F.array_repeat(F.lit(0.0).cast("float" if dtype == "float32" else "double"), vocab.dim)
        pooled = docs.select(key).join(pooled, key, "left") \
            .withColumn(name, F.coalesce(F.col(name), zeros))
    return pooled


def mean_pool_arrays(docs: DataFrame, key: str, tokens: Column, vocab: Vocabulary, name: str = "ctx_emb",
                     dtype: str = "float32") -> DataFrame:
    """``mean_pool`` of documents with their tokens in an array: one row per
    row of ``docs``. Neither tokens nor vectors are shuffled."""
    keyed = docs.select(key, F.transform(tokens, vocab.key_fn).alias("_k"))
    return product.mean_vectors(keyed, key, "_k", vocab.blocks(), vocab.dim, name, dtype)


def context_dictionary(df: DataFrame, context: str = "min_context", order: str = "id",
                       name: str = "ctx_id") -> DataFrame:
    """Distinct contexts numbered 0, 1, ... in first-seen order.

    Grouping and numbering see SHA-256 keys and ``order`` only (the number
    without a one-partition window, see ``dense_index``); each text is fetched
    by its first row afterwards."""
    keyed = df.select(F.sha2(F.col(context), 256).alias("ctx_key"), F.col(order).alias("first_seen"), context)
    firsts = keyed.groupBy("ctx_key").agg(F.min("first_seen").alias("first_seen"), F.count(F.lit(1)).alias("n_rows"))
    numbered = dense_index(firsts, ["first_seen", "ctx_key"], name=name, start=0)
    texts = keyed.join(numbered, ["ctx_key", "first_seen"])
    # rows that repeat (order, context) carry one text
    return texts.dropDuplicates(["ctx_key", "first_seen"]).select("ctx_key", "first_seen", context, "n_rows", name)


def gather_contexts(examples: DataFrame, dictionary: DataFrame, context: str = "min_context",
                    name: str = "ctx_id") -> DataFrame:
    """Attach each example's context id (join on the context hash)."""
    keys = dictionary.select("ctx_key", name)
    return (examples.withColumn("ctx_key", F.sha2(F.col(context), 256))
            .join(keys, "ctx_key", "left").drop("ctx_key"))


# Fixed value: the ablation feature groups in concatenation order.
FEATURE_SETS = {
    "l": ["v_emb"],
    "la": ["v_emb", "s_emb", "o_emb"],
    "lac": ["v_emb", "s_emb", "o_emb", "ctx_emb"],
}


def assemble(df: DataFrame, parts: list[str], name: str = "features") -> DataFrame:
    """Concatenate vector columns in the order given, with the width."""
    return df.withColumn(name, F.concat(*[F.col(p) for p in parts])) \
        .withColumn("n_features", F.size(name))


def write_feature_store(features: DataFrame, contexts: DataFrame, path: str) -> None:
    """Two Parquet tables: the context dimension (stored once) and the
    per-example fact table partitioned by ``partition``."""
    contexts.write.mode("overwrite").parquet(f"{path}/contexts")
    features.write.mode("overwrite").partitionBy("partition").parquet(f"{path}/features")


def read_feature_store(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/contexts")


def write_bucketed_store(features: DataFrame, contexts: DataFrame, path: str, name: str, buckets: int) -> None:
    """The feature store as two tables, ``<name>_features`` (partitioned by
    ``partition``) and ``<name>_contexts``, with their files under ``path``,
    both dealt into ``buckets`` by ``ctx_id`` and sorted by it: the join that
    gathers contexts then moves nothing."""
    for df, part in ((features, "features"), (contexts, "contexts")):
        rows = df.repartition(buckets, "ctx_id").write.mode("overwrite").bucketBy(buckets, "ctx_id").sortBy("ctx_id")
        rows = rows.partitionBy("partition") if part == "features" else rows
        rows.option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}")


def gather_from_store(spark, name: str) -> DataFrame:
    """Each example of a bucketed store with its context."""
    facts, contexts = spark.table(f"{name}_features"), spark.table(f"{name}_contexts")
    return facts.join(contexts.hint("merge"), "ctx_id")
