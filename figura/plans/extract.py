"""Feature extraction as one job: example table -> context dimension and
per-example vectors -> Parquet feature store.

Distinct contexts are encoded once each; distinct verb/subject/object terms
are looked up once each; blank arguments are zero vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.functions import text as T
from figura.operators import encode
from figura.operators import features as FT
from figura.session import staged

FACTS = ["id", "ctx_id", "y", "partition", "genre", "v", "s", "o"]      # what an example takes through the joins: no text
ROLES = {"v": "verb_lemma", "s": "subject", "o": "object"}


def _terms(examples: DataFrame) -> DataFrame:
    """The examples with their role terms, written once: the dictionary, its
    texts, the terms and the facts each read them."""
    return staged(examples.select("*", *[F.coalesce(F.col(src), F.lit("")).alias(r) for r, src in ROLES.items()]), "extraction-examples")


def extract_with_vocabulary(examples: DataFrame, vocab: FT.Vocabulary,
                            tokens=T.infix_tokens, zero_roles=("v", "s", "o")) -> tuple[DataFrame, DataFrame]:
    """Word-vector features: contexts are the mean of their token vectors
    (unknown tokens count as zeros); terms are looked up directly."""
    ex = _terms(examples)
    dictionary = FT.context_dictionary(ex)
    ctx_vec = FT.mean_pool_arrays(dictionary, "ctx_id", tokens("min_context"), vocab)
    contexts = dictionary.join(ctx_vec, "ctx_id").select("ctx_id", "min_context", "ctx_emb")
    facts = FT.term_vectors(FT.gather_contexts(ex, dictionary).select(*FACTS), list(ROLES), vocab,
                            zero_roles=list(zero_roles))
    return _facts(facts), contexts


def extract_with_encoder(examples: DataFrame, factory: encode.EncoderFactory, dim: int,
                         zero_roles=("s", "o")) -> tuple[DataFrame, DataFrame]:
    """Encoder features (any batched text encoder): distinct contexts and
    distinct terms encoded once each."""
    ex = _terms(examples)
    dictionary = FT.context_dictionary(ex)
    ctx_vec = encode.encode_rows(dictionary, "ctx_id", "min_context", factory, dim, "ctx_emb")
    contexts = dictionary.join(ctx_vec, "ctx_id", "left").select(
        "ctx_id", "min_context", F.coalesce("ctx_emb", F.array_repeat(F.lit(0.0).cast("float"), dim))
        .alias("ctx_emb"))
    facts = encode.attach_encodings(FT.gather_contexts(ex, dictionary).select(*FACTS), list(ROLES), factory, dim,
                                    zero_roles=list(zero_roles))
    return _facts(facts), contexts


def _facts(df: DataFrame) -> DataFrame:
    return df.select("id", "ctx_id", F.col("y").cast("int").alias("y"), "partition", "genre",
                     "v_emb", "s_emb", "o_emb")


def write_store(facts: DataFrame, contexts: DataFrame, path: str) -> None:
    FT.write_feature_store(facts, contexts, path)
