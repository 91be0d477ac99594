"""Text encoders: the batched-encoder contract (any callable that turns a
list of texts into a float matrix, run with ``mapInPandas`` over Arrow
batches of *distinct* texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.functions.vectors import zero_vector
from figura.operators.features import spread_blanks

EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]

# One encoder per Python worker process, built on first use (models are
# loaded once per executor, never serialised with the task).
_ENCODERS: dict = {}


def _get_encoder(factory: EncoderFactory):
    # by content: factories of one function with other parameters differ
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    enc = _ENCODERS.get(key)
    if enc is None:
        enc = _ENCODERS[key] = factory()
    return enc


HELD_WORDS = 500_000      # words whose hashes an encoder keeps between batches


class _Hashes(dict):
    """Hashes of the words met, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = got = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
        return got


class HashingEncoder:
    """Deterministic stand-in encoder: signed feature hashing of lower-cased
    whitespace tokens into ``dim`` buckets, averaged over tokens. A token's
    hash is the first 8 hex digits of its md5; hashes with the top bit add 1,
    others take 1 off."""

    def __init__(self, dim: int = 300):
        self.dim = dim
        self.hashes = _Hashes()

    def __call__(self, texts: list[str]) -> np.ndarray:
        tokens = [t.lower().split() for t in texts]
        if len(self.hashes) > HELD_WORDS:
            self.hashes.clear()
        sizes = np.array([len(ws) for ws in tokens], np.int64)
        hashes = np.fromiter(map(self.hashes.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
        at = np.repeat(np.arange(len(texts)), sizes) * self.dim + hashes % self.dim
        sums = np.bincount(at, np.where(hashes >> 31 == 1, 1.0, -1.0), len(texts) * self.dim)
        return sums.reshape(len(texts), self.dim).astype(np.float32) / np.maximum(sizes, 1).astype(np.float32)[:, None]


def hashing_encoder_factory(dim: int = 300) -> EncoderFactory:
    def factory():
        return HashingEncoder(dim)
    factory.__qualname__ = f"hashing_encoder_{dim}"
    return factory


def encode_texts(texts: DataFrame, col: str, factory: EncoderFactory, dim: int,
                 name: str = "vec", batch_rows: int = 256, blanks: bool = False) -> DataFrame:
    """Encode the *distinct* values of ``col`` once each:
    ``(col, name array<float>)``. Nulls, and blanks unless ``blanks``, never
    reach the encoder."""
    values = texts.select(F.col(col).alias("_t"))
    distinct = values.where(F.col("_t").isNotNull() if blanks else F.col("_t") != "").distinct()
    # texts are short and their vectors are not: a number of tasks that isn't cut down to the texts' bytes
    distinct = distinct.repartition(texts.sparkSession.sparkContext.defaultParallelism)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _get_encoder(factory)
        for pdf in it:
            vals = pdf["_t"].tolist()
            for s in range(0, len(vals), batch_rows):
                chunk = vals[s:s + batch_rows]
                m = np.asarray(enc(chunk), dtype=np.float32).reshape(len(chunk), dim)
                yield pd.DataFrame({"_t": chunk, "_v": list(m)})

    return distinct.mapInPandas(run, "_t string, _v array<float>") \
        .select(F.col("_t").alias(col), F.col("_v").alias(name))


def encode_rows(rows: DataFrame, key: str, col: str, factory: EncoderFactory, dim: int,
                name: str = "vec", batch_rows: int = 256) -> DataFrame:
    """Encode the texts of rows that are distinct already: ``(key, name
    array<float>)``, so that what follows joins on the key and not on the
    text. Null and blank texts have no row."""
    src = rows.select(F.col(key).alias("_k"), F.col(col).alias("_t")).where(F.col("_t") != "")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _get_encoder(factory)
        for pdf in it:
            for s in range(0, len(pdf), batch_rows):
                chunk = pdf.iloc[s:s + batch_rows]
                m = np.asarray(enc(chunk["_t"].tolist()), dtype=np.float32).reshape(len(chunk), dim)
                yield pd.DataFrame({"_k": chunk["_k"].to_numpy(), "_v": list(m)})

    return src.mapInPandas(run, f"_k {dict(src.dtypes)['_k']}, _v array<float>") \
        .select(F.col("_k").alias(key), F.col("_v").alias(name))


def attach_encodings(df: DataFrame, roles: list[str], factory: EncoderFactory, dim: int,
                     suffix: str = "_emb", zero_roles: list[str] | None = None) -> DataFrame:
    """Encode the terms of all ``roles`` in one pass (distinct terms across
    roles) and join them back. Blanks of ``zero_roles`` (default: all roles)
    get zeros; a blank of another role is encoded like any other term."""
    zero_roles = roles if zero_roles is None else zero_roles
    stacked = F.array(*[F.when(F.col(r) != "", F.col(r)) if r in zero_roles else F.col(r) for r in roles])
    enc = encode_texts(df.select(F.explode(stacked).alias("_term")), "_term", factory, dim, "_vec", blanks=True)
    out = df
    for r in roles:
        key = spread_blanks(r, df.columns) if r in zero_roles else F.col(r)
        out = (out.withColumn("_jk", key)
               .join(enc.select(F.col("_term").alias("_jk"), F.col("_vec").alias(f"{r}{suffix}")), "_jk", "left")
               .drop("_jk")
               .withColumn(f"{r}{suffix}", F.coalesce(F.col(f"{r}{suffix}"), zero_vector(dim))))
    return out
