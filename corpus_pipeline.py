"""Training-data pipeline over ``documents``.

``STAGES`` lists (name, function) in order; every function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which the driver (and
``run``) writes as Parquet and reads again as the next one's docs. All stages
but the last return the columns of documents. A stage works on everything its
predecessor kept; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figura.llm import decontaminate, linededup, packing, quality, simhash
from figura.llm.common import stage
from figura.llm.queries import MIN_RUN_WORDS
from figura.llm.tokens import vocabulary
from figura.session import prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their host's verdict rejects go; null
    and empty texts fail the base rule. An empty table stays empty (so in all
    stages)."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; no document goes,
    a text may become empty, a null text stays null."""
    got = linededup.delete_repeats(docs, MIN_RUN_WORDS)
    if "n_chars" in got.columns:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest id;
    null, empty and wordless texts are one group."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; null and empty texts have none."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences; a
    null or empty text is its end id alone."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 1024, end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", bestfit_packing),
]

#: Tokenisation and SimHash have no SQL form. Tests hold run() against the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
