"""Classification and evaluation as one job: feature store -> L / LA / LAC
models -> metrics overall and by genre, significance of adjacent models,
dev predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.operators import analysis, evaluate, train
from figura.operators.features import FEATURE_SETS
from figura.operators.sampling import seeded_sample
from figura.session import few
from figura.sources import readers

PAIRS = [("l", "la"), ("la", "lac")]


def unknown_partition(c: str):
    """An expression that fails the job, naming the partition it met."""
    return F.raise_error(F.concat(F.lit("unknown partition: "), F.coalesce(F.col(c), F.lit("null")))).cast("string")


def with_split(facts: DataFrame, n_dev: int = 0, seed: int = 0) -> DataFrame:
    """``split`` = test / dev (seeded exact-size sample of train) / train.
    Any other partition, null included, is an error."""
    dev = seeded_sample(facts.where(F.col("partition") == "train").select("id"), n_dev, seed) \
        .withColumn("_dev", F.lit(True))
    return (facts.join(few(dev, n_dev), "id", "left")
            .withColumn("split", F.when(F.col("partition") == "test", "test")
                        .when(F.col("_dev"), "dev")
                        .when(F.col("partition") == "train", "train")
                        .otherwise(unknown_partition("partition"))).drop("_dev"))


def classify(facts: DataFrame, contexts: DataFrame, n_dev: int = 0, seed: int = 0,
             classifier=None, digits: int | None = None, examples: DataFrame | None = None,
             export: str | None = None):
    """Returns ``(metrics, significance, dev_predictions)``; the last is
    None when ``n_dev`` is 0. With the ``examples`` table the dev rows carry
    its columns; ``export`` is a path to write them to as CSV."""
    data = with_split(facts.join(contexts.select("ctx_id", "ctx_emb"), "ctx_id"), n_dev, seed)
    preds = train.ablation(data, FEATURE_SETS, classifier)
    test = preds.where(F.col("split") == "test")
    widths = test.groupBy("model").agg(F.max("n_features").alias("n_features"))
    metrics = evaluate.with_feature_width(evaluate.prf_by_group(test, digits=digits), widths)
    sig = evaluate.significance(test, PAIRS, digits=digits)
    dev = None
    if n_dev:
        dev = analysis.predictions_wide(preds.where(F.col("split") == "dev"))
        if examples is not None:
            dev = analysis.with_example_columns(dev, examples)
        if export:
            readers.write_csv(dev, export)
    return metrics, sig, dev
