"""Evaluation: split checks, class weight, P/R/F1/accuracy overall and by
group, discordant pairs and the mid-p McNemar test.

Every function aggregates a long ``predictions`` table
``(id, model, split, genre, y, pred)`` with one pass of partial (map-side)
aggregation; nothing is predicted twice and nothing is collected except the
class-weight scalar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figura.functions.stats import mcnemar_midp, ratio0

OVERALL = "overall"


def _counts(y: Column, pred: Column) -> list[Column]:
    yi, pi = y.cast("int"), pred.cast("int")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((yi == 1) & (pi == 1)).alias("tp"),
        F.count_if((yi == 0) & (pi == 1)).alias("fp"),
        F.count_if((yi == 1) & (pi == 0)).alias("fn"),
        F.count_if(yi == pi).alias("correct"),
    ]


def _metrics(df: DataFrame, keep: list[str], digits: int | None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    cols = {
        "precision": ratio0(tp, tp + fp),
        "recall": ratio0(tp, tp + fn),
        "f1": ratio0(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio0(F.col("correct"), F.col("n")),
    }
    if digits is not None:
        cols = {k: F.round(v, digits) for k, v in cols.items()}
    return df.select(*keep, *[v.alias(k) for k, v in cols.items()], "n")


def prf_by_group(predictions: DataFrame, group: str = "genre", model: str = "model",
                 y: str = "y", pred: str = "pred", digits: int | None = None) -> DataFrame:
    """Binary P/R/F1 (positive class 1) and accuracy per (model, group) and
    per model overall, in one aggregation over ``GROUPING SETS``.

    Undefined ratios are 0. The overall row has ``group = 'overall'``.
    """
    agg = (predictions
           .groupingSets([[F.col(model), F.col(group)], [F.col(model)]], F.col(model), F.col(group))
           .agg(*_counts(F.col(y), F.col(pred)), F.grouping(F.col(group)).alias("_g")))
    agg = agg.withColumn(group, F.when(F.col("_g") == 1, F.lit(OVERALL)).otherwise(F.col(group)))
    return _metrics(agg, [model, group], digits)


def with_feature_width(metrics: DataFrame, widths: DataFrame, model: str = "model") -> DataFrame:
    """Attach ``n_features`` per model; ``widths`` has one row per model."""
    return metrics.join(F.broadcast(widths), model, "left")


def split_sizes(examples: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return examples.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def split_integrity(examples: DataFrame, id_col: str = "id", split: str = "split",
                    allowed=("train", "dev", "test")) -> DataFrame:
    """One row: total rows, rows outside the allowed splits and ids that
    occur in more than one split (all must be 0 for a valid split)."""
    per_id = examples.groupBy(id_col).agg(F.countDistinct(split).alias("k"),
                                          F.count(F.lit(1)).alias("c"),
                                          F.count_if(~F.coalesce(F.col(split).isin(*allowed), F.lit(False))).alias("bad"))
    return per_id.agg(F.sum("c").cast("bigint").alias("n_rows"),
                      F.sum("bad").cast("bigint").alias("n_outside"),
                      F.count_if(F.col("k") > 1).alias("n_overlap"))


def class_weight(train: DataFrame, y: str = "y") -> DataFrame:
    """Positive-class weight ``sum(1 - y) / sum(y)`` as a one-row frame."""
    yi = F.col(y).cast("bigint")
    return train.agg(F.sum(yi).alias("n_pos"), F.sum(1 - yi).alias("n_neg")) \
        .select("n_pos", "n_neg", ratio0(F.col("n_neg"), F.col("n_pos")).alias("pos_weight"))


def discordant_counts(predictions: DataFrame, pairs: list[tuple[str, str]],
                      id_col: str = "id", model: str = "model",
                      y: str = "y", pred: str = "pred") -> DataFrame:
    """For each (model_a, model_b): ``b`` = a right and a != b, ``c`` = b
    right and b != a, on the examples both models scored.

    The long table is pivoted to one row per example (an equi-join on the
    example id without the shuffle of a self-join), then each pair is a pair
    of conditional counts.
    """
    models = sorted({m for p in pairs for m in p})
    wide = (predictions.where(F.col(model).isin(*models))
            .groupBy(id_col)
            .agg(F.first(y).alias("_y"),
                 *[F.max(F.when(F.col(model) == m, F.col(pred))).alias(f"_p_{m}") for m in models]))
    aggs = []
    for a, b in pairs:
        pa, pb, yy = F.col(f"_p_{a}"), F.col(f"_p_{b}"), F.col("_y")
        aggs.append(F.count_if((pa == yy) & (pa != pb)).alias(f"b__{a}__{b}"))
        aggs.append(F.count_if((pb == yy) & (pb != pa)).alias(f"c__{a}__{b}"))
    one = wide.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     F.col(f"b__{a}__{b}").alias("b"), F.col(f"c__{a}__{b}").alias("c"))
            for a, b in pairs]
    return one.select(F.inline(F.array(*rows)))


def significance(predictions: DataFrame, pairs: list[tuple[str, str]],
                 digits: int | None = None, **kw) -> DataFrame:
    """Discordant counts plus the mid-p McNemar p-value per model pair."""
    d = discordant_counts(predictions, pairs, **kw)
    p = mcnemar_midp(F.col("b"), F.col("c"))
    if digits is not None:
        p = F.round(p, digits)
    return d.withColumn("midp", p)
