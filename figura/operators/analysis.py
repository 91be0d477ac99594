"""Error analysis over dev predictions: wide export, annotation join,
sampled error tables and grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.operators.sampling import sample_per_group


def predictions_wide(preds: DataFrame, models=("l", "la", "lac"), id_col: str = "id",
                     keep=("genre", "y"), prefix: str = "y_pred_") -> DataFrame:
    """One row per example with a ``y_pred_<model>`` column per model
    (conditional aggregation: one shuffle on the id, no self-joins)."""
    return preds.groupBy(id_col).agg(
        *[F.max(k).alias(k) for k in keep],
        *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"{prefix}{m}") for m in models])


def with_example_columns(wide: DataFrame, examples: DataFrame, on: str = "id") -> DataFrame:
    """The prediction rows followed by the example table's other columns."""
    extra = [c for c in examples.columns if c == on or c not in wide.columns]
    return wide.join(examples.select(*extra), on)


def annotate(rows: DataFrame, annots: DataFrame, on: str = "id") -> DataFrame:
    """Left join of rows with an annotation relation; unannotated rows get
    null labels. No broadcast hint: AQE broadcasts the relation only when
    its measured size is under the broadcast threshold."""
    return rows.join(annots, on, "left")


def group_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group; a null label is its own group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def errors_long(wide: DataFrame, models=("l", "la", "lac"), y: str = "y",
                prefix: str = "y_pred_") -> DataFrame:
    """Unpivot per-model prediction columns and keep the wrong ones
    (``pred != y``; a null prediction drops out)."""
    stacked = wide.withColumn("_m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{prefix}{m}").alias("pred")) for m in models])))
    return (stacked.select("*", "_m.model", "_m.pred").drop("_m")
            .where(F.col("pred") != F.col(y)))


def error_sample_counts(wide: DataFrame, n: int, seed: int = 0, models=("l", "la", "lac"),
                        label: str = "ctx_label", id_col: str = "id") -> DataFrame:
    """For each model: its wrong rows, a seeded sample of ``n`` of them (all
    when fewer), counted by annotation label."""
    wrong = errors_long(wide, models)
    sampled = sample_per_group(wrong, ["model"], n, seed, id_col=id_col)
    return group_counts(sampled, ["model", label])
