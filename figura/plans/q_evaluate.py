"""Driver queries: splits, class weight, metrics, significance, dev export,
error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from figura.operators import analysis, evaluate
from figura.plans.catalog import register
from figura.plans.tables import (DIGITS, MODEL_PAIRS, PREDICTIONS_SQL, SPLIT_SQL,
                                 WIDTHS_SQL, examples, feature_widths, predictions,
                                 with_dev_split)

R = DIGITS


def _round(expr: str) -> str:
    # + 0.0 turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round({expr}, {R}) + 0.0)"


_PRF_SQL = """
  count(*) AS n,
  count_if(y = 1 AND pred = 1) AS tp,
  count_if(y = 0 AND pred = 1) AS fp,
  count_if(y = 1 AND pred = 0) AS fn,
  count_if(y = pred) AS correct"""


def _metric_cols() -> str:
    return f"""
  {_round("coalesce(tp / nullif(tp + fp, 0), 0.0)")} AS precision,
  {_round("coalesce(tp / nullif(tp + fn, 0), 0.0)")} AS recall,
  {_round("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)")} AS f1,
  {_round("coalesce(correct / nullif(n, 0), 0.0)")} AS accuracy,
  n"""


# ------------------------------------------------------------- flagship

def prf_overall_by_genre(spark, sf_dir):
    """Test-split precision/recall/F1/accuracy per model, by genre and
    overall, with each model's feature width."""
    preds = predictions(spark, sf_dir).where(F.col("split") == "test")
    m = evaluate.prf_by_group(preds, group="genre", digits=R)
    return evaluate.with_feature_width(m, feature_widths(spark, sf_dir))


register("prf_overall_by_genre", f"""
WITH {PREDICTIONS_SQL}, {WIDTHS_SQL},
agg AS (
  SELECT model, CASE WHEN grouping(genre) = 1 THEN 'overall' ELSE genre END AS genre, {_PRF_SQL}
  FROM predictions WHERE split = 'test'
  GROUP BY GROUPING SETS ((model, genre), (model))
)
SELECT a.model, a.genre, {_metric_cols()}, w.n_features
FROM agg a LEFT JOIN widths w ON a.model = w.model
""")(prf_overall_by_genre)


# ------------------------------------------------------------- splits

def split_sizes(spark, sf_dir):
    ex = with_dev_split(examples(spark, sf_dir))
    sizes = evaluate.split_sizes(ex)
    integ = evaluate.split_integrity(ex)   # one row, attached as scalar subqueries
    return sizes.select("split", "n", *[integ.select(c).scalar().alias(c)
                                        for c in ("n_rows", "n_outside", "n_overlap")])


register("split_sizes", f"""
WITH {SPLIT_SQL},
integ AS (
  SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(bad) AS BIGINT) AS n_outside,
         CAST(count_if(k > 1) AS BIGINT) AS n_overlap
  FROM (SELECT id, count(DISTINCT split) AS k, count(*) AS c,
               count_if(split NOT IN ('train', 'dev', 'test')) AS bad
        FROM splits GROUP BY id) t
)
SELECT s.split, s.n, i.n_rows, i.n_outside, i.n_overlap
FROM (SELECT split, count(*) AS n FROM splits GROUP BY split) s, integ i
""")(split_sizes)


def class_weight(spark, sf_dir):
    ex = with_dev_split(examples(spark, sf_dir)).where(F.col("split") == "train")
    return evaluate.class_weight(ex).withColumn("pos_weight", F.round("pos_weight", R))


register("class_weight", f"""
WITH {SPLIT_SQL}
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
       {_round("coalesce(sum(1 - y) / nullif(sum(y), 0), 0.0)")} AS pos_weight
FROM splits WHERE split = 'train'
""")(class_weight)


def dev_sample(spark, sf_dir):
    ex = with_dev_split(examples(spark, sf_dir))
    return ex.select("id", "split", "y", "genre")


register("dev_sample", f"""
WITH {SPLIT_SQL}
SELECT id, split, y, genre FROM splits
""")(dev_sample)


# ------------------------------------------------------------- significance

def discordant_counts(spark, sf_dir):
    preds = predictions(spark, sf_dir).where(F.col("split") == "test")
    return evaluate.discordant_counts(preds, MODEL_PAIRS)


_PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in MODEL_PAIRS)
_DISC_SQL = f"""
pairs AS (SELECT * FROM (VALUES {_PAIRS_SQL}) t(model_a, model_b)),
disc AS (
  SELECT p.model_a, p.model_b,
         CAST(count_if(a.pred = a.y AND a.pred <> b.pred) AS BIGINT) AS b,
         CAST(count_if(b.pred = b.y AND b.pred <> a.pred) AS BIGINT) AS c
  FROM pairs p
  JOIN predictions a ON a.model = p.model_a AND a.split = 'test'
  JOIN predictions b ON b.model = p.model_b AND b.split = 'test' AND a.id = b.id
  GROUP BY p.model_a, p.model_b
)"""

register("discordant_counts", f"""
WITH {PREDICTIONS_SQL}, {_DISC_SQL}
SELECT model_a, model_b, b, c FROM disc
""")(discordant_counts)


def mcnemar_midp(spark, sf_dir):
    preds = predictions(spark, sf_dir).where(F.col("split") == "test")
    return evaluate.significance(preds, MODEL_PAIRS, digits=R)


# The test term by term, from the discordant counts ``disc``.
MIDP_SQL = f"""
SELECT model_a, model_b, b, c,
       {_round("2 * sum(pmf) - max(CASE WHEN k = least(b, c) THEN pmf END)")} AS midp
FROM (
  SELECT d.model_a, d.model_b, d.b, d.c, g.k,
         exp(lgamma(d.b + d.c + 1) - lgamma(g.k + 1) - lgamma(d.b + d.c - g.k + 1)
             - (d.b + d.c) * ln(2)) AS pmf
  FROM disc d, generate_series(0, CAST(least(d.b, d.c) AS BIGINT)) g(k)
) GROUP BY model_a, model_b, b, c
"""
register("mcnemar_midp", f"""
WITH {PREDICTIONS_SQL}, {_DISC_SQL}
{MIDP_SQL}
""")(mcnemar_midp)


# ------------------------------------------------------------- dev export

def dev_predictions_wide(spark, sf_dir):
    preds = predictions(spark, sf_dir).where(F.col("split") == "dev")
    return analysis.predictions_wide(preds, models=("l", "la", "lac"))


register("dev_predictions_wide", f"""
WITH {PREDICTIONS_SQL}
SELECT id, max(genre) AS genre, max(y) AS y,
       max(CASE WHEN model = 'l' THEN pred END) AS y_pred_l,
       max(CASE WHEN model = 'la' THEN pred END) AS y_pred_la,
       max(CASE WHEN model = 'lac' THEN pred END) AS y_pred_lac
FROM predictions WHERE split = 'dev' GROUP BY id
""")(dev_predictions_wide)
