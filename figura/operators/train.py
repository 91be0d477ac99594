"""Class-weighted training and the L / LA / LAC ablation.

One assembled, persisted frame feeds all models; each model is fitted on
the train split and predicts every split once. The output is the long
``predictions`` table the evaluation operators aggregate.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figura.operators.evaluate import class_weight
from figura.operators.features import FEATURE_SETS
from figura.session import staged


def default_classifier():
    """Gradient-boosted trees: 100 rounds of depth-3 trees, step 0.1."""
    return GBTClassifier(maxDepth=3, maxIter=100, stepSize=0.1, seed=0)


def fit_predict(df: DataFrame, parts: list[str], model_name: str, classifier=None,
                id_col: str = "id", y: str = "y", split: str = "split") -> DataFrame:
    """Fit one class-weighted model on ``split == 'train'`` rows using the
    concatenation of ``parts``; predict all rows. Returns long predictions
    ``(id, model, split, genre, y, pred, n_features)``."""
    clf = (classifier or default_classifier()).copy()
    data = (df.withColumn("_x", array_to_vector(F.concat(*[F.col(p) for p in parts])))
            .withColumn("n_features", F.size(F.concat(*[F.col(p) for p in parts]))))
    train = data.where(F.col(split) == "train")
    cw = class_weight(train, y).first()   # one row of scalars
    if not cw["n_pos"] and not cw["n_neg"]:
        raise ValueError(f"model {model_name}: the train split is empty")
    w = cw["pos_weight"]
    train = train.withColumn("_w", F.when(F.col(y) == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
    clf.setFeaturesCol("_x").setLabelCol("_label").setWeightCol("_w") \
        .setPredictionCol("_pred").setProbabilityCol("_prob").setRawPredictionCol("_raw")
    model = clf.fit(train.withColumn("_label", F.col(y).cast("double")))
    scored = model.transform(data.where(F.col(split) != "train"))
    return scored.select(id_col, F.lit(model_name).alias("model"), split, "genre", y,
                         F.col("_pred").cast("int").alias("pred"), "n_features")


#: Rows that one task of the training frame has at least, if there are as many.
MIN_ROWS = 10_000


def sized_for_training(df: DataFrame, feature_sets: dict[str, list[str]],
                       target_bytes: int = 128 << 20) -> DataFrame:
    """Persist the training frame in partitions of at most about
    ``target_bytes`` of feature data (rows x widest feature vector x 8 bytes).

    Boosting runs several jobs per round over this frame, so its partition
    count is chosen from its size rather than inherited from the shuffle
    setting (AQE does not coalesce the partitions of a cached plan): as many
    as there are cores if there are ``MIN_ROWS`` rows for each, and beyond
    that a multiple of the cores, so that no round waits for a last few."""
    import math
    parts = sorted({p for ps in feature_sets.values() for p in ps})
    probe = df.select(F.count(F.lit(1)).alias("n"),
                      F.max(F.size(F.concat(*[F.col(p) for p in parts]))).alias("w")).first()
    n, w = int(probe["n"] or 0), int(probe["w"] or 0)
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, math.ceil(n * max(w, 1) * 8 / target_bytes), min(cores, n // MIN_ROWS))
    if n_parts > cores:
        n_parts = math.ceil(n_parts / cores) * cores
    out = df.repartition(n_parts).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def ablation(df: DataFrame, feature_sets: dict[str, list[str]] | None = None,
             classifier=None, concurrent: bool = True) -> DataFrame:
    """Run every feature set on one persisted frame; union the predictions.

    The models are independent, so by default they are fitted concurrently
    from driver threads: boosting runs one small job per round, and
    overlapping the three models keeps the executors busy instead of
    waiting on per-round job latency."""
    from concurrent.futures import ThreadPoolExecutor

    feature_sets = feature_sets or FEATURE_SETS
    # only what models read moves: examples can carry whole texts
    parts = dict.fromkeys(p for ps in feature_sets.values() for p in ps)
    cached = sized_for_training(df.select("id", "split", "genre", "y", *parts), feature_sets)

    def run(item):
        name, parts = item
        return staged(fit_predict(cached, parts, name, classifier), "predictions")    # computed once

    items = list(feature_sets.items())
    if concurrent and len(items) > 1:
        with ThreadPoolExecutor(max_workers=len(items)) as pool:
            parts = list(pool.map(run, items))
    else:
        parts = [run(i) for i in items]
    cached.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
