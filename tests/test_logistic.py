"""The Newton classifier: optimum, weights, degenerate input, plugged into the
ablation."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from figura.operators.logistic import NewtonLogistic
from figura.operators.train import ablation, fit_predict


def frame(spark, x, y, w=None, parts=3):
    w = np.ones(len(y)) if w is None else w
    rows = [(i, [float(v) for v in a], float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double, w double").repartition(parts).withColumn("features", array_to_vector("x"))


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.5, -2.0, 0.0] + .3)))).astype(float)
    return x, y


def gradient(x, y, w, beta, reg):
    x = np.hstack([x, np.ones((len(x), 1))])
    return x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) + reg * np.r_[beta[:-1], 0]


@pytest.mark.parametrize("reg", [0.1, 5.0])
def test_optimum_of_weighted_loss(spark, reg):
    x, y = data()
    w = np.where(y == 1, 2.5, 1.0)
    model = NewtonLogistic(regParam=reg).setWeightCol("w").fit(frame(spark, x, y, w))
    assert np.abs(gradient(x, y, w, model.coefficients, reg)).max() < 1e-6
    again = NewtonLogistic(regParam=reg).setWeightCol("w").fit(frame(spark, x, y, w, parts=7))
    assert np.abs(again.coefficients - model.coefficients).max() < 1e-9


def test_separable_rows_converge(spark):
    x = np.array([[-1000.0], [-1.0], [1.0], [1000.0]])
    model = NewtonLogistic(regParam=0.01).fit(frame(spark, x, np.array([0, 0, 1, 1.0])))
    assert np.isfinite(model.coefficients).all() and model.coefficients[0] > 0


def test_transform(spark):
    x, y = data(50)
    df = frame(spark, x, y)
    model = NewtonLogistic().fit(df)
    z = np.hstack([x, np.ones((50, 1))]) @ model.coefficients
    got = {r.id: r for r in model.transform(df).collect()}
    for i in range(50):
        assert abs(got[i].rawPrediction[1] - z[i]) < 1e-9 and abs(got[i].probability[1] - 1 / (1 + np.exp(-z[i]))) < 1e-9
        assert got[i].prediction == float(z[i] >= 0)


def test_one_class_and_no_rows(spark):
    x = np.eye(3)
    for label in (0.0, 1.0):
        got = NewtonLogistic().setWeightCol("w").fit(frame(spark, x, np.full(3, label), np.zeros(3))).transform(frame(spark, x, np.zeros(3)))
        assert {r.prediction for r in got.collect()} == {label}
        assert {r.probability[1] for r in got.collect()} == {label}
    with pytest.raises(ValueError):
        NewtonLogistic().fit(frame(spark, x, np.zeros(3)).where("id < 0"))


def test_plugs_into_the_ablation(spark):
    x, y = data(300, 3)
    split = ["train"] * 200 + ["dev"] * 50 + ["test"] * 50
    rows = [(i, int(y[i]), "g", split[i], [float(x[i][0])], [float(x[i][1]), float(x[i][2])]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, genre string, split string, a array<double>, b array<double>")
    got = ablation(df, {"one": ["a"], "two": ["a", "b"]}, NewtonLogistic()).groupBy("model", "split").agg(
        F.count("*").alias("n"), F.max("n_features").alias("w"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc")).collect()
    assert {(r.model, r.split): (r.n, r.w) for r in got} == {("one", "dev"): (50, 1), ("one", "test"): (50, 1), ("two", "dev"): (50, 3), ("two", "test"): (50, 3)}
    assert all(r.acc > 0.7 for r in got if r.model == "two")
    alone = fit_predict(df.where("split <> 'train' OR y = 1"), ["a"], "m", NewtonLogistic())
    assert {r.pred for r in alone.collect()} == {1}
    with pytest.raises(ValueError):
        fit_predict(df.where("split <> 'train'"), ["a"], "m", NewtonLogistic())
