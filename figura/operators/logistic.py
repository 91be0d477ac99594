"""Logistic classification by Newton steps, as a ``pyspark.ml`` estimator.

A step needs the Gram matrix ``X' W X`` and the gradient only. Each task sums
its rows' products into one small matrix, Spark adds these up entry by entry,
and the driver solves for the step: what moves is ``width^2`` numbers a task,
whatever the number of rows. Meant for widths up to a few thousand.

The optimum is unique (ridge penalty), so the result depends neither on the
partitioning nor on a seed, and SQL can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, HasRegParam, HasTol, HasWeightCol)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Columns(HasFeaturesCol, HasLabelCol, HasWeightCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    """The column parameters, with the setters of ``pyspark.ml`` classifiers."""

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setWeightCol(self, value):
        return self._set(weightCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)

    def setProbabilityCol(self, value):
        return self._set(probabilityCol=value)

    def setRawPredictionCol(self, value):
        return self._set(rawPredictionCol=value)


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, Gram matrix) of all rows (x, y, w) at ``beta``."""
    width = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, gram = 0.0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ones((b.num_rows, width))
            x[:, :-1] = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width - 1)
            y, w = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            z = x @ beta
            p = 0.5 * (1 + np.tanh(z / 2))
            loss += float(w @ (np.logaddexp(0, z) - y * z))
            grad += x.T @ (w * (p - y))
            gram += x.T @ (x * (w * p * (1 - p))[:, None])
        out = np.concatenate([[loss], grad, gram.ravel()])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(out)), "v": out})

    got = rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(1 + width + width * width)
    for r in got.collect():          # 1 + width + width^2 numbers
        out[r["at"]] = r["v"]
    return out[0], out[1:width + 1], out[width + 1:].reshape(width, width)


class NewtonLogistic(Estimator, _Columns, HasMaxIter, HasTol, HasRegParam):
    """Weighted logistic regression with penalty ``regParam / 2 * |beta|^2``
    on all coefficients but the intercept.

    Steps that would raise the loss are halved. Rows of one class only (by
    count) give a model that always answers this class; no rows are an error.
    """

    def __init__(self, maxIter: int = 25, tol: float = 1e-10, regParam: float = 1.0):
        super().__init__()
        self._set(maxIter=maxIter, tol=tol, regParam=regParam)

    def _fit(self, dataset: DataFrame) -> NewtonLogisticModel:
        label = F.col(self.getLabelCol()).cast("double")
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), label.alias("y"), weight.alias("w"))
        seen = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 1), F.max(F.size("x"))).first()
        if not seen[0]:
            raise ValueError("no rows to fit on")
        width = int(seen[2]) + 1
        beta = np.zeros(width)
        if seen[1] in (0, seen[0]):
            beta[-1] = np.inf if seen[1] else -np.inf
            return self._copyValues(NewtonLogisticModel(beta, 0))
        pull = np.full(width, float(self.getRegParam()))
        pull[-1] = 0.0

        def at(b):
            loss, grad, gram = _sums(rows, b)
            return loss + float(pull @ (b * b)) / 2, grad + pull * b, gram + np.diag(pull)
        loss, grad, gram = at(beta)
        steps = 0
        for steps in range(1, self.getMaxIter() + 1):      # noqa: B007
            step = np.linalg.lstsq(gram, grad, rcond=None)[0]
            if np.abs(step).max() <= self.getTol():
                break
            while True:
                new = at(beta - step)
                if new[0] <= loss + 1e-12 * abs(loss) or np.abs(step).max() <= self.getTol():
                    break
                step = step / 2
            beta = beta - step
            loss, grad, gram = new
        return self._copyValues(NewtonLogisticModel(beta, steps))


class NewtonLogisticModel(Model, _Columns):
    """``coefficients`` (intercept last) and the number of steps taken."""

    def __init__(self, coefficients: np.ndarray, steps: int):
        super().__init__()
        self.coefficients, self.steps = coefficients, steps

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bias = float(self.coefficients[-1])
        terms = F.zip_with(vector_to_array(self.getFeaturesCol()), F.lit([float(c) for c in self.coefficients[:-1]]), lambda x, c: x * c)
        z = F.lit(bias) if np.isinf(bias) else F.aggregate(terms, F.lit(bias), lambda a, t: a + t)
        p = 1 / (1 + F.exp(-z))
        return (dataset.withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-z, z)))
                .withColumn(self.getProbabilityCol(), array_to_vector(F.array(1 - p, p)))
                .withColumn(self.getPredictionCol(), (z >= 0).cast("double")))
