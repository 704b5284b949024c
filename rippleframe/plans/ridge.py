"""Ridge with its penalty chosen by leave-one-out error: two passes over the rows, whatever the number of penalties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The penalties tried: 40 from 1e-3 to 1e6, evenly in the logarithm.
PENALTIES = np.logspace(-3, 6, 40)


def _rows(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))


def _summed(df: DataFrame, numbers) -> np.ndarray:
    """Sums over all rows of the vector numbers(x, y) makes of a batch: one vector a batch, added up on the executors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in it:
            if len(b):
                v = numbers(np.vstack(b["x"].to_numpy()), b["y"].to_numpy())
                total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    got = df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # as many as the vector is long
    out = np.zeros(len(got))
    out[got["i"]] = got["v"]
    return out


class RidgeModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, coef: np.ndarray, intercept: float, penalty: float, errors: np.ndarray):
        self.mean, self.scale, self.coef, self.intercept, self.penalty, self.errors = mean, scale, coef, intercept, penalty, errors

    def transform(self, df: DataFrame) -> DataFrame:
        """df with prediction, a JVM expression over features (a vector)."""
        from pyspark.ml.functions import vector_to_array

        slope = self.coef / self.scale
        products = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(c)) for c in slope]), lambda x, c: x * c)
        return df.withColumn("prediction", F.aggregate(products, F.lit(float(self.intercept - self.mean @ slope)), lambda a, x: a + x))


class RidgeGrid:
    """fit() standardises on the rows it gets; constant columns get no weight; of equal errors the smallest penalty wins."""

    def __init__(self, penalties: np.ndarray = PENALTIES):
        self.penalties = np.asarray(penalties, float)

    def fit(self, train: DataFrame) -> RidgeModel:
        rows, penalties = _rows(train), self.penalties
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        p = len(first.x)
        shift, base = np.array(first.x), first.y  # sums of deviations from one row keep digits where means are large

        def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), x - shift, y - base])
            return (z.T @ z).ravel()

        m = _summed(rows, moments).reshape(p + 2, p + 2)
        n = m[0, 0]
        means = m[0] / n
        centred = m - n * np.outer(means, means)
        deviation = np.sqrt(np.maximum(np.diag(centred)[1:-1] / n, 0))
        flat = deviation <= 1e-12 * np.maximum(1, np.abs(means[1:-1]))
        scale = np.where(flat, 1.0, deviation)
        mean, y_mean = shift + means[1:-1], base + means[-1]
        gram = np.where(np.outer(~flat, ~flat), centred[1:-1, 1:-1] / np.outer(scale, scale), 0.0)
        cross = np.where(flat, 0.0, centred[1:-1, -1] / scale)
        values, vectors = np.linalg.eigh(gram)
        values, turned = np.maximum(values, 0), vectors.T @ cross

        def errors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            q = np.where(flat, 0.0, (x - mean) / scale) @ vectors
            inverse = 1 / (values[:, None] + penalties)
            left = (y - y_mean)[:, None] - q @ (turned[:, None] * inverse)
            held = 1 / n + (q * q) @ inverse  # a row's own weight in its prediction
            return ((left / np.maximum(1 - held, 1e-12)) ** 2).sum(axis=0)

        loo = _summed(rows, errors) / n
        best = float(penalties[int(np.argmin(loo))])
        return RidgeModel(mean, scale, vectors @ (turned / (values + best)), float(y_mean), best, loo)
