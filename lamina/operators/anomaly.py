"""Anomaly scores of vectors, fitted on TRAIN rows only: distance to a memory of normal vectors, and the
Mahalanobis distance to their mean. Published maths on vectors that are given; no pixels, no networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The memory is at most so many vectors: a documented bound, so that it can be broadcast.
MEMORY = 4_096


def _train(manifest: DataFrame, vector: str) -> DataFrame:
    rows = manifest.where("split = 'train' AND label = 'normal'").select("path", vector)
    if rows.isEmpty():
        raise ValueError("TRAIN has no normal rows")
    return rows


class NearestMemory:
    """Distance to the nearest vector of a greedy k-center subset (a coreset) of normal TRAIN vectors."""

    def __init__(self, memory: np.ndarray, vector: str) -> None:
        self.memory, self.vector = memory, vector

    @classmethod
    def fit(cls, manifest: DataFrame, vector: str = "vector", ratio: float = 0.1, most: int = MEMORY) -> NearestMemory:
        """The pool from which the coreset is chosen is a hash sample of at most 8 * most rows."""
        rows = _train(manifest, vector).orderBy(F.xxhash64("path"), "path").limit(8 * most).toPandas()
        x = np.array(rows[vector].tolist(), np.float64)
        size = min(most, max(1, round(len(x) * ratio)))
        chosen, distance = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < size:
            k = int(distance.argmax())
            chosen.append(k)
            distance = np.minimum(distance, np.linalg.norm(x - x[k], axis=1))
        return cls(x[chosen], vector)

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows with score."""
        memory = rows.sparkSession.sparkContext.broadcast(self.memory)  # at most MEMORY rows

        @F.pandas_udf("double")
        def score(vectors):
            import pandas as pd

            x, m = np.array(vectors.tolist(), np.float64), memory.value
            out = [np.sqrt(np.maximum(0, (p * p).sum(1)[:, None] + (m * m).sum(1) - 2 * p @ m.T).min(1)) for p in np.array_split(x, max(1, len(x) // 512))]
            return pd.Series(np.concatenate(out))

        return rows.withColumn("score", score(self.vector))

    def saved(self, spark) -> DataFrame:
        """The model as a table."""
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.memory)], "i long, vector array<double>")


class Mahalanobis:
    """Distance to the mean of normal TRAIN vectors under their (regularised) covariance. The moments are one
    aggregation: partial sums of each task, dimension squared numbers each."""

    def __init__(self, mean: np.ndarray, precision: np.ndarray, vector: str) -> None:
        self.mean, self.precision, self.vector = mean, precision, vector

    @classmethod
    def fit(cls, manifest: DataFrame, vector: str = "vector", ridge: float = 0.01) -> Mahalanobis:
        rows = _train(manifest, vector).select(vector)

        def moments(frames):
            import pandas as pd

            n, s, ss = 0, 0.0, 0.0
            for f in frames:
                if len(f):
                    x = np.array(f[vector].tolist(), np.float64)
                    n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
            if n:
                yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.reshape(-1).tolist()]})

        def merge(parts):
            n = parts["n"].sum()
            s, ss = (np.sum(np.array(parts[c].tolist()), axis=0) for c in ("s", "ss"))
            parts = parts.iloc[:1].copy()
            parts["n"], parts["s"], parts["ss"] = n, [s.tolist()], [ss.tolist()]
            return parts

        kind = "n long, s array<double>, ss array<double>"
        got = rows.mapInPandas(moments, kind).groupBy().applyInPandas(merge, kind).first()  # a row a task
        n, s = got["n"], np.array(got["s"])
        mean = s / n
        cov = (np.array(got["ss"]).reshape(len(s), len(s)) - n * np.outer(mean, mean)) / max(1, n - 1) + ridge * np.eye(len(s))
        return cls(mean, np.linalg.inv(cov), vector)

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows with score."""
        mean, precision = self.mean, self.precision

        @F.pandas_udf("double")
        def score(vectors):
            import pandas as pd

            d = np.array(vectors.tolist(), np.float64) - mean
            return pd.Series(np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", d, precision, d))))

        return rows.withColumn("score", score(self.vector))

    def saved(self, spark) -> DataFrame:
        """The model as a table."""
        return spark.createDataFrame([(self.mean.tolist(), self.precision.reshape(-1).tolist())], "mean array<double>, precision array<double>")
