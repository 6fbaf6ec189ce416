"""k-means with assignment by dot product, as Arrow partial sums.

One pass reads the vectors once. Tasks send one partial sum for each cluster they met; the sums are added
by cluster on the executors, and only the ``k`` centroids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS = 10


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dim)


def nearest(vectors: np.ndarray, centroids: np.ndarray, metric: str = "dot") -> np.ndarray:
    """The best centroid of each row; ties go to the lowest number."""
    score = vectors @ centroids.T
    if metric == "euclidean":
        score = 2 * score - (centroids**2).sum(axis=1)
    return score.argmax(axis=1)


@dataclass
class KMeansModel:
    centroids: np.ndarray
    iterations: int
    metric: str = "dot"

    def assign(self, column: Column | str) -> Column:
        """The cluster of each vector, a column."""
        centroids, metric = self.centroids, self.metric

        @F.pandas_udf("int")
        def cluster(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            return pd.Series(nearest(np.stack(vectors).astype(float), centroids, metric).astype(np.int32), index=vectors.index)

        return cluster(column)


def seeds(df: DataFrame, vector: str, order: str, k: int) -> np.ndarray:
    """The vectors of the first ``k`` rows by ``order``."""
    rows = df.orderBy(order).select(vector).limit(k).collect()
    return np.array([r[0] for r in rows], dtype=float)


def fit_kmeans(
    df: DataFrame, vector: str, k: int, order: str, iterations: int = MAX_ITERATIONS, metric: str = "dot", tol: float | None = None
) -> KMeansModel:
    """k centroids, from the first ``k`` rows by ``order``; an empty cluster keeps its centroid.

    The centroids, ``k`` vectors, are what is sent to every task; they don't grow with the rows.
    """
    if metric not in ("dot", "euclidean"):
        raise ValueError("metric is dot or euclidean")
    rows = df.select(vector).where(F.col(vector).isNotNull())
    centroids = seeds(df.where(F.col(vector).isNotNull()), vector, order, k)
    done = 0
    if not len(centroids):
        return KMeansModel(centroids.reshape(0, 0), 0, metric)
    for _ in range(iterations):
        sums = _pass(rows, centroids, metric)
        moved = 0.0
        new = centroids.copy()
        for cid, total, n in sums:
            new[cid] = np.array(total) / n
        moved = float(np.abs(new - centroids).max())
        centroids = new
        done += 1
        if tol is not None and moved <= tol:
            break
    return KMeansModel(centroids, done, metric)


def _pass(rows: DataFrame, centroids: np.ndarray, metric: str) -> list[tuple[int, list[float], int]]:
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dim)
            c = nearest(x, shared.value, metric)
            np.add.at(total, c, x)
            count += np.bincount(c, minlength=k)
        met = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * dim), pa.array(total[met].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), lists, pa.array(count[met])], ["cid", "total", "n"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cid": frame["cid"].iloc[:1], "total": [np.sum(np.stack(frame["total"]), axis=0)], "n": [frame["n"].sum()]})

    parts = rows.mapInArrow(partial, "cid int, total array<double>, n long")
    found = parts.groupBy("cid").applyInPandas(added, "cid int, total array<double>, n long").collect()
    shared.unpersist()
    return [(r.cid, r.total, r.n) for r in found]


def cluster_report(assigned: DataFrame, cid: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(cid, n, total): members of each cluster and their summed negative dot product to its centroid."""
    from ..functions.vectors import vec_dot

    c = centroids.select(F.col("cid").alias("__cid"), F.col("vector").alias("__centroid"))
    joined = assigned.join(c, F.col(cid) == F.col("__cid"))
    return joined.groupBy(F.col(cid).alias("cid")).agg(F.count("*").alias("n"), F.sum(-vec_dot(vector, "__centroid")).alias("total"))
