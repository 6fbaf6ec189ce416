"""Inverted-file index: vectors filed by their nearest centroid, and queries that open only a few files.

Postings are Parquet partitioned by ``_cid``, so a probe is partition pruning. A *secondary* index keeps
(row identifier, vector) beside the table; a *clustered* one is the table itself, laid out by ``_cid``.
Candidates are ranked by exact distance: an index changes recall, never a distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import sem_dist
from ..types import CID
from .kmeans import KMeansModel, fit_kmeans
from .knn import vector_literal

#: Files opened beyond those that would hold the limit if rows were spread evenly.
EXTRA_PROBES = 3


def probe_count(limit: int, rows: int, k: int) -> int:
    """How many clusters a query for ``limit`` rows opens at least."""
    return limit // max(1, rows // max(1, k)) + EXTRA_PROBES


def write_centroids(spark: SparkSession, model: KMeansModel, path: str) -> None:
    """Store (cid, vector); ``k`` rows."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(model.centroids)]
    spark.createDataFrame(rows, "cid int, vector array<double>").coalesce(1).write.parquet(path)


def read_model(spark: SparkSession, path: str) -> KMeansModel:
    rows = spark.read.parquet(path).orderBy("cid").collect()
    return KMeansModel(np.array([r["vector"] for r in rows], dtype=float), 0)


def file_rows(rows: DataFrame, model: KMeansModel, vector: str) -> DataFrame:
    """``rows`` with their ``_cid``, dealt so that each cluster is written as few, evenly sized files."""
    return rows.withColumn(CID, model.assign(vector)).hint("rebalance", CID)


def probes(centroids: DataFrame, query: Sequence[float], p: int, ascending: bool = True) -> list[int]:
    """The ``p`` clusters nearest to (or farthest from) the query; ties go to the lowest number."""
    dist = sem_dist(F.col("vector"), vector_literal(query))
    order = dist.asc() if ascending else dist.desc()
    return [r[0] for r in centroids.orderBy(order, "cid").select("cid").limit(p).collect()]


@dataclass
class IvfIndex:
    """A built index. ``base`` is the indexed table for a secondary index, or None for a clustered one."""

    spark: SparkSession
    kind: str
    vector: str
    key: str
    k: int
    rows: int
    centroids: DataFrame
    postings: DataFrame
    base: DataFrame | None = None
    opened: list[int] = field(default_factory=list)
    sizes: dict[int, int] | None = None

    @classmethod
    def build(
        cls, df: DataFrame, path: str, vector: str, key: str, k: int, kind: str = "secondary", iterations: int = 10, metric: str = "dot"
    ) -> IvfIndex:
        """Cluster ``df`` and write the index below ``path``. ``key`` is unique and orders the seeds."""
        if kind not in ("secondary", "clustered"):
            raise ValueError("kind is secondary or clustered")
        spark = df.sparkSession
        model = fit_kmeans(df, vector, k, key, iterations, metric)
        write_centroids(spark, model, f"{path}/centroids")
        kept = df if kind == "clustered" else df.select(key, vector)
        file_rows(kept, model, vector).write.partitionBy(CID).parquet(f"{path}/data")
        centroids, postings = spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/data")
        return cls(spark, kind, vector, key, len(model.centroids), postings.count(), centroids, postings, df if kind == "secondary" else None)

    def _open(self, query: Sequence[float], limit: int, ascending: bool, probe: int | None) -> list[int]:
        """The clusters to open: ``probe`` of them, or by default as many as there are likely rows for, and more
        until they hold ``limit`` rows or none is left. At most ``k`` numbers come to the driver."""
        if probe is not None:
            self.opened = probes(self.centroids, query, probe, ascending)
            return self.opened
        if self.sizes is None:
            self.sizes = {r[0]: r[1] for r in self.postings.groupBy(CID).count().collect()}
        order = probes(self.centroids, query, self.k, ascending)
        p = min(probe_count(limit, self.rows, self.k), len(order))
        while p < len(order) and sum(self.sizes.get(c, 0) for c in order[:p]) < limit:
            p += 1
        self.opened = order[:p]
        return self.opened

    def candidates(self, query: Sequence[float], limit: int, ascending: bool = True, probe: int | None = None) -> DataFrame:
        """The rows of the opened clusters, with all columns of the indexed table."""
        found = self.postings.where(F.col(CID).isin(self._open(query, limit, ascending, probe)))
        if self.kind == "clustered":
            return found.drop(CID)
        return self.base.join(found.select(self.key), self.key, "left_semi")

    def search(self, query: Sequence[float], limit: int, ascending: bool = True, probe: int | None = None, alias: str = "dist") -> DataFrame:
        """The ``limit`` nearest candidates by exact distance, ties by key."""
        dist = sem_dist(F.col(self.vector), vector_literal(query)).alias(alias)
        order = F.col(alias).asc() if ascending else F.col(alias).desc()
        if self.kind == "secondary":
            # Rank on the postings, and fetch only the rows that are returned.
            best = self.postings.where(F.col(CID).isin(self._open(query, limit, ascending, probe))).select(self.key, dist).orderBy(order, self.key).limit(limit)
            return self.base.join(F.broadcast(best), self.key).orderBy(order, self.key).select(*self.base.columns, alias)
        return self.candidates(query, limit, ascending, probe).select("*", dist).orderBy(order, self.key).limit(limit)

    def mapping(self) -> DataFrame:
        """(centroidid, indexpageno): the files of each cluster."""
        files = self.postings.select(F.col(CID).alias("centroidid"), F.input_file_name().alias("file")).distinct()
        return files.select("centroidid", F.xxhash64("file").alias("indexpageno"))
