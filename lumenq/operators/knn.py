"""Exact nearest neighbours: distance expressions under Spark's fused sort and limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sem_dist


def vector_literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, ties: Sequence[str] = (), ascending: bool = True, alias: str = "dist") -> DataFrame:
    """The ``k`` rows most (or, descending, least) alike the query, with their distance.

    One scan; every task keeps its ``k`` best rows, and only those are merged.
    """
    dist = sem_dist(F.col(vector), vector_literal(query)).alias(alias)
    key = F.col(alias).asc() if ascending else F.col(alias).desc()
    return df.select("*", dist).orderBy(key, *ties).limit(k)


