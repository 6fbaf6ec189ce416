"""Semantic distance and other vector functions, as column expressions and as SQL functions.

All are higher-order expressions inside Spark's JVM: no Python runs for a distance.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Distances are whole numbers: similarity times SCALE, cut toward zero.
SCALE = 1000


def vec_dot(x: Column | str, y: Column | str) -> Column:
    """Dot product."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def vec_norm2(x: Column | str) -> Column:
    """Squared Euclidean norm, the order of vectors."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def sem_dist(x: Column | str, y: Column | str) -> Column:
    """Semantic distance: -SCALE times the dot product, cut toward zero; smaller is more alike."""
    return (-vec_dot(x, y) * SCALE).cast("long")


def sem_cos_value(x: Column | str, y: Column | str) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    norm = F.sqrt(vec_norm2(x)) * F.sqrt(vec_norm2(y))
    return F.when(norm > 0, vec_dot(x, y) / norm).otherwise(0.0)


def sem_cos(x: Column | str, y: Column | str) -> Column:
    """Cosine similarity cut to a whole number, so 0 but for parallel vectors."""
    return sem_cos_value(x, y).cast("long")


def vec_mse(x: Column | str, y: Column | str) -> Column:
    """Mean squared difference."""
    d = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(x)


_DOT = "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, z) -> s + z)"
_NORM = "sqrt(aggregate({0}, 0D, (s, z) -> s + z * z))"
_COS = f"if({_NORM.format('x')} * {_NORM.format('y')} > 0D, {_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}), 0D)"
SQL_FUNCTIONS = {
    "vec_dot": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", _DOT),
    "vec_norm2": ("x ARRAY<DOUBLE>", "DOUBLE", "aggregate(x, 0D, (s, z) -> s + z * z)"),
    "sem_dist": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "BIGINT", f"cast(-{_DOT} * {SCALE} AS BIGINT)"),
    "sem_cos": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "BIGINT", f"cast({_COS} AS BIGINT)"),
    "sem_cos_value": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", _COS),
}


def register(spark: SparkSession, functions: dict[str, tuple[str, str, str]] = SQL_FUNCTIONS) -> None:
    """Create temporary SQL functions, which the optimizer inlines."""
    for name, (parameters, kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
