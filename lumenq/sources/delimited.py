"""Delimited text without quoting, and strict CSV."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import TableSchema


def _typed(field: Column, kind: str) -> Column:
    if kind == "int":
        return field.cast("double").cast("long")  # "3.7" is 3
    if kind == "embvec":
        return F.transform(F.split(F.regexp_replace(field, r"[\[\]]", ""), r"[ ;]+"), lambda x: x.cast("double"))
    return field


def read_delimited(
    spark: SparkSession, path: str, schema: TableSchema, sep: str = ",", header: bool = True, trailing_sep: bool = False
) -> DataFrame:
    """Lines of ``path`` as rows of ``schema``.

    A line is split into as many fields as there are columns, so the last column keeps further separators;
    nothing is quoted. Numbers may be written with decimals and are cut. With ``trailing_sep`` each line
    ends with a separator that is dropped. A line with too few fields, or a field that isn't a number,
    raises while it is read.
    """
    # One column up to the end of the line: Spark drops the header of each file, and nothing is quoted.
    lines = spark.read.csv(path, schema="value string", sep="\u0001", quote="", header=header)
    if trailing_sep:
        lines = lines.select(F.expr(f"substring(value, 1, length(value) - {len(sep)})").alias("value"))
    n = len(schema.columns)
    parts = lines.select(F.split("value", re.escape(sep), n).alias("f"), "value")
    short = F.raise_error(F.concat(F.lit(f"a line has fewer than {n} fields: "), F.col("value")))
    parts = parts.select(F.when(F.size("f") == n, F.col("f")).otherwise(short.cast("array<string>")).alias("f"))
    return parts.select(*[_typed(F.col("f")[i], c.kind).alias(c.name) for i, c in enumerate(schema.columns)])


def read_csv(spark: SparkSession, path: str, schema: TableSchema, sep: str = ",", header: bool = True) -> DataFrame:
    """Standard CSV with quoting; malformed lines raise."""
    return spark.read.csv(path, schema=schema.input_schema(), sep=sep, header=header, mode="FAILFAST", multiLine=False)


def column_sum(spark: SparkSession, path: str, schema: TableSchema, column: str, sep: str = ",", header: bool = True) -> int:
    """The sum of a whole-number column of a delimited file; 0 without rows."""
    rows = read_delimited(spark, path, schema, sep, header)
    return rows.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]
