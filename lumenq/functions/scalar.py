"""Scalar functions of the SQL surface: integer arithmetic, byte substrings, epochs and dates.

Each has a column form and a temporary SQL function of the same name.
"""

from __future__ import annotations

from weakref import WeakSet

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import vectors


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division, cut toward zero; division by zero raises."""
    a, b = a.cast("long"), b.cast("long")
    return ((a - a % b) / b).cast("long")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b


def sq(a: Column) -> Column:
    return a * a


def imin(a: Column, b: Column) -> Column:
    return F.least(a, b)


def imax(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def rand_int(seed: int | None = None) -> Column:
    """A whole number from 0 to 2^63 - 1."""
    return F.floor(F.rand(seed) * F.lit(float(2**63 - 1024))).cast("long")


def epoch() -> Column:
    """Now, in Unix seconds."""
    return F.unix_timestamp()


def getsubstr(s: Column, start: Column, n: Column) -> Column:
    """``n`` bytes from byte ``start`` (from 0), clipped at the end; empty if ``start`` is outside."""
    inside = (start >= 0) & (start <= F.octet_length(s))
    cut = F.substring(s.cast("binary"), (start + 1).cast("int"), n.cast("int"))
    return F.when(inside, cut.cast("string")).otherwise("")


#: A stamp without its weekday and repeated blanks, and its year if that has five digits or more.
_STAMP = "regexp_replace(substring(s, 5), ' +', ' ')"
_FAR = "try_cast(regexp_extract(s, ' [+]?([0-9]{5,9})$', 1) AS BIGINT)"

SQL_FUNCTIONS = {
    "sq": ("a BIGINT", "BIGINT", "a * a"),
    "imin": ("a BIGINT, b BIGINT", "BIGINT", "least(a, b)"),
    "imax": ("a BIGINT, b BIGINT", "BIGINT", "greatest(a, b)"),
    "rand_int": ("", "BIGINT", "cast(floor(rand() * 9223372036854774784D) AS BIGINT)"),
    "epoch": ("", "BIGINT", "unix_timestamp()"),
    "getsubstr": (
        "s STRING, start BIGINT, n BIGINT",
        "STRING",
        "CASE WHEN start < 0 OR start > octet_length(s) THEN '' ELSE cast(substring(cast(s AS BINARY), cast(start + 1 AS INT), cast(n AS INT)) AS STRING) END",
    ),
    "datestringtoepoch": (
        "s STRING", "BIGINT",
        r"CASE WHEN s RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z' THEN coalesce(unix_timestamp(try_to_timestamp(s, 'yyyy-MM-dd')), 0) ELSE 0 END",
    ),
    "datetimestringtoepoch": (
        "s STRING", "BIGINT",
        # Years of over four digits are parsed as one of 2000 to 2399, and the whole cycles of 400 years are added.
        f"coalesce(unix_timestamp(try_to_timestamp(if({_FAR} IS NULL, regexp_replace({_STAMP}, ' -([0-9]{{1,3}})$', ' -000$1'), "
        f"regexp_replace({_STAMP}, '[+]?[0-9]{{5,9}}$', cast({_FAR} % 400 + 2000 AS STRING))), 'MMM d HH:mm:ss zzz yyyy')) "
        f"+ coalesce({_FAR} div 400 - 5, 0) * 12622780800, 0)",
    ),
    "epochtodatetimestring": (
        "i BIGINT", "STRING",
        # Years as plain numbers, padded within 0 to 9999; ``yyyy`` would put a plus before later ones.
        "concat(date_format(timestamp_seconds(i), 'EEE MMM '), lpad(day(timestamp_seconds(i)), 2, ' '), date_format(timestamp_seconds(i), ' HH:mm:ss zzz '), "
        "if(year(timestamp_seconds(i)) BETWEEN 0 AND 9999, lpad(year(timestamp_seconds(i)), 4, '0'), cast(year(timestamp_seconds(i)) AS STRING)))",
    ),
}

#: Names that Spark has itself with the same meaning.
BUILT_IN = ("mod", "count", "sum", "avg", "min", "max")


_REGISTERED: WeakSet[SparkSession] = WeakSet()


def register(spark: SparkSession) -> None:
    """Create the engine's SQL functions, once for each Spark session."""
    if spark not in _REGISTERED:
        vectors.register(spark, SQL_FUNCTIONS)
        vectors.register(spark)
        _REGISTERED.add(spark)


def date_string_to_epoch(s: Column) -> Column:
    """``YYYY-MM-DD`` in the session's zone to Unix seconds; 0 for anything else."""
    good = s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(good, F.coalesce(F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))), F.lit(0))).otherwise(0)


def function_list() -> list[str]:
    """Names and signatures, for the shell."""
    every = SQL_FUNCTIONS | vectors.SQL_FUNCTIONS
    return sorted(f"{name}({parameters}) {kind}" for name, (parameters, kind, _) in every.items())
