"""Aggregates that give zero values on empty input, and a truncating average."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum0(x: Column | str) -> Column:
    """Sum; 0 without rows."""
    return F.coalesce(F.sum(x), F.lit(0))


def avg_trunc(x: Column | str) -> Column:
    """Average of whole numbers cut toward zero; 0 without rows."""
    total, n = F.sum(x), F.count(x)
    return F.coalesce(F.when(n > 0, ((total - total % n) / n).cast("long")), F.lit(0))


def min0(x: Column | str, zero: int | str = 0) -> Column:
    """Minimum; ``zero`` (0 or '') without rows."""
    return F.coalesce(F.min(x), F.lit(zero))


def max0(x: Column | str, zero: int | str = 0) -> Column:
    """Maximum; ``zero`` (0 or '') without rows."""
    return F.coalesce(F.max(x), F.lit(zero))


def pattern_regex(pattern: str) -> str:
    """The regular expression of a LIKE pattern in which only ``%`` is special to LIKE: ``_`` stands for
    itself, and whatever a regular expression gives a meaning keeps it."""
    return "^" + pattern.replace("%", ".*?") + r"\z"


def like_pattern(x: Column | str, pattern: str) -> Column:
    """LIKE by ``pattern_regex``; false for a pattern that isn't a regular expression."""
    x = F.col(x) if isinstance(x, str) else x
    try:
        re.compile(pattern_regex(pattern).replace(r"\z", r"\Z"))
    except re.error:
        return F.lit(False)
    return x.rlike(pattern_regex(pattern))
