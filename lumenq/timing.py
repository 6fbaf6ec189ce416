"""Timing of queries: run to a sink that drops rows, and keep the figures as CSV."""

from __future__ import annotations

import csv
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def drained(df: DataFrame) -> float:
    """Seconds to compute every row and column of ``df``."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def benchmark(named: dict[str, Callable[[], DataFrame]], timings: str | None = None, runs: int = 1) -> dict[str, float]:
    """Best seconds of each query, planning included; appended to the file ``timings`` if given."""
    out = {}
    for name, make in named.items():
        best = float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            drained(make())
            best = min(best, time.perf_counter() - began)
        out[name] = best
    if timings:
        new = not os.path.exists(timings)
        with open(timings, "a", newline="") as f:
            writer = csv.writer(f)
            if new:
                writer.writerow(["query", "seconds"])
            writer.writerows((n, f"{s:.6f}") for n, s in out.items())
    return out
