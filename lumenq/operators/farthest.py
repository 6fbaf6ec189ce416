"""The largest semantic distance of each vector to the vectors of its group, without a row for a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import SCALE
from ..sources.scratch import scratch

#: Different vectors of a group that are compared with as many others at once, and rows of one product.
BLOCK, ROWS = 4096, 256


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` and ``y``, added in the order of ``vec_dot``, so that none differs by its rounding."""
    dot = np.zeros(len(x))
    for k in range(x.shape[1]):
        dot += x[:, k] * y[:, k]
    return np.trunc(-dot * SCALE)


def farthest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest distance of each row of ``x`` to rows of ``y``, and of each row of ``y`` to rows of ``x``.

    A matrix product gives every dot product to within a known bound; only pairs that the bound leaves open are
    added up one by one.
    """
    # Either sum is off by at most dim * 2^-53 of the sum of absolute products, which the norms bound; twice that for slack.
    unit = 4.0 * (x.shape[1] + 2) * 2.0**-53
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    slack_x, slack_y = unit * norm_x * norm_y.max() + 1e-300, unit * norm_y * norm_x.max() + 1e-300
    low_x, at_x = np.empty(len(x)), np.empty(len(x), np.int64)
    low_y, at_y = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
    for s in range(0, len(x), ROWS):
        near = x[s : s + ROWS] @ y.T
        if not np.abs(near).max() * SCALE < 2.0**63:
            raise OverflowError("a semantic distance is no 64-bit number")
        at_x[s : s + ROWS] = near.argmin(axis=1)
        low_x[s : s + ROWS] = near.min(axis=1)
        at, low = near.argmin(axis=0), near.min(axis=0)
        less = low < low_y
        low_y[less], at_y[less] = low[less], at[less] + s
    return _settled(x, y, low_x, at_x, slack_x), _settled(y, x, low_y, at_y, slack_y)


def _settled(x: np.ndarray, y: np.ndarray, low: np.ndarray, at: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Exact largest distances from near least dot products: rows whose first candidate reaches the bound are done."""
    best, bound = _exact(x, y[at]), np.trunc((slack - low) * SCALE)
    for k in np.flatnonzero(best < bound).tolist():
        others = np.flatnonzero(y @ x[k] <= low[k] + 2 * slack[k])
        best[k] = max(best[k], _exact(np.broadcast_to(x[k], (len(others), x.shape[1])), y[others]).max(initial=best[k]))
    return best


#: Of one comparison: the group, the vectors' length and the two blocks.
UNIT = ["g", "size", "lo", "hi"]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, far) of each comparison; the input is sorted by unit, so two blocks are held at most."""
    held: list[pa.RecordBatch] = []
    now: tuple[int, ...] = ()

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys, block = t.column("key").to_numpy(), t.column("block").to_numpy()
        _, size, lo, hi = now
        x = t.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(t), size)
        if lo == hi:
            far = farthest(x, x)[0]
        elif (block == lo).any() and (block == hi).any():
            a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            keys, far = keys[np.append(a, b)], np.concatenate(farthest(x[a], x[b]))
        else:
            keys, far = keys[:0], np.empty(0)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(far.astype(np.int64))], ["key", "far"])

    for batch in batches:
        units = np.stack([batch.column(c).to_numpy() for c in UNIT])
        cuts = (np.flatnonzero((units[:, 1:] != units[:, :-1]).any(axis=0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            this = tuple(units[:, a].tolist())
            if this != now and held:
                yield close()
                held.clear()
            now = this
            held.append(batch.slice(a, b - a))
    if held:
        yield close()


def farthest_in_group(df: DataFrame, group: str, vector: str, alias: str = "far", block: int = BLOCK) -> DataFrame:
    """``df`` without rows of a null group, with the largest distance of each vector to those of its group, itself included.

    ``group`` is a column of whole numbers. Equal vectors of a group are one; the different ones are dealt to blocks,
    and each pair of blocks is one comparison. A vector is compared with those of its length; the distance of a null
    vector, or of one with a null in it, is null. Distances beyond 64 bits raise.
    """
    spark = df.sparkSession
    good = F.col("g").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    different = df.select(F.col(group).cast("long").alias("g"), F.col(vector).alias("vector")).where(good).distinct()
    # Written once, as the keys must stay.
    path = scratch(spark) + "/different"
    different.select("g", "vector", F.size("vector").cast("long").alias("size"), F.monotonically_increasing_id().alias("key")).write.parquet(path)
    items = spark.read.parquet(path)
    blocks = items.groupBy("g", "size").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = items.join(blocks, ["g", "size"]).withColumn("block", F.pmod(F.xxhash64("vector"), "blocks"))
    other = dealt.select("g", "size", "vector", "key", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    units = other.select("g", "size", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "vector")
    # By number, as comparisons cost more than their bytes tell and small partitions should not be merged.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = units.repartition(tasks, *UNIT).sortWithinPartitions(*UNIT)
    far = ordered.mapInArrow(_compared, "key long, far long").groupBy("key").agg(F.max("far").alias("__far"))
    found = items.join(far, "key").select(F.col("g").alias("__g"), F.col("vector").alias("__vector"), "__far")
    same = (F.col(group).cast("long") == F.col("__g")) & (F.col(vector) == F.col("__vector"))
    rows = df.where(F.col(group).isNotNull()).join(found, same, "left")
    return rows.select(*(df[c] for c in df.columns if c != alias), F.col("__far").alias(alias))
