"""Sharding: minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group. Groups are ordered by a 63-bit hash of the text; groups
whose hashes agree count as one. Each shard gets a contiguous range of that order. The smallest shard
capacity for which a greedy pass needs no more than the given shards is found by binary search; then
the ranges are cut, each shard as near the mean of what is left as that capacity allows.

The driver never holds the groups. It holds *cells*, ranges of hashes with their sizes: 2^14 at first.
Whenever the search depends on what lies inside a cell of several groups, only such cells are counted
again in 2^8 parts, until all decisions rest on single groups. The result is that of a search over all
groups; the number of cells held follows the number of shards, not the data.

Defined cases: a null text counts as empty; repeated rows count each; a group larger than the mean
takes a shard of its own size; with fewer groups than shards some shards stay empty; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import shared_table

#: Hash bits, bits of the first cells, bits by which a cell is divided.
HASH_BITS, FIRST_BITS, STEP_BITS = 63, 14, 8
#: Rows of a slot-numbering chunk.
CHUNK_ROWS = 20_000


class _Cells:
    """Non-empty cells in order: first hash, level (hashes a cell covers are 2^level), size, groups."""

    def __init__(self, groups: DataFrame) -> None:
        self.groups = groups
        self.rows = self._count(HASH_BITS - FIRST_BITS, None)
        self._prepare()

    def _count(self, level: int, within: tuple[int, list[int]] | None) -> np.ndarray:
        rows = self.groups
        if within:
            rows = rows.where(F.shiftright("hash", within[0]).isin(within[1]))
        got = (
            rows.groupBy(F.shiftright("hash", level).alias("cell"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
            .toPandas()
        )
        out = np.empty((len(got), 4), np.int64)
        out[:, 0] = got["cell"].to_numpy(np.int64) << level
        out[:, 1] = level
        out[:, 2] = got["bytes"]
        out[:, 3] = got["n"]
        return out

    def _prepare(self) -> None:
        self.rows = self.rows[np.argsort(self.rows[:, 0])]
        self.edge = np.concatenate([[0], np.cumsum(self.rows[:, 2])])
        self.n = len(self.rows)

    def divide(self, cells: set[int]) -> None:
        old = self.rows[sorted(cells)]
        new = [np.delete(self.rows, sorted(cells), axis=0)]
        for level in np.unique(old[:, 1]):
            level = int(level)
            prefixes = [int(x) >> level for x in old[old[:, 1] == level, 0]]
            new.append(self._count(max(0, level - STEP_BITS), (level, prefixes)))
        self.rows = np.concatenate(new)
        self._prepare()

    def mixed(self, i: int) -> bool:
        return 0 <= i < self.n and self.rows[i, 3] > 1


def _forward(c: _Cells, start: int, capacity: int, seen: set[int] | None) -> int:
    """The last edge within ``capacity`` of edge ``start``; seen gets a mixed cell that didn't fit."""
    end = int(np.searchsorted(c.edge, c.edge[start] + capacity, side="right")) - 1
    if seen is not None and c.mixed(end):
        seen.add(end)
    return end


def _feasible(c: _Cells, shards: int, capacity: int, seen: set[int] | None = None) -> bool:
    at = 0
    for _ in range(shards):
        at = _forward(c, at, capacity, seen)
        if at == c.n:
            return True
    return False


def _search(c: _Cells, shards: int, seen: set[int]) -> tuple[int, list[int]]:
    """(capacity, cut edges) as far as the cells tell; seen: mixed cells on which they depend."""
    total = int(c.edge[-1])
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if _feasible(c, shards, middle):
            high = middle
        else:
            low = middle + 1
    _feasible(c, shards, low, seen)
    if low > -(-total // shards):
        _feasible(c, shards, low - 1, seen)
    back = [c.n]  # back[t]: the first edge from which t shards suffice
    for _ in range(shards):
        edge = int(np.searchsorted(c.edge, c.edge[back[-1]] - low, side="left"))
        if c.mixed(edge - 1):
            seen.add(edge - 1)
        back.append(edge)
    cuts, at = [], 0
    for j in range(1, shards):
        goal = c.edge[at] + (total - c.edge[at]) / (shards - j + 1)
        after = min(int(np.searchsorted(c.edge, goal, side="left")), c.n)
        edge = after if after == 0 or c.edge[after] - goal <= goal - c.edge[after - 1] else after - 1
        if c.mixed(after - 1):
            seen.add(after - 1)
        edge = min(max(edge, back[shards - j], at), _forward(c, at, low, None))
        cuts.append(edge)
        at = edge
    return low, cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, first hash of shards 1 to n-1) for groups (hash long, bytes long)."""
    c = _Cells(groups)
    if not c.n:
        return 0, [1 << 62] * (shards - 1)
    while True:
        seen: set[int] = set()
        capacity, cuts = _search(c, shards, seen)
        if not seen:
            return capacity, [int(c.rows[e, 0]) if e < c.n else (1 << HASH_BITS) - 1 for e in cuts]
        c.divide(seen)


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, capacity) for every row of ``docs``.

    One scan of the texts; all else works on a narrow written table of five numbers a row. Slots are counted
    in chunks of rows dealt by a hash of the row's number, and the chunks' counts are added up, so no task
    sees a shard, nor all rows that repeat one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = shared_table(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("hash"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "shard-rows",
    )
    groups = shared_table(rows.groupBy("hash").agg(F.sum("size").alias("bytes")), "shard-groups")
    capacity, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("hash") >= F.lit(cut)).cast("int")
    chunks = max(64, -(-rows.count() // CHUNK_ROWS))
    rows = rows.withColumn("shard", shard).withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)))
    counts = rows.groupBy("chunk", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = counts.select(F.col("chunk").alias("__c"), F.col("shard").alias("__s"), before.alias("start"))
    place = F.row_number().over(Window.partitionBy("chunk", "shard").orderBy("id", "crc", "size", "number"))
    out = rows.withColumn("place", place).join(starts, (F.col("chunk") == F.col("__c")) & (F.col("shard") == F.col("__s")))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )
