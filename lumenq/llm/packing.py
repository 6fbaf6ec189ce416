"""Best-fit packing with conflicts: residual-ordered bins and a successor search.

Rows are numbered once, in a written table, and dealt by a hash of the number to groups of about
``GROUP_ROWS``, so rows that repeat each other are dealt out too. The groups' number grows with the table,
and each is packed alone, so no task sees more than a group and a lost group is packed again alike. A row longer than
``capacity`` fills whole bins of its own with leading pieces; its last piece is packed like a short row.

Pieces go in by falling length. Bins carry a bitmap of sources and one of duplicate clusters, and two
pieces that share either never share a bin. Bins are kept by residual; a bitmap over residuals finds the
smallest one that holds the piece, and the search goes on to its successors until a compatible bin, the
tightest, is found. For a source or cluster with many rows in a group, a bitmap of the residuals at which
some bin lacks it spares the search all others.

Defined cases: a null text has length 0 plus the separator; a null source or cluster conflicts with
nothing; ties go by identifier; rows that repeat an identifier are packed each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, shared_table

CAPACITY = 8192
GROUP_ROWS = 4096
#: Rows of a group from which a source or cluster gets its own bitmap of residuals.
HOT_ROWS = 32


class Bins:
    """Open bins of one group."""

    def __init__(self, capacity: int, hot: list[int]) -> None:
        self.capacity = capacity
        self.residual: list[int] = []
        self.labels: list[int] = []  # bitmap of the labels in a bin
        self.at: dict[int, list[int]] = defaultdict(list)
        self.any = 0  # bitmap of residuals with a bin
        self.hot = hot
        self.lacking = {h: Counter() for h in hot}  # residual -> bins without the label
        self.lacks = dict.fromkeys(hot, 0)  # bitmap of those residuals

    def _count(self, bin_: int, by: int) -> None:
        r, held = self.residual[bin_], self.labels[bin_]
        for h in self.hot:
            if not held >> h & 1:
                self.lacking[h][r] += by
                if self.lacking[h][r]:
                    self.lacks[h] |= 1 << r
                else:
                    self.lacks[h] &= ~(1 << r)

    def find(self, length: int, labels: list[int], mask: int) -> int | None:
        """The compatible bin with the smallest residual of at least ``length``."""
        open_ = self.any
        for label in labels:
            if label in self.lacks:
                open_ &= self.lacks[label]
        open_ >>= length
        r = length
        while open_:
            step = (open_ & -open_).bit_length() - 1
            r += step
            for bin_ in self.at[r]:
                if not self.labels[bin_] & mask:
                    return bin_
            open_ >>= step + 1
            r += 1
        return None

    def put(self, length: int, labels: list[int]) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length`` with these labels."""
        mask = sum(1 << label for label in labels)
        bin_ = self.find(length, labels, mask)
        if bin_ is None:
            bin_ = len(self.residual)
            self.residual.append(self.capacity)
            self.labels.append(0)
        else:
            r = self.residual[bin_]
            self._count(bin_, -1)
            self.at[r].remove(bin_)
            if not self.at[r]:
                del self.at[r]
                self.any &= ~(1 << r)
        offset = self.capacity - self.residual[bin_]
        self.residual[bin_] -= length
        self.labels[bin_] |= mask
        r = self.residual[bin_]
        self.at[r].append(bin_)
        self.any |= 1 << r
        self._count(bin_, 1)
        return bin_, offset


def pack_group(rows: list[tuple], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, length) for rows (length, source or None, cluster or None), best fit by falling length."""
    counts = Counter()
    for _, source, cluster in rows:
        counts.update(k for k in (("s", source), ("c", cluster)) if k[1] is not None)
    # A label that one row has alone conflicts with nothing and needs no bit.
    number = {k: i for i, k in enumerate(k for k, n in counts.items() if n > 1)}
    bins = Bins(capacity, [i for k, i in number.items() if counts[k] >= HOT_ROWS])
    tails = []
    extra = []
    for i, (length, source, cluster) in enumerate(rows):
        whole = (length - 1) // capacity if length > capacity else 0
        extra += [(i, piece) for piece in range(whole)]
        labels = [number[k] for k in (("s", source), ("c", cluster)) if k in number]
        tails.append((length - whole * capacity, i, whole, labels))
    tails.sort(key=lambda t: (-t[0], t[1]))
    for length, i, piece, labels in tails:
        bin_, offset = bins.put(length, labels)
        yield i, piece, bin_, offset, length
    for k, (i, piece) in enumerate(extra, len(bins.residual)):
        yield i, piece, k, 0, capacity


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster: Column | None = None,
    length: Column | None = None,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(id_col, piece, bin_id, offset, length) for every piece of every row.

    ``length`` is the UTF-8 bytes of the text and one separator unless given; ``cluster`` tells copies
    apart and is the text, A-Z lower-cased, unless given. Only lengths and hashes are written and shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (length if length is not None else F.octet_length(text) + 1).cast("long").alias("length"),
        (F.when(F.col(source_col).isNotNull(), F.xxhash64(source_col)) if source_col else F.lit(None).cast("long")).alias("source"),
        (cluster if cluster is not None else F.xxhash64(ascii_lower(text))).alias("cluster"),
    )
    # The number is part of the written table, so a task that runs again deals its rows alike.
    rows = shared_table(rows.withColumn("number", F.monotonically_increasing_id()), "pack-rows")
    groups = max(1, -(-rows.count() // group_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups))).drop("number")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "length", "source", "cluster"], na_position="first", ignore_index=True)
        none = frame.isna()
        plain = [
            (int(n), None if a else s, None if b else c)
            for n, s, c, a, b in zip(frame["length"], frame["source"], frame["cluster"], none["source"], none["cluster"], strict=True)
        ]
        part = int(frame["part"].iloc[0])
        got = pd.DataFrame(list(pack_group(plain, capacity)), columns=["row", "piece", "bin", "offset", "length"])
        return pd.DataFrame({
            "id": frame["id"].to_numpy()[got["row"]], "piece": got["piece"], "bin_id": part * (1 << 32) + got["bin"],
            "offset": got["offset"], "length": got["length"],
        })

    out = rows.groupBy("part").applyInPandas(run, "id long, piece long, bin_id long, offset long, length long")
    return out.select(F.col("id").alias(id_col), "piece", "bin_id", "offset", "length")
