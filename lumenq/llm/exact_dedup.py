"""Exact dedup: a log-structured merge index of text digests, with byte verification of hits.

* *Memtables.* Each task gathers digests with their best identifier and count; a full memtable is
  flushed as a run, sorted by digest, to the shared folder. Every flush also writes a filter of its
  digests, of bounded size.
* *Compaction.* The entries of all runs are dealt by digest, sorted, and merged in one pass that keeps the
  smallest (or largest) identifier and the sum of counts of equal digests. A group of copies sends one entry
  a memtable, however large it is.
* *Lookup.* Digests are sought in each run, but only those that the run's filter lets through; all others
  skip it. A compacted index has a filter of the digests that several rows share as well, so rows without a
  copy are settled without meeting the index.
* *Verification.* Rows of groups are read again; each task compares the bytes of its own rows of a digest
  and sends one text for each different one, and what meets by digest is compared again. Digests under
  which texts differ are settled by the texts themselves.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of rows that repeat
both identifier and text, one is kept. A null identifier stays only where a group has no other. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, filter_table, frugal, maybe_in, shared_table

#: Digests of a memtable before it is flushed.
MEMTABLE_ROWS = 1 << 18
#: Bytes of texts that a task holds while it verifies.
VERIFY_BYTES = 1 << 23

ENTRY = "key binary, id long, n long"


def normalised(text: Column | str) -> Column:
    """A text with A-Z lower-cased; null is empty. Of ASCII alone, Spark's own lower-casing does the same faster."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _combined(t: pa.Table, best: str) -> pa.Table:
    """Entries with one row for each key, sorted by key."""
    t = t.group_by("key").aggregate([("id", best), ("n", "sum")])
    return t.select(["key", f"id_{best}", "n_sum"]).rename_columns(["key", "id", "n"]).sort_by("key")


def memtables(keep: str, rows: int = MEMTABLE_ROWS):
    """A task's entries (key, id, n) as runs sorted by key, one for each full memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from _combined(pa.Table.from_batches(held), keep).to_batches(max_chunksize=50_000)
                held, n = [], 0
        if held:
            yield from _combined(pa.Table.from_batches(held), keep).to_batches(max_chunksize=50_000)

    return frugal(run)


def merged_runs(keep: str):
    """One pass over entries sorted by key: equal neighbours become one. Only the last key is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = _combined(pa.concat_tables([last, t]) if last is not None else t, keep)
            yield from t.slice(0, len(t) - 1).to_batches()
            last = t.slice(len(t) - 1)
        if last is not None:
            yield from last.to_batches()

    return frugal(run)


def _verify(size: int):
    """Of each digest, one copy of each different text among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[bytes]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            rows = [(k, t) for k, texts in held.items() for t in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], ["key", "body"]
            )

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                body = (t.as_py() or b"").lower()
                known = held.setdefault(hashlib.sha256(body).digest()[:size], [])
                if body not in known:
                    known.append(body)
                    n += len(body)
            if n >= VERIFY_BYTES:
                yield flush()
                held.clear()
                n = 0
        if held:
            yield flush()

    return frugal(run)


@dataclass
class Run:
    """Entries (key, id, n) of one flush or compaction, and the filter of their keys. The memtables of a flush
    may repeat a key; a compaction has it once."""

    entries: DataFrame
    filter: DataFrame
    compacted: bool = False


class DigestIndex:
    """The index: ``flush`` adds the runs of a table of (id, sha), ``compact`` merges all runs, ``lookup`` asks them."""

    def __init__(self, keep: str = "min", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> None:
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.keep, self.digest_bytes, self.memtable_rows = keep, digest_bytes, memtable_rows
        self.runs: list[Run] = []

    def key(self) -> Column:
        return F.substring("sha", 1, self.digest_bytes)

    def _best(self, column: str) -> Column:
        return F.min(column) if self.keep == "min" else F.max(column)

    def _run(self, entries: DataFrame, label: str, compacted: bool = False) -> Run:
        written = shared_table(entries, label)
        return Run(written, shared_table(filter_table(written.select("key")), f"{label}-filter"), compacted)

    def flush(self, digests: DataFrame) -> None:
        """Add the runs of ``digests`` (id long, sha binary) as a new level of the index."""
        entries = digests.select(self.key().alias("key"), "id", F.lit(1).cast("long").alias("n"))
        self.runs.append(self._run(entries.mapInArrow(memtables(self.keep, self.memtable_rows), ENTRY), "dedup-runs"))

    def compact(self, least: int = 1) -> DataFrame:
        """(key, keep_id, group_size): all runs merged into one, which replaces them. With ``least`` of 2 only
        digests of several rows are kept: a row whose digest is not found then has no copy."""
        entries = self.runs[0].entries
        for more in self.runs[1:]:
            entries = entries.unionByName(more.entries)
        dealt = entries.repartition("key").sortWithinPartitions("key")
        merged = dealt.mapInArrow(merged_runs(self.keep), ENTRY).where(F.col("n") >= least)
        self.runs = [self._run(merged, "dedup-index", compacted=True)]
        return self.runs[0].entries.select("key", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column key) and their keep_id and group_size, null for a key that no run has. Rows
        meet a run only if its filter lets their key through."""
        columns = rows.columns
        for k, run in enumerate(self.runs):
            rows = maybe_in(rows, ["key"], run.filter, f"__in{k}")
        asked = " OR ".join(f"__in{k}" for k in range(len(self.runs)))
        found = rows.where(asked)
        for k, run in enumerate(self.runs):
            entries = run.entries if run.compacted else run.entries.groupBy("key").agg(self._best("id").alias("id"), F.sum("n").alias("n"))
            entries = entries.select(F.col("key").alias(f"__key{k}"), F.col("id").alias(f"__id{k}"), F.col("n").alias(f"__n{k}"))
            found = found.join(entries, F.col(f"__in{k}") & (F.col("key") == F.col(f"__key{k}")), "left")
        best = F.least if self.keep == "min" else F.greatest
        none = F.lit(None).cast("long")
        keep_id = best(*[F.col(f"__id{k}") for k in range(len(self.runs))], none)
        size = sum((F.coalesce(f"__n{k}", F.lit(0)) for k in range(len(self.runs))), F.lit(0).cast("long"))
        found = found.select(*columns, keep_id.alias("keep_id"), F.when(size > 0, size).alias("group_size"))
        return rows.where(f"NOT ({asked})").select(*columns, none.alias("keep_id"), none.alias("group_size")).unionByName(found)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest_bytes: int = 32,
    memtable_rows: int = MEMTABLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: (id_col, keep_id, group_size, kept, text_sha256).

    ``keep`` tells whether the smallest or the largest identifier of equal texts stays.
    ``digest_bytes`` shortens the index's keys; results don't depend on it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = shared_table(base.select("id", F.unhex(F.sha2(normalised("text"), 256)).alias("sha")), "dedup-digests")
    index = DigestIndex(keep, digest_bytes, memtable_rows)
    index.flush(digests)
    index.compact(least=2)

    # Rows that the index's filter stops have no copy; the texts of all others are compared.
    keyed = digests.withColumn("key", index.key())
    hits = maybe_in(keyed, ["key"], index.runs[0].filter, "__hit").where("__hit").select("id")
    suspects = maybe_in(base, ["id"], filter_table(hits), "__hit").where("__hit").select("text")
    bodies = suspects.mapInArrow(_verify(digest_bytes), "key binary, body binary")
    bodies = maybe_in(bodies, ["key"], index.runs[0].filter, "__hit").where("__hit")
    unequal = bodies.groupBy("key").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo != hi").select("key")
    unequal = shared_table(unequal, "dedup-unequal")

    ordinary, split = keyed, None
    if not unequal.isEmpty():
        # Different texts share a key: for those keys the text decides, for all others nothing changes.
        texts = base.select("id", normalised("text").alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256)))
        texts = texts.withColumn("key", index.key()).join(unequal, "key", "left_semi")
        best = F.min if keep == "min" else F.max
        groups = texts.groupBy("sha", "body").agg(best("id").alias("keep_id"), F.count("*").alias("group_size")).drop("body")
        split = keyed.join(unequal, "key", "left_semi").join(groups, "sha").select("id", "sha", "keep_id", "group_size")
        ordinary = keyed.join(unequal, "key", "left_anti")
    out = index.lookup(ordinary).select(
        "id", "sha", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    alone = out.where("group_size = 1").withColumn("kept", F.lit(True))
    out = out.where("group_size > 1")
    out = out.unionByName(split) if split is not None else out
    # Rows that repeat identifier and text: the first is kept.
    again = F.row_number().over(Window.partitionBy("sha", "id").orderBy("sha"))
    out = alone.unionByName(out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (again == 1)))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each class of equal texts. Rows that are surely kept aren't shuffled."""
    found = exact_dedup(docs, id_col, text_col, keep)
    multiple = found.where("group_size > 1").select(
        F.col(id_col).cast("long").alias("__i"), F.unhex("text_sha256").alias("__s"), "kept"
    )
    multiple = shared_table(multiple, "dedup-multiple")
    keyed = maybe_in(docs.withColumn("__id", F.col(id_col).cast("long")), ["__id"], filter_table(multiple.select(F.col("__i").alias("__id"))), "__m")
    sure = keyed.where("NOT __m").select(*docs.columns)
    sha = F.unhex(F.sha2(normalised(F.col(text_col).cast("string")), 256))
    rest = keyed.where("__m").withColumn("__sha", sha)
    rest = rest.withColumn("__n", F.row_number().over(Window.partitionBy("__sha", "__id").orderBy("__sha")))
    known = multiple.groupBy("__i", "__s").agg(F.max("kept").alias("__kept"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__sha") == F.col("__s"))
    rest = rest.join(known, same, "left").where("__kept IS NULL OR (__kept AND __n = 1)")
    return sure.unionByName(rest.select(*docs.columns))
