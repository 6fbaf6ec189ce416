"""Shared ground of the training-data operators: shared storage, bounded filters, byte-level text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter: 8 MiB at most, whatever the number of keys.
FILTER_BITS = 1 << 26
#: Bytes of text that a worker tokenises at a time.
PIECE_BYTES = 1 << 19


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where one process does everything, an unset folder is replaced by a
    temporary one; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenq-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor
    costs the reader nothing but its own tasks. The folder goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenq/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- worker memory

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return a worker's free memory to the system: an idle worker lives on beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for ``mapInArrow`` that gives memory back when its task ends."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return wrapped


# ---------------------------------------------------------------- bounded membership filter


def filter_table(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash Bloom filter over the rows of ``keys`` as 4-KiB bitmaps, built and merged by Spark.

    Its size is at most ``bits / 8`` bytes however many keys there are, so it may be broadcast; with
    more keys it only lets more strangers through, and the exact join that follows drops them.
    """
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    return (
        keys.select(at.alias("__at"))
        .groupBy(F.expr("bitmap_bucket_number(__at)").alias("__bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__at))").alias("__bits"))
    )


def maybe_in(df: DataFrame, columns: list[str], filter_: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with a boolean ``flag``: false only where the row's key is surely not in the filter."""
    columns_before = df.columns
    at = F.pmod(F.xxhash64(*columns), F.lit(bits))
    joined = df.withColumn("__at", at).join(
        F.broadcast(filter_), F.expr("bitmap_bucket_number(__at)") == F.col("__bucket"), "left"
    )
    byte = F.expr("conv(hex(substring(__bits, cast(bitmap_bit_position(__at) div 8 as int) + 1, 1)), 16, 10)").cast("int")
    bit = F.expr("cast(pow(2, bitmap_bit_position(__at) % 8) as int)")
    return joined.select(*columns_before, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias(flag))


def ascii_lower(column: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- bytes of Arrow columns


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    base = int(offs[0])
    length = int(offs[-1]) - base
    buf = np.frombuffer(data, np.uint8, length, base) if length else np.empty(0, np.uint8)
    return buf, offs - base


def slices(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES):
    """Cut a batch into slices of about ``most`` bytes of text; a longer text stays whole."""
    col = batch.column(column)
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word byte after lower-casing: 0-9, a-z and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a uint64 array that the caller gives away."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i up to n."""
    if len(_POW.get("up", ())) <= n:
        size = max(n + 1, PIECE_BYTES // 8)
        for name, base in (("up", int(_P)), ("down", pow(int(_P), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.cumprod(x, dtype=np.uint64)
    return _POW["up"], _POW["down"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of (byte+1)·p^k over k in [i, j); multiply by p^-i to shift to 0."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    x = buf.astype(np.uint64)
    x += np.uint64(1)
    x *= up[: len(buf)]
    np.cumsum(x, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end), equal for equal strings wherever they stand."""
    _, down = powers(len(prefix))
    x = prefix[end]
    x -= prefix[start]
    x *= down[start]
    return x


def _words(buf: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[buf]
    inside = IS_WORD[low]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[firsts[(firsts >= 0) & (firsts < len(buf))]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = firsts[(firsts > 0) & (firsts <= len(buf))] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, mix64(range_hash(prefix_hash(low), starts, ends))


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte start, byte end) of every word of the texts, and the texts' offsets among words.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters; they end with their text.
    A text longer than a piece is read in pieces that end between words.
    """
    hashes, starts, ends = [], [], []
    bounds = [0]
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE_BYTES, side="right")) - 1)
        lo, hi = int(offs[i]), int(offs[j])
        at = lo
        while at < hi:
            to = hi
            if hi - at > PIECE_BYTES and j == i + 1:
                to = at + PIECE_BYTES
                back = IS_WORD[LOWER[buf[at:to]]][::-1]
                if not back.all():
                    to -= int(np.argmin(back))
                else:
                    ahead = IS_WORD[LOWER[buf[to:hi]]]
                    to = hi if ahead.all() else to + int(np.argmin(ahead))
            s, e, h = _words(buf[at:to], offs[i : j + 1] - at)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
            at = to
        i = j
    if not hashes:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.zeros(n + 1, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offs).astype(np.int64)


def word_hash(word: bytes) -> int:
    """The hash that ``word_hashes`` gives to one lower-case word."""
    buf = np.frombuffer(word, np.uint8)
    return int(word_hashes(buf, np.array([0, len(buf)]))[0][0])
