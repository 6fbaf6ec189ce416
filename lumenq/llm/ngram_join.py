"""N-gram Jaccard self-join: MinHash banding proposes, full n-gram sets decide.

1. Each text becomes its set of word n-grams (64-bit hashes); texts with equal sets form a *set class*
   that goes on as one row with a weight.
2. Bands of MinHash rows are chosen for a target recall at the threshold. Classes meet by band hash;
   buckets of one are dropped, and of buckets with the same members only the first band's is kept.
3. The sets of classes that share a bucket are read again and compared in full. A pair is compared in the
   first band on which it agrees, so once. In a large bucket each set is first put down as its difference
   from one member's set, in tasks of a block each; then the differences, which are short among near
   copies, meet block against block. A bucket of R sets has blocks of some ``4 * sqrt(R)``, so its sets move
   once, and differences R^1.5 / 4 times.
4. Each comparison gives link counts and a spanning edge for each class, never a row for each pair; the
   edges are joined to components.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A text with words, but fewer than
``n``, has one n-gram of all its words; a text without words (also null) links to nothing. A link is a
pair of different rows; rows that repeat a text link like copies. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_view, drop_shared, filter_table, frugal, maybe_in, mix64, shared_table, slices, word_hashes
from .components import components

#: n-grams and least rows of a bucket's block; two blocks meet in a task at a time.
BLOCK_GRAMS, BLOCK_ROWS = 1 << 19, 256


def band_plan(threshold: float, recall: float = 0.999, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of about ``hashes`` hashes that finds a pair whose similarity
    is exactly ``threshold`` with probability ``recall``. Bands of one row need as many hashes as they need."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1] and recall in (0, 1)")
    best = None
    for rows in range(1, hashes + 1):
        hit = threshold**rows
        bands = math.ceil(math.log1p(-recall) / math.log1p(-hit)) if hit < 1 else 1
        if best is None or bands * rows <= hashes:
            best = (bands, rows)
    return best


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, concatenated, and the offsets."""
    buf, offs = byte_view(texts)
    words, _, _, at = word_hashes(buf, offs)
    count = np.diff(at)
    many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(many)])
    start = np.repeat(at[:-1], many) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], many)
    end = np.repeat(at[1:], many)
    grams = np.zeros(len(start), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    seed = np.uint64(0x2545F4914F6CDD1D)
    for k in range(n):
        word = padded[start + k]
        word[start + k >= end] = 0
        grams = mix64((grams ^ word) * seed + np.uint64(k))
    keep = np.ones(len(grams), bool)
    for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        grams[a:b].sort()
    keep[1:] = grams[1:] != grams[:-1]
    keep[out_at[:-1][many > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], total[out_at]


def _constants(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:hashes] >> np.uint64(32)).astype(np.uint32), (x[hashes:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def band_hashes(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each text with n-grams and each band, shape (texts, bands)."""
    full = np.diff(at) > 0
    starts = at[:-1][full]
    out = np.zeros((len(at) - 1, bands), np.int64)
    if not len(starts):
        return out
    low = (grams >> np.uint64(32)).astype(np.uint32)
    flip, times = _constants(bands * rows)
    work = np.empty_like(low)
    for band in range(bands):
        h = np.full(len(starts), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.bitwise_xor(low, flip[k], out=work)
            np.multiply(work, times[k], out=work)
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, starts))
        out[full, band] = h.view(np.int64)
    return out


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, h, node, grams, bands) of (id, h, text); node is the digest of the n-gram set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = ngram_sets(part.column("text"), n)
                node = [_digest(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(node, pa.binary()), pa.array(np.diff(at)), _lists(band_hashes(grams, at, bands, rows))],
                    ["id", "h", "node", "grams", "bands"],
                )

    return docs.mapInArrow(frugal(run), "id long, h long, node binary, grams long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = ngram_sets(part.column("text"), n)
                cut = [grams[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(x) for x in cut], pa.binary()), pa.array([x.tobytes() for x in cut], pa.binary())], ["set", "body"]
                )

    return docs.select("text").mapInArrow(frugal(run), "set binary, body binary")


def compare(
    band: int, cross: bool, side: np.ndarray, nodes: np.ndarray, weight: np.ndarray, bands: np.ndarray, sets: list, threshold: float,
    size: np.ndarray | None = None, base: np.ndarray | None = None,
) -> list[tuple[int, int, int]]:
    """Links of one bucket's rows: (node, smallest node of its local component, weight of its links).

    Pairs that agree in an earlier band are left to that band; if ``cross``, only pairs of the two sides
    count. ``intersection >= t/(1+t) * (|a|+|b|)`` is the Jaccard test without division.

    ``sets`` are whole sets, or differences from one set P: then ``size`` has the whole sets' sizes and
    ``base`` is |P| / 2 less what a set lacks of P. As a difference holds what is lacking and what is more,
    ``|a & b| = base[a] + base[b] + |difference of a & difference of b|``.
    """
    n = len(nodes)
    own = np.array([len(s) for s in sets])
    size = own if size is None else size
    base = np.zeros(n) if base is None else base
    every = np.concatenate(sets)
    ids = np.unique(every, return_inverse=True)[1].ravel()
    at = np.concatenate([[0], np.cumsum(own)])
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
    links = np.zeros(n, np.int64)
    root = np.arange(n)
    for a in range(n - 1):
        # Sets whose sizes differ too much cannot reach the threshold.
        ok = (size[a + 1 :] >= threshold * size[a] - 1e-9) & (threshold * size[a + 1 :] <= size[a] + 1e-9)
        if cross:
            ok &= side[a + 1 :] != side[a]
        if band:
            ok &= ~(bands[a + 1 :, :band] == bands[a, :band]).any(axis=1)
        others = np.flatnonzero(ok) + a + 1
        if not len(others):
            continue
        mark[ids[at[a] : at[a + 1]]] = 1
        if 2 * len(others) > n - a:
            total = np.concatenate([[0], np.cumsum(mark[ids[at[a + 1] :]])])
            common = total[at[others + 1] - at[a + 1]] - total[at[others] - at[a + 1]]
        else:
            common = np.array([int(mark[ids[at[b] : at[b + 1]]].sum()) for b in others])
        mark[ids[at[a] : at[a + 1]]] = 0
        common = common + base[a] + base[others]
        linked = others[common * (1 + threshold) >= threshold * (size[a] + size[others]) - 1e-9]
        if len(linked):
            links[a] += weight[linked].sum()
            links[linked] += weight[a]
            joined = np.unique(root[np.append(linked, a)])
            root[np.isin(root, joined)] = joined[0]
    hit = np.flatnonzero(links)
    least: dict[int, int] = {}
    for i in hit:
        r = int(root[i])
        least[r] = min(least.get(r, int(nodes[i])), int(nodes[i]))
    return [(int(nodes[i]), least[int(root[i])], int(links[i])) for i in hit]


def _key_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The rows of each key, for input that is sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in key])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if a == b:
                continue
            this = tuple(int(x) for x in keys[:, a])
            if this != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = this
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


#: A bucket's rows, whole sets or differences from its pivot.
MEMBER = "band int, value long, block int, node long, weight long, bands array<long>, size long, base double, body binary"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block of a large bucket, led by the pivot, as differences from the pivot's set."""
    for _, t in _key_runs(batches, ["band", "value", "block"]):
        t = t.combine_chunks()
        pivot_at = int(np.flatnonzero(t.column("pivot").to_numpy())[0])
        pivot = np.frombuffer(t.column("body")[pivot_at].as_py(), np.uint64)
        rows = np.flatnonzero(~t.column("pivot").to_numpy())
        size, base, body = [], [], []
        for i in rows.tolist():
            own = np.frombuffer(t.column("body")[i].as_py(), np.uint64)
            different = np.setxor1d(own, pivot, assume_unique=True)
            lacks = (len(different) - len(own) + len(pivot)) // 2
            size.append(len(own))
            base.append(len(pivot) / 2 - lacks)
            body.append(different.tobytes())
        take = pa.array(rows)
        columns = {k: t.column(k).take(take) for k in ("band", "value", "block", "node", "weight", "bands")}
        columns |= {"size": pa.array(size, pa.int64()), "base": pa.array(base, pa.float64()), "body": pa.array(body, pa.binary())}
        yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=2_000)


def _compare_runs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "root", "links"])

        for (band, _, i, j), t in _key_runs(batches, ["band", "value", "i", "j"]):
            if len(t) < 2:
                continue
            t = t.combine_chunks()
            bands = pa.concat_arrays(t.column("bands").chunks)
            sets = [np.frombuffer(x, np.uint64) for x in t.column("body").to_pylist()]
            out += compare(
                band, i != j, t.column("block").to_numpy(), t.column("node").to_numpy(), t.column("weight").to_numpy(),
                bands.flatten().to_numpy().reshape(len(t), -1), sets, threshold, t.column("size").to_numpy(), t.column("base").to_numpy(),
            )
            if len(out) >= 10_000:
                yield emit()
                out.clear()
        yield emit()

    return frugal(run)


def similar_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999
) -> DataFrame:
    """One row per row of ``docs``: (id, h, class_id, class_h, class_size, links).

    ``h`` is a hash of the text and tells rows with one identifier apart. The class of a row is its
    component of links; (class_id, class_h) is the row of it with the smallest identifier (null last).
    """
    bands, rows = band_plan(threshold, recall)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sig = shared_table(signatures(base, n, bands, rows), "join-signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    classes = sig.where("grams > 0").groupBy("node").agg(
        first, F.count("*").alias("weight"), F.any_value("grams").alias("grams"), F.any_value("bands").alias("bands")
    )
    # From here on a class is known by a number, which is written with it.
    classes = shared_table(classes.withColumnRenamed("node", "digest").withColumn("node", F.monotonically_increasing_id()), "join-classes")

    entries = classes.select("node", "grams", F.posexplode("bands").alias("band", "value"))
    buckets = (
        entries.groupBy("band", "value")
        .agg(F.count("*").alias("rows"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("sum"), F.sum("grams").alias("grams"))
        .where("rows > 1")
    )
    # Of buckets with the same members the first band's stays.
    buckets = buckets.groupBy("rows", "least", "sum", "grams").agg(F.min("band").alias("band"), F.min_by("value", "band").alias("value"))
    side = F.greatest(F.lit(float(BLOCK_ROWS)), 4 * F.sqrt("rows"))
    blocks = F.greatest(F.ceil(F.col("rows") / side), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    buckets = shared_table(buckets.select("band", "value", F.col("least").alias("pivot"), blocks.alias("blocks")), "join-buckets")
    entries = maybe_in(entries.drop("grams"), ["band", "value"], filter_table(buckets.select("band", "value")), "__b").where("__b").drop("__b")
    members = shared_table(entries.join(buckets, ["band", "value"]), "join-members")

    wanted = members.select("node").distinct().join(classes, "node").select("node", "digest", "first.id", "first.h", "weight", "bands")
    wanted = shared_table(wanted, "join-wanted")
    some = maybe_in(base, ["id", "h"], filter_table(wanted.select("id", "h")), "__w").where("__w")
    sets = _sets(some, n).join(wanted.withColumnRenamed("digest", "set"), "set").groupBy("node").agg(
        F.any_value("body").alias("body"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands")
    )
    sets = shared_table(sets, "join-sets")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block)
    held = ["band", "value", "block", "node", "weight", "bands"]
    small = dealt.where("blocks = 1").join(sets, "node").select(*held, (F.length("body") / 8).cast("long").alias("size"), F.lit(0.0).alias("base"), "body")
    large = members.where("blocks > 1")
    count = buckets.where("blocks > 1").select("band", "value", F.col("blocks").alias("count"))
    compared = small
    if not large.isEmpty():
        # One copy of the pivot's set for each block of its bucket, and each member's set once; sets of no large bucket stay.
        wide = maybe_in(sets, ["node"], filter_table(large.select("node")), "__l").where("__l").drop("__l")
        pivots = buckets.where("blocks > 1").join(wide, F.col("pivot") == F.col("node")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows_ = dealt.where("blocks > 1").join(wide, "node").select(*held, "body", F.lit(False).alias("pivot"))
        rows_ = rows_.unionByName(pivots.select(*held, "body", F.lit(True).alias("pivot")))
        at = ["band", "value", "block"]
        differences = shared_table(rows_.repartition(*at).sortWithinPartitions(*at).mapInArrow(frugal(_differences), MEMBER), "join-differences")
        compared = compared.unionByName(differences)
    compared = compared.join(count, ["band", "value"], "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("count", F.lit(1)) - 1)))
    compared = compared.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "count")
    key = ["band", "value", "i", "j"]
    found = compared.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare_runs(threshold), "node long, root long, links long")
    found = shared_table(found, "join-links")
    drop_shared(members, wanted, buckets, sets)

    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.select("node", "digest", "first", "weight").join(labels.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left")
    classes = classes.join(links, "node", "left").select(
        "digest", "first", "weight", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")
    )
    classes = shared_table(classes, "join-labels")
    whole = classes.groupBy("label").agg(F.min("first").alias("first"), F.sum("weight").alias("class_size"))
    per = classes.select("digest", "label", "weight", "links").join(whole, "label").select("digest", "first", "class_size", (F.col("links") + F.col("weight") - 1).alias("links"))
    out = sig.select("id", "h", F.when(F.col("grams") > 0, F.col("node")).alias("digest")).join(per, "digest", "left")
    alone = F.col("first").isNull()
    return out.select(
        "id", "h",
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"),
        F.when(alone, F.col("h")).otherwise(F.col("first.h")).alias("class_h"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("links", F.lit(0)).alias("links"),
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: (id_col, class_id, class_size, links)."""
    found = similar_rows(docs, id_col, text_col, n, threshold)
    return found.select(F.col("id").alias(id_col), "class_id", "class_size", "links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class. Rows that are surely kept aren't shuffled."""
    found = similar_rows(docs, id_col, text_col, n, threshold)
    gone = found.where(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h")))).select("id", "h").distinct()
    gone = shared_table(gone.select(F.col("id").alias("__gid"), F.col("h").alias("__gh")), "join-gone")
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(F.col(text_col).cast("string")))
    keyed = maybe_in(keyed, ["__id", "__h"], filter_table(gone), "__g")
    sure = keyed.where("NOT __g").select(*docs.columns)
    rest = keyed.where("__g").join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__h") == F.col("__gh")), "left_anti")
    return sure.unionByName(rest.select(*docs.columns))
