"""Suffix-array dedup: bytes inside a string of ``length`` bytes that also starts elsewhere are removed.

Texts are UTF-8 bytes. The suffixes that must be sorted together are brought together by *anchors*:

1. In every window of ``length`` bytes the start of the smallest gram hash is the window's anchor. The
   choice looks at content alone, so equal strings have their anchors at equal offsets. The windows of one
   anchor and their bytes are its *context*; a scan gives an anchor for each half window or so.
2. Contexts are counted by gram and a 128-bit BLAKE2b digest of their bytes. A gram with one context that
   occurs once has no repeat. A context that occurs twice repeats in full. Copies of a document cost one
   row a task here.
3. For grams with several contexts, one copy of each context's bytes is read again. In each group the
   suffixes from the anchor on, and the reversed prefixes up to it, are sorted (``deep_shallow``); from the
   common prefixes of both orders follows which windows of a context stand in another one too.
   A group of over ``GROUP_CONTEXTS`` contexts is first split by more of its bytes, see ``_split_groups``,
   until every part is that small or agrees on a whole window; all parts are sorted alike.
4. Marks go back to the documents by their contexts; documents without marks are not shuffled.

Matches never cross documents; overlapping occurrences count; all is judged on the input. A null text
counts as empty; repeated rows repeat each other's text; an empty table gives an empty result; other
columns pass through ``cut_repeats`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_view, drop_shared, filter_table, frugal, maybe_in, mix64, prefix_hash, range_hash, shared_table, slices
from .deep_shallow import sort_strings

LENGTH = 400
GRAM = 32
#: Bytes of text whose anchors are sought at once; must fit the position bits of a key.
CHUNK_BYTES, POSITION_BITS = 1 << 18, 21
#: Contexts of a group that one task sorts, and up to which it compares them pair by pair.
GROUP_CONTEXTS, PAIR_CONTEXTS = 1024, 256


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive keys, by running minima from both ends of blocks."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The contexts of concatenated texts: text, first window (in the buffer), windows, anchor's offset
    from the first window, and gram hash."""
    parts: list[tuple[np.ndarray, ...]] = []
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, side="right")) - 1)
        for s in range(int(offs[i]), int(offs[j]), CHUNK_BYTES):
            e = min(s + CHUNK_BYTES, int(offs[j]))
            part = buf[s : min(e + length, int(offs[j]))]
            if len(part) < length:
                continue
            prefix = prefix_hash(part)
            at = np.arange(len(part) - gram + 1)
            grams = mix64(range_hash(prefix, at, at + gram))
            keys = (grams >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | at.astype(np.uint64)
            best = _window_minima(keys, length - gram + 1)[: e - s]
            spans = np.clip(offs[i : j + 1] - s, 0, e - s)
            text = np.repeat(np.arange(i, j), np.diff(spans))[: len(best)]
            window = np.arange(len(best))
            fits = np.flatnonzero(window + length <= offs[text + 1] - s)
            if not len(fits):
                continue
            anchor = (best[fits] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
            new = np.ones(len(fits), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[fits][1:] != text[fits][:-1])
            lead = np.flatnonzero(new)
            first = fits[lead]
            count = np.diff(np.append(lead, len(fits)))
            back = anchor[lead] - first
            parts.append((text[first], first + s, count, back, grams[anchor[lead]].view(np.int64)))
        i = j
    names = ("text", "first", "windows", "back", "gram")
    if not parts:
        return dict.fromkeys(names, np.empty(0, np.int64))
    return dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def _digests(bodies: list[bytes]) -> np.ndarray:
    """128-bit digests as an array of two longs a row."""
    joined = b"".join([blake2b(x, digest_size=16).digest() for x in bodies])
    return np.frombuffer(joined, np.int64).reshape(len(bodies), 2)


def group_marks(bodies: list[bytes], back: np.ndarray, windows: np.ndarray, length: int = LENGTH, pairs: int = PAIR_CONTEXTS) -> np.ndarray:
    """For the contexts of one gram: a matrix (contexts, windows) of which windows stand in another context.

    Window w of a context starts ``d = back - w`` bytes before the anchor; two contexts share it if their
    prefixes up to the anchor agree on d bytes and their suffixes on ``length - d``.
    """
    n = len(bodies)
    order_r, lcp_r = sort_strings([b[k:] for b, k in zip(bodies, back.tolist(), strict=True)])
    order_l, lcp_l = sort_strings([b[:k][::-1] for b, k in zip(bodies, back.tolist(), strict=True)])
    width = int(back.max()) + 1
    marks = np.zeros((n, width), bool)  # by d
    if n <= pairs:
        right, left = _all_common(order_r, lcp_r), _all_common(order_l, lcp_l)
        low, high = np.maximum(length - right, 0), np.minimum(left, width - 1)
        a, b = np.nonzero((low <= high) & ~np.eye(n, dtype=bool))
        change = np.zeros((n, width + 1), np.int32)
        np.add.at(change, (a, low[a, b]), 1)
        np.add.at(change, (a, high[a, b] + 1), -1)
        marks = np.cumsum(change, axis=1)[:, :width] > 0
    else:
        rank_r, rank_l = np.argsort(order_r), np.argsort(order_l)
        lcp_r, lcp_l = np.array(lcp_r), np.array(lcp_l)
        for d in range(width):
            with_d = np.flatnonzero((back >= d) & (back - d < windows))
            if len(with_d) < 2:
                continue
            right = np.cumsum(lcp_r < length - d)[rank_r[with_d]]
            left = np.cumsum(lcp_l < d)[rank_l[with_d]]
            both, count = np.unique(right.astype(np.int64) * (n + 1) + left, return_inverse=True, return_counts=True)[1:]
            marks[with_d, d] = count[both.ravel()] > 1
    w = back[:, None] - np.arange(int(windows.max()))[None, :]
    inside = (w >= 0) & (np.arange(int(windows.max()))[None, :] < windows[:, None])
    return np.where(inside, marks[np.arange(n)[:, None], np.clip(w, 0, width - 1)], False)


def _all_common(order: list[int], lcp: list[int]) -> np.ndarray:
    """Common prefixes of all pairs: minima of the neighbours' between them."""
    n = len(order)
    out = np.zeros((n, n), np.int64)
    line = np.array(lcp)
    for k in range(n - 1):
        low = np.minimum.accumulate(line[k + 1 :])
        out[order[k], order[k + 1 :]] = low
        out[order[k + 1 :], order[k]] = low
    return out


def _runs(marks: np.ndarray) -> list[int]:
    """First and last of each run of true, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


#: A context's key.
KEY = ["gram", "c1", "c2"]


def _scan(docs: DataFrame, length: int, bodies: bool) -> DataFrame:
    """The contexts of (id, h, text), with their bytes or with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                buf, offs = byte_view(part.column("text"))
                a = anchors(buf, offs, length)
                data = buf.tobytes()
                cut = [data[x:y] for x, y in zip(a["first"].tolist(), (a["first"] + a["windows"] + length - 1).tolist(), strict=True)]
                content = _digests(cut)
                key = {"gram": a["gram"], "c1": content[:, 0], "c2": content[:, 1]}
                if bodies:
                    once = np.unique(np.ascontiguousarray(content).view("S16").ravel(), return_index=True)[1]
                    columns = {k: pa.array(v[once]) for k, v in (key | {"back": a["back"], "windows": a["windows"]}).items()}
                    columns["body"] = pa.array([cut[k] for k in once.tolist()], pa.binary())
                    yield from pa.Table.from_pydict(columns).to_batches(max_chunksize=2_000)
                else:
                    rows = pa.array(a["text"])
                    yield pa.RecordBatch.from_pydict(
                        {"id": part.column("id").take(rows), "h": part.column("h").take(rows)}
                        | {"first": pa.array(a["first"] - offs[a["text"]]), "windows": pa.array(a["windows"])}
                        | {k: pa.array(v) for k, v in key.items()}
                    )

    if bodies:
        return docs.select("id", "h", "text").mapInArrow(frugal(run), "gram long, c1 long, c2 long, back long, windows long, body binary")
    return docs.select("id", "h", "text").mapInArrow(frugal(run), "id long, h long, first long, windows long, gram long, c1 long, c2 long")


def _sorted_groups(length: int):
    """Marks of the contexts of each group; the input is sorted by (gram, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        out: list[tuple] = []

        def close() -> None:
            t = pa.Table.from_batches(held)
            if len(t) < 2:
                return
            marks = group_marks(t.column("body").to_pylist(), t.column("back").to_numpy(), t.column("windows").to_numpy(), length)
            for *key, row in zip(*(t.column(k).to_pylist() for k in KEY), marks, strict=True):
                if row.any():
                    out.append((*key, _runs(row)))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64()))], [*KEY, "spans"])

        for batch in batches:
            keys = np.stack([batch.column("gram").to_numpy(), batch.column("part").to_numpy()])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                this = tuple(keys[:, a].tolist())
                if this != now and held:
                    close()
                    held.clear()
                now = this
                held.append(batch.slice(a, b - a))
            if len(out) >= 10_000:
                yield emit()
                out.clear()
        if held:
            close()
        yield emit()

    return frugal(run)


MARKS = "gram long, c1 long, c2 long, spans array<long>"


def _halves(length: int):
    """Each context of a part goes into the two halves of the part's distances, where it has windows.

    A part (level, at) holds the windows that start d bytes before the anchor, for d in a dyadic interval.
    All of them have the bytes from the interval's least d before the anchor to ``length`` minus its largest
    d after it in common, so contexts that differ there share no window of the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, windows, bodies = batch.column("back").to_pylist(), batch.column("windows").to_pylist(), batch.column("body").to_pylist()
            width, at = batch.column("width").to_pylist(), batch.column("at").to_pylist()
            rows, halves, starts, shared = [], [], [], []
            for k, body in enumerate(bodies):
                half = width[k] // 2
                for low in (at[k], at[k] + half):
                    # Distances of this context are back - windows + 1 to back.
                    first, last = max(low, back[k] - windows[k] + 1), min(low + half - 1, back[k])
                    if first <= last:
                        right = max(0, length - min(low + half - 1, length))
                        rows.append(k)
                        halves.append(half)
                        starts.append(low)
                        shared.append(body[back[k] - low : back[k] + right] + low.to_bytes(8, "little") + half.to_bytes(8, "little"))
            if rows:
                take = pa.array(rows)
                columns = {c: batch.column(c).take(take) for c in (*KEY, "back", "windows", "body")}
                columns |= {"width": pa.array(halves, pa.int64()), "at": pa.array(starts, pa.int64())}
                digest = _digests(shared)
                columns |= {"part": pa.array(digest[:, 0]), "part2": pa.array(digest[:, 1])}
                yield pa.RecordBatch.from_pydict(columns)

    return frugal(run)


SPLIT = "gram long, c1 long, c2 long, back long, windows long, body binary, width long, at long, part long, part2 long"


def _split_groups(large: DataFrame, length: int, group_contexts: int) -> tuple[DataFrame, DataFrame | None]:
    """(parts of at most ``group_contexts`` contexts, marks of parts that agree on one whole window).

    Rounds are at most the logarithm of ``length``; each drops the contexts that are alone in their part,
    and passes on only those of parts that are still too large.
    """
    width = 1
    while width <= length:
        width *= 2
    now = large.select(*KEY, "back", "windows", "body", F.lit(width).cast("long").alias("width"), F.lit(0).cast("long").alias("at"))
    small, whole = None, None
    while True:
        items = shared_table(now.mapInArrow(_halves(length), SPLIT), "repeat-parts")
        width //= 2
        by = ["gram", "width", "at", "part", "part2"]
        sizes = shared_table(items.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "repeat-part-sizes")
        held = items.join(sizes, by)
        if width == 1:
            w = F.col("back") - F.col("at")
            return small, held.select(*KEY, F.array(w, w).alias("spans"))
        ready = held.where(F.col("n") <= group_contexts).select("gram", "part", *KEY[1:], "back", "windows", "body")
        small = ready if small is None else small.unionByName(ready)
        if sizes.where(F.col("n") > group_contexts).isEmpty():
            return small, whole
        now = held.where(F.col("n") > group_contexts).select(*KEY, "back", "windows", "body", "width", "at")


def repeated_windows(docs: DataFrame, length: int = LENGTH, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """(id, h, starts): of each document of (id, h, text) with repeats, the first and last start of runs
    of repeated strings, one after the other."""
    found = shared_table(_scan(docs, length, bodies=False), "repeat-anchors")
    # Long keys and long sums only, so that Spark aggregates by hashing; ``ref`` leads back to one document.
    contexts = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.min(F.xxhash64("id", "h")).alias("ref"))
    contexts = shared_table(contexts, "repeat-contexts")
    groups = contexts.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("n").alias("rows")).where("rows > 1").select("gram", "contexts")
    some = maybe_in(contexts, ["gram"], filter_table(groups.select("gram")), "__g").where("__g").drop("__g")
    repeated = shared_table(some.join(groups, "gram"), "repeat-candidates")
    drop_shared(contexts)

    whole = repeated.where("n > 1").select(*KEY, F.array(F.lit(0).cast("long"), F.col("windows") - 1).alias("spans"))
    mixed = repeated.where("contexts > 1")
    known = docs.withColumn("ref", F.xxhash64("id", "h"))
    flagged = maybe_in(known, ["ref"], filter_table(mixed.select("ref")), "__d").where("__d")
    bodies = maybe_in(_scan(flagged, length, bodies=True), KEY, filter_table(mixed.select(*KEY)), "__c").where("__c")
    one = bodies.groupBy(*KEY).agg(F.any_value("back").alias("back"), F.any_value("windows").alias("windows"), F.any_value("body").alias("body"))
    one = shared_table(one.join(mixed.select(*KEY, "contexts"), KEY), "repeat-bodies")
    small = one.where(F.col("contexts") <= group_contexts).select("gram", F.lit(0).cast("long").alias("part"), *KEY[1:], "back", "windows", "body")
    large = one.where(F.col("contexts") > group_contexts)
    leaves = None
    if not large.isEmpty():
        parts, leaves = _split_groups(large, length, group_contexts)
        small = small if parts is None else small.unionByName(parts)
    # By number, as sorting costs more than its bytes tell and small partitions should not be merged.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = small.repartition(tasks, "gram", "part").sortWithinPartitions("gram", "part")
    marks = ordered.mapInArrow(_sorted_groups(length), MARKS)
    if leaves is not None:
        marks = marks.unionByName(leaves)
    marks = marks.join(whole.select(*KEY), KEY, "left_anti").unionByName(whole)
    marks = shared_table(marks, "repeat-marks")
    drop_shared(repeated, one)

    hits = maybe_in(found, KEY, filter_table(marks.select(*KEY)), "__m").where("__m").drop("__m")
    placed = hits.join(marks, KEY).select("id", "h", F.expr("transform(spans, x -> x + first)").alias("spans"))
    return placed.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("starts"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and ``kept``, the remaining bytes (binary: a cut may fall
    inside a character). Columns of ``docs`` with these names are replaced."""
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    columns = [c for c in docs.columns if c not in added]
    text = F.col(text_col).cast("string")
    keyed = docs.select(*columns, F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__h"))
    base = keyed.select(F.col("__id").alias("id"), F.col("__h").alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    starts = shared_table(repeated_windows(base, length, group_contexts), "repeat-starts")
    flagged = maybe_in(keyed, ["__id", "__h"], filter_table(starts.select("id", "h")), "__f")
    clean = flagged.where("NOT __f").select(*columns, F.lit(None).cast("array<long>").alias("__starts"))
    marked = starts.select(F.col("id").alias("__sid"), F.col("h").alias("__sh"), F.col("starts").alias("__starts"))
    same = F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__h") == F.col("__sh"))
    rest = flagged.where("__f").join(marked, same, "left")
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                buf, offs = byte_view(part.column(at))
                removed, runs, kept = [], [], []
                for k, spans in enumerate(part.column(len(columns)).to_pylist()):
                    body = buf[offs[k] : offs[k + 1]]
                    if not spans:
                        removed.append(0)
                        runs.append(0)
                        kept.append(body.tobytes())
                        continue
                    depth = np.zeros(len(body) + 1, np.int64)
                    edges = np.array(spans)
                    np.add.at(depth, edges[::2], 1)
                    np.add.at(depth, edges[1::2] + length, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(len(_runs(gone)) // 2)
                    kept.append(body[~gone].tobytes())
                cols = [part.column(i) for i in range(len(columns))]
                cols += [pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*columns, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    schema = f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary"
    return clean.unionByName(rest.select(*columns, "__starts")).mapInArrow(frugal(run), schema)
