"""Benchmark decontamination: suffix arrays over shards of the training words, searched by all test suffixes.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A test suffix starts at every
word of a benchmark item from which a whole window follows: ``window`` words, or all words of an item
that has fewer. Each task cuts its documents into shards, orders the shard's word suffixes to window
depth, and finds each test suffix by two binary searches. Suffixes whose first words (up to four) never
occur together in the benchmark are left out of the array: every test suffix starts with such words, so
none can match there. The words of what is found are compared byte by byte. Occurrences that continue
each other in document and item are joined to the longest verbatim match and its place.

No shuffle: the documents are read once. The benchmark goes to the tasks in blocks of about ``BLOCK_BYTES``
of text, which the driver reads and sends one after the other; a task searches its shards block by block,
holding one of them, and merges the hits of a document in place. Neither side ever holds the benchmark. An
item is not divided.

Defined cases: a null text has no words; an item without words has no window; empty tables give zero
hits or no rows; repeated rows are judged alike; of equally long matches the first in the document, then of
the smallest item and the first in it, is named; other columns pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, byte_view, frugal, slices, word_hashes

WINDOW = 13
#: A document is contaminated from this share of hit words on.
SHARE = 1 / 20
#: Bytes of benchmark text in a block; built, it takes some 25 times as much.
BLOCK_BYTES = 2_000_000
#: Bytes of training text in a shard, and shards that a task holds while it goes through several blocks.
SHARD_BYTES, HELD_SHARDS = 1 << 22, 4

_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    n = len(h) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _GRAM[0]
    for k in range(1, q):
        out += h[k : n + k] * _GRAM[k]
    return out


class _Set:
    """Sorted 64-bit keys behind a table of their low bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of x that are in the set, and their places there."""
        at = np.flatnonzero(self.low[(x & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        good = self.keys[place] == x[at]
        return at[good], place[good]


class TestSuffixes:
    """The windows at which test suffixes start, as sorted-search keys, with their items and places."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.item_ids = [i for i, _ in items]
        buf, offs = byte_view(pa.array([t for _, t in items], pa.string()))
        h, start, end, at = word_hashes(buf, offs)
        self.vocabulary = _Set(h)
        _, ids = self.vocabulary.places(h)
        # The bytes of each word of the vocabulary, for comparison.
        some = np.unique(h, return_index=True)[1]
        low = LOWER[buf]
        self.word_bytes = np.concatenate([low[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)] or [low[:0]])
        self.word_at = np.concatenate([[0], np.cumsum(end[some] - start[some])])
        self.ids = np.concatenate([ids.astype(np.uint32) + np.uint32(1), np.zeros(window, np.uint32)])
        sizes = np.minimum(np.diff(at), window)
        many = np.where(sizes > 0, np.diff(at) - sizes + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = at[item] + place
        self.empty = not len(first)
        if self.empty:
            return
        every = self._windows(first, sizes[item])
        _, lead, inverse = np.unique(self._keys(every), return_index=True, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.first, self.length = first[lead].astype(np.uint32), sizes[item][lead].astype(np.uint8 if window < 256 else np.int64)
        self.owner, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.owned = np.searchsorted(inverse.ravel()[order], np.arange(len(lead) + 1)).astype(np.int32)
        self.gram = min(4, int(self.length.min()))
        # Only grams that start a test suffix can start an occurrence of one.
        self.grams = _Set(_grams(np.concatenate([h, np.zeros(4, np.uint64)]), self.gram)[np.unique(first)])
        self._build()

    def _windows(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        steps = np.arange(self.window)[None, :]
        rows = self.ids[first.astype(np.int64)[:, None] + steps]
        rows[steps >= np.asarray(length)[:, None]] = 0
        return rows

    def _build(self) -> None:
        rows = self._windows(self.first, self.length)
        self.low_keys = self._keys(rows)
        rows[np.arange(self.window)[None, :] >= self.length[:, None]] = np.iinfo(np.uint32).max
        self.high_keys = self._keys(rows)

    def __getstate__(self) -> dict:
        """Keys are built again where they are used; they are most of the bytes."""
        return {k: v for k, v in self.__dict__.items() if k not in ("low_keys", "high_keys")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if not self.empty:
            self._build()

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """Big-endian words as byte strings: their order is the order of the word sequences."""
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, h: np.ndarray, at: np.ndarray, every_suffix: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence in a shard of word hashes with text offsets, and the
        shard's words as places in the vocabulary from 1 (0: none). ``every_suffix`` leaves none out of the array."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        if self.empty or not len(h):
            return none
        start = np.arange(len(h)) if every_suffix else self.grams.places(_grams(h, self.gram))[0]
        end = at[np.searchsorted(at, start, side="right")]
        start, end = start[start + self.gram <= end], end[start + self.gram <= end]
        if not len(start):
            return none
        ids = np.zeros(len(h) + self.window, np.uint32)
        known, place = self.vocabulary.places(h)
        ids[known] = place + 1
        steps = start[:, None] + np.arange(self.window)
        rows = ids[steps]
        rows[steps >= end[:, None]] = 0
        keys = self._keys(rows)
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        lo = np.searchsorted(ordered, self.low_keys, side="left")
        hi = np.searchsorted(ordered, self.high_keys, side="right")
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return start[suffixes[lo[which] + inside]], which, ids

    def verified(self, shard: Shard, pos: np.ndarray, which: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences all of whose words have the bytes of the benchmark's words."""
        size = self.length[which].astype(np.int64)
        words = np.flatnonzero(_covered(pos, size, len(shard.h)))
        word = ids[words].astype(np.int64) - 1
        length = shard.end[words] - shard.start[words]
        wrong = length != self.word_at[word + 1] - self.word_at[word]
        same = np.flatnonzero(~wrong)
        owner = np.repeat(same, length[same])
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(length[same]) - length[same], length[same])
        differs = LOWER[shard.buf[shard.start[words[owner]] + inside]] != self.word_bytes[self.word_at[word[owner]] + inside]
        wrong[owner[differs]] = True
        if not wrong.any():
            return pos, which
        bad = np.zeros(len(shard.h) + 1, np.int64)
        bad[words[wrong] + 1] = 1
        bad = np.cumsum(bad)
        good = bad[pos + size] == bad[pos]
        return pos[good], which[good]

    def mark(self, shard: Shard) -> None:
        """Add this block's hits to a shard: hit words, items, and longest matches."""
        pos, which, ids = self.search(shard.h, shard.at)
        if len(pos):
            pos, which = self.verified(shard, pos, which, ids)
        if not len(pos):
            return
        at = shard.at
        size = self.length[which].astype(np.int64)
        shard.hit |= _covered(pos, size, len(shard.h))
        doc = np.searchsorted(at, pos, side="right") - 1
        # Every occurrence with every place its window has in the benchmark, along diagonals.
        owners = np.diff(self.owned)[which].astype(np.int64)
        k = np.repeat(self.owned[which].astype(np.int64), owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)
        item, place = self.owner[k].astype(np.int64), self.place[k].astype(np.int64)
        pos, doc, size = np.repeat(pos, owners), np.repeat(doc, owners), np.repeat(size, owners)
        order = np.lexsort((pos, pos - place, item, doc))
        pos, doc, size, item, place = pos[order], doc[order], size[order], item[order], place[order]
        new = np.ones(len(pos), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | ((pos - place)[1:] != (pos - place)[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(pos))) - 1 + size[first]
        best = np.lexsort((place[first], item[first], pos[first], -run, doc[first]))
        of, lead = np.unique(doc[first][best], return_index=True)
        pair = np.unique(np.stack([doc, item]), axis=1)
        cut = np.searchsorted(pair[0], np.append(of, shard.n))
        for d, b, x, y in zip(of.tolist(), best[lead].tolist(), cut[:-1], cut[1:], strict=True):
            f = first[b]
            match = (-int(run[b]), int(pos[f] - at[d]), self.item_ids[item[f]], int(place[f]))
            shard.match[d] = min(shard.match.get(d, match), match)
            shard.items.setdefault(d, set()).update(self.item_ids[i] for i in pair[1][x:y])


def _covered(pos: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, pos, 1)
    np.add.at(depth, pos + size, -1)
    return np.cumsum(depth[:-1]) > 0


class Shard:
    """The words of some texts, and what the blocks of a benchmark have found in them so far."""

    def __init__(self, texts: pa.Array) -> None:
        self.buf, offs = byte_view(texts)
        self.h, self.start, self.end, self.at = word_hashes(self.buf, offs)
        self.n = len(texts)
        self.hit = np.zeros(len(self.h), bool)
        self.items: dict[int, set[str]] = {}
        self.match: dict[int, tuple[int, int, str, int]] = {}

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(n_words, n_hit) of each text."""
        total = np.concatenate([[0], np.cumsum(self.hit)])
        return np.diff(self.at), total[self.at[1:]] - total[self.at[:-1]]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of about BLOCK_BYTES of text, partition after partition; at least one block."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    order = lambda r: (r[0], r[1] or "")
    block: list[tuple[str, str | None]] = []
    size = n = 0
    for item, text in items.toLocalIterator():
        length = len((text or "").encode())
        if block and size + length > BLOCK_BYTES:
            yield sorted(block, key=order)
            block, size, n = [], 0, n + 1
        block.append((item, text))
        size += length
    if block or not n:
        yield sorted(block, key=order)


def _sent(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Broadcast]:
    """A broadcast for each block. What is sent lies on disk; the driver builds one block at a time."""
    sent = []
    for block in _blocks(benchmark, id_col, text_col):
        shared = benchmark.sparkSession.sparkContext.broadcast(TestSuffixes(block, window))
        _let_go(shared)
        sent.append(shared)
    return sent


def _let_go(shared: Broadcast) -> None:
    """Drop the copy that a broadcast holds in this process; its file stays, and is read when it is asked again."""
    shared.__dict__.pop("_value", None)


def _judged(batches: Iterator[pa.RecordBatch], column: int, sent: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Pieces of the batches, each with the shard of its texts after all blocks."""
    held: list[tuple[pa.RecordBatch, Shard]] = []

    def through() -> Iterator[tuple[pa.RecordBatch, Shard]]:
        for shared in sent:
            suffixes = shared.value
            for _, shard in held:
                suffixes.mark(shard)
            if len(sent) > 1:
                del suffixes
                _let_go(shared)
        yield from held
        held.clear()

    for batch in batches:
        for part in slices(batch, batch.schema.names[column], SHARD_BYTES):
            held.append((part, Shard(part.column(column).cast(pa.string()))))
            if len(held) >= (HELD_SHARDS if len(sent) > 1 else 1):
                yield from through()
    if held:
        yield from through()


def contaminated(n_words: np.ndarray, n_hit: np.ndarray, share: float = SHARE) -> np.ndarray:
    return (n_hit > 0) & (n_hit * round(1 / share) >= n_words)


def _digest(items: tuple[str, ...]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


RESULT = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, match_item string, match_start long, match_item_start long"
)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: (id_col, *RESULT)."""
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = base.schema[0].dataType.simpleString()
    sent = _sent(benchmark, item_col, item_text_col, window)
    none = (0, -1, None, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard in _judged(batches, 1, sent):
            n_words, n_hit = shard.counts()
            items = [tuple(sorted(shard.items.get(d, ()))) for d in range(shard.n)]
            longest, start, item, place = zip(*(shard.match.get(d, none) for d in range(shard.n)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()), pa.array([_digest(i) for i in items]),
                    pa.array(contaminated(n_words, n_hit)), pa.array([-x for x in longest], pa.int64()),
                    pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(place, pa.int64()),
                ],
                names=[id_col, *(c.split()[0] for c in RESULT.split(", "))],
            )

    return base.mapInArrow(frugal(run), f"`{id_col}` {kind}, {RESULT}")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and without a shuffle."""
    sent = _sent(benchmark, item_col, item_text_col, window)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, shard in _judged(batches, at, sent):
            yield part.filter(pa.array(~contaminated(*shard.counts())))

    return docs.mapInArrow(frugal(run), docs.schema)
