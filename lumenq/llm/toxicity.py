"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features come from word hashes and bytes of the whole text: densities of a lexicon (words that labelled
or stems that toxic texts use far more often, each with its log-odds, and a short list of insults), second-person
words and their nearness to lexicon words, capitals, punctuation, and rates of obfuscated spellings.

Fitting sees at most ``SAMPLE_ROWS`` labelled rows, those with the smallest identifier hashes, in three
folds. The features that the trees learn from come from a lexicon of the other folds, and calibration from
margins of trees of the other folds, so neither sees its own labels. Lexicon entries are counted once for
each text, and most near copies of a text not again. Scoring reads every whole text once, without a shuffle.

Defined cases: a null text counts as empty and gets the score of an empty text; a null label or
identifier is not learned from; repeated labels count each; without labels of both kinds every score is
the mean label, or 0 without any; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import IS_WORD, LOWER, byte_view, frugal, mix64, shared_table, slices, word_hash, word_hashes

#: Labelled rows that fitting may see.
SAMPLE_ROWS = 10_000
#: Most entries of the learned lexicon, in how many unlike toxic texts each must stand, the least lower
#: end of its log-odds' interval, and how many standard errors that interval is wide to a side.
LEXICON_WORDS, LEXICON_TEXTS, LEXICON_ODDS, LEXICON_ERRORS = 2_000, 3, 0.9, 2.1
#: Lengths of the stems that stand in a lexicon beside whole words.
STEM_BYTES = (4, 5, 6)
#: Parts of the sample for cross-fitting.
FOLDS = 3
ROUNDS, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 12
NEAR = 5
THRESHOLD = 0.3

# Plain insults and second-person words of four languages.
INSULTS = "idiot idiots stupid moron morons loser losers dumb fool pathetic worthless trash scum clown disgusting hate idiota estúpido imbécil tonto imbécile stupide crétin dummkopf blöd trottel".split()
SECOND_PERSON = "you your yours yourself u ur du dein deine dich dir ihr euch tu toi te ton ta vous votre tú ti usted vosotros".split()

FEATURES = 16


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _table(words: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w.encode()) for w in words], np.uint64))


def _inside(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Model:
    """What scoring needs: lexicon, trees and calibration."""

    lexicon: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.empty(0))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def word_odds(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The largest log-odds among the lexicon entries that each word matches, or 0."""
        odds = np.zeros(len(h))
        if not len(self.lexicon):
            return odds
        low = np.zeros(1 << 16, bool)
        low[(self.lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
        for words, entry in _entries(buf, start, end, h):
            some = np.flatnonzero(low[(entry & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.lexicon, entry[some]), len(self.lexicon) - 1)
            good = self.lexicon[place] == entry[some]
            np.maximum.at(odds, words[some[good]], self.odds[place[good]])
        return odds

    def features(self, texts: pa.Array) -> np.ndarray:
        buf, offs = byte_view(texts)
        h, start, end, at = word_hashes(buf, offs)
        n = np.maximum(np.diff(at), 1)
        size = np.maximum(np.diff(offs), 1)
        odds = self.word_odds(buf, start, end, h)
        toxic = odds > 0
        insult, second = _inside(_table(INSULTS), h), _inside(_table(SECOND_PERSON), h)
        bad = toxic | insult
        # Words of a text within NEAR of a second-person word.
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        near = np.zeros(len(h), bool)
        spots = np.flatnonzero(second)
        for step in range(-NEAR, NEAR + 1):
            to = spots + step
            fits = (to >= 0) & (to < len(h))
            to, fro = to[fits], spots[fits]
            near[to[owner[to] == owner[fro]]] = True
        upper = (buf >= 65) & (buf <= 90)
        letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
        digit = (buf >= 48) & (buf <= 57)
        caps = np.concatenate([[0], np.cumsum(upper)])
        shout = (caps[end] - caps[start] == end - start) & (end - start >= 2)
        digits = np.concatenate([[0], np.cumsum(digit)])
        mixed = (digits[end] - digits[start] > 0) & (digits[end] - digits[start] < end - start)
        # A mark between two letters without white space, and letters three times running.
        mark = ~IS_WORD[LOWER[buf]] & (buf > 32)
        masked = np.zeros(len(buf), bool)
        run3 = np.zeros(len(buf), bool)
        if len(buf) > 2:
            masked[1:-1] = mark[1:-1] & letter[:-2] & letter[2:]
            run3[2:] = letter[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
        hits = _per_text(toxic, at)
        best = np.zeros(len(n))
        if toxic.any():
            np.maximum.at(best, owner[toxic], odds[toxic])
        kinds = np.zeros(len(n))
        if bad.any():
            pairs = np.unique(np.stack([owner[bad].astype(np.uint64), h[bad]]), axis=1)[0]
            kinds = np.bincount(pairs.astype(np.int64), minlength=len(n)).astype(float)
        columns = [
            np.log1p(hits), hits / n, best, _per_text(odds, at) / n, kinds, _per_text(insult, at) / n,
            np.log1p(_per_text(bad & near, at)), _per_text(bad & near, at) / np.maximum(_per_text(bad, at), 1), _per_text(second, at) / n,
            _per_text(upper, offs) / size, _per_text(shout, at) / n, _per_text(buf == 33, offs) / size, _per_text(mark, offs) / size,
            _per_text(mixed, at) / n + _per_text(masked, offs) / n, _per_text(run3, offs) / size, np.log1p(np.diff(at)),
        ]
        return np.stack(columns, axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - (2**DEPTH - 1)]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.interp(self.margin(self.features(texts)), self.knots, self.levels)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(base margin, trees) for the logistic loss; complete trees over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    trees = []
    inner = 2**DEPTH - 1
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = 1e-6
            if len(rows) >= 2 * LEAF:
                g, h = grad[rows], hess[rows]
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = bins[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, None))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                    if gain.max() > best:
                        best, feature[k], limit[k] = gain.max(), f, e[int(np.argmax(gain))]
            right = x[rows, feature[k]] > limit[k]
            node[rows] = 2 * k + 1 + right
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
        margin += value[leaf]
        trees.append((feature, limit, value))
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, levels) of a rising piecewise linear map of margins to 0..1."""
    knots, place = np.unique(margin, return_inverse=True)
    place = place.ravel()
    blocks: list[list[float]] = []
    for k, (s, n) in enumerate(zip(np.bincount(place, y), np.bincount(place), strict=True)):
        blocks.append([s, n, k, k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs, ys = [], []
    for s, n, a, b in blocks:
        for k in (a, b) if a != b else (a,):
            xs.append(knots[int(k)])
            ys.append(s / n)
    return np.array(xs), np.clip(np.array(ys), 0, 1)


def _entries(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of what a lexicon may hold: whole words, and their first bytes as stems."""
    out = [(np.arange(len(h)), h)]
    for size in STEM_BYTES:
        long_ = np.flatnonzero(end - start > size)
        stem = np.full(len(long_), size, np.uint64)
        for k in range(size):
            stem = stem << np.uint64(8) | LOWER[buf[start[long_] + k]].astype(np.uint64)
        out.append((long_, mix64(stem)))
    return out


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, its distinct lexicon entries and its smallest hash of three words running, which
    near copies mostly share."""
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offs = byte_view(part.column("text"))
            h, start, end, at = word_hashes(buf, offs)
            owner = np.repeat(np.arange(len(part)), np.diff(at))
            parts = _entries(buf, start, end, h)
            pairs = np.unique(np.stack([np.concatenate([owner[w] for w, _ in parts]).astype(np.uint64), np.concatenate([e for _, e in parts])]), axis=1)
            cut = np.searchsorted(pairs[0], np.arange(len(part) + 1))
            padded = np.concatenate([h, np.zeros(2, np.uint64)])
            three = mix64(padded[:-2] * np.uint64(3) + padded[1:-1] * np.uint64(5) + padded[2:] * np.uint64(7))
            key = np.array([int(three[a:b].min().view(np.int64)) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(pairs[1].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("fold"), part.column("toxic"), lists], ["key", "fold", "toxic", "entries"])


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int")


def choose_lexicon(words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes in order, log-odds) of the known words that toxic texts surely use more: the lower end of
    the log-odds' interval must reach LEXICON_ODDS."""
    odds = np.log((toxic + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / (clean.sum() + 1))
    low = odds - LEXICON_ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    good = np.flatnonzero(known & (toxic >= LEXICON_TEXTS) & (low >= LEXICON_ODDS))
    good = good[np.lexsort((words[good], -low[good]))][:LEXICON_WORDS]
    good = good[np.argsort(words[good])]
    return words[good], odds[good]


def _lexicons(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """A lexicon without each fold, and the lexicon of all folds."""
    texts = rows.select("text", _fold().alias("fold"), "toxic").mapInArrow(frugal(_seen), "key long, fold int, toxic int, entries array<long>")
    once = texts.groupBy("key", "toxic").agg(F.min_by(F.struct("fold", "entries"), F.struct("fold", F.size("entries"), F.xxhash64("entries"))).alias("t"))
    once = once.select("toxic", "t.fold", F.explode("t.entries").alias("word"))
    sums = [F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{k}{t}") for k in range(FOLDS) for t in (0, 1)]
    counts = once.groupBy("word").agg(*sums)
    toxic = sum(F.col(f"n{k}1") for k in range(FOLDS))
    # Words of no toxic text only enter the totals, as one row.
    known = toxic >= LEXICON_TEXTS
    totals = [F.sum(c).alias(c) for c in counts.columns if c != "word"]
    counts = counts.withColumn("known", known).withColumn("word", F.when(known, F.col("word")).otherwise(0)).groupBy("known", "word").agg(*totals)
    got = counts.toPandas()
    words, known = got["word"].to_numpy(np.int64).view(np.uint64), got["known"].to_numpy(bool)
    out = []
    for left_out in [*range(FOLDS), None]:
        a, b = (sum((got[f"n{k}{t}"].to_numpy(float) for k in range(FOLDS) if k != left_out), np.zeros(len(got))) for t in (1, 0))
        out.append(choose_lexicon(words, a, b, known))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn a model from the labels of rows that are not held out."""
    marked = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    # Bounded by SAMPLE_ROWS, so it may be broadcast to the scans of the texts.
    sample = marked.orderBy(F.xxhash64("id"), "id", "toxic").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(sample), "id"
    )
    # The one scan of the documents for fitting: all else reads the sampled texts.
    rows = shared_table(rows, "toxicity-sample")
    models = [Model(*lexicon) for lexicon in _lexicons(rows)]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fold = part.column("fold").to_numpy()
                every = np.stack([m.features(part.column("text")) for m in shared.value[:FOLDS]])
                x = every[fold, np.arange(len(fold))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("fold"), part.column("toxic"), lists], ["id", "fold", "toxic", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", _fold().alias("fold"), "toxic", "text").mapInArrow(frugal(run), f"id {kind}, fold int, toxic int, x array<double>")
    # At most SAMPLE_ROWS rows (and their repeats) of FEATURES numbers; sorted here, so that fitting repeats.
    got = got.toPandas()
    got = got.iloc[np.lexsort((*np.stack(got["x"]).T, got["toxic"], got["id"]))] if len(got) else got
    model, y = models[-1], got["toxic"].to_numpy(float)
    if len(np.unique(y)) < 2:
        model.levels = np.array([y.mean() if len(y) else 0.0])
        return model
    x, fold = np.stack(got["x"]), got["fold"].to_numpy()
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any():
            base, trees = boost(x[rest], y[rest])
            margin[~rest] = Model(base=base, trees=trees).margin(x[~rest])
    model.base, model.trees = boost(x, y)
    model.knots, model.levels = isotonic(margin, y)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: (id_col, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    [id_col, "held_out", "score", "predicted"],
                )

    return base.mapInArrow(frugal(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                yield part.filter(pa.array(shared.value.score(part.column(at)) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
