"""Embedders: from texts to vectors, on the driver for literals and on executors for columns."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FailedEmbedding


class Embedder(Protocol):
    """Anything with a dimension that turns texts into the rows of a matrix. It must pickle."""

    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Feature hashing of words and of their letter trigrams: no model, no network, the same everywhere.

    A word is hashed once a batch, however often it occurs; texts then are sums over their distinct words.
    """

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def _features(self, word: str) -> Iterator[tuple[int, float]]:
        padded = f"<{word}>"
        for feature, weight in ((word, 1.0), *((padded[i : i + 3], 0.35) for i in range(len(padded) - 2))):
            h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
            yield h % self.dim, weight if h >> 63 else -weight

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        number: dict[str, int] = {}
        rows, words, counts = [], [], []
        for row, text in enumerate(texts):
            own = Counter(re.findall(r"\w+", (text or "").lower()))
            words += [number.setdefault(w, len(number)) for w in own]
            counts += own.values()
            rows += [row] * len(own)
        features = [list(self._features(w)) for w in number]
        length = np.array([len(f) for f in features], np.int64)
        at = np.concatenate([[0], np.cumsum(length)])
        place = np.array([p for f in features for p, _ in f], np.int64)
        weight = np.array([w for f in features for _, w in f])
        rows, words, counts = np.array(rows, np.int64), np.array(words, np.int64), np.array(counts, float)
        out = np.zeros(len(texts) * self.dim)
        for k in range(0, len(words), 1 << 17):
            w = words[k : k + (1 << 17)]
            many = length[w]
            each = np.repeat(at[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cell = np.repeat(rows[k : k + len(w)] * self.dim, many) + place[each]
            out += np.bincount(cell, np.repeat(counts[k : k + len(w)], many) * weight[each], len(out))
        out = out.reshape(len(texts), self.dim)
        # A hair over unit length, so that rounding never cuts a text's distance to itself from -1000 to -999.
        norm = np.linalg.norm(out, axis=1, keepdims=True) * (1 - 1e-12)
        return np.divide(out, norm, out=out, where=norm > 0)


class HttpEmbedder:
    """A service that answers ``{"text": ...}`` with ``{"embedding": [...]}``, and its dimension at ``/dimemb``.

    Each distinct text of a batch is asked once, ``parallel`` requests are under way at a time, and a request
    that fails is sent again ``retries`` times after growing pauses.
    """

    def __init__(
        self, url: str = "http://localhost:7010", path: str = "/embed", dim: int | None = None, timeout: float = 30, parallel: int = 8, retries: int = 3
    ) -> None:
        self.url, self.path, self.timeout, self.parallel, self.retries = url.rstrip("/"), path, timeout, parallel, retries
        self.dim = dim if dim is not None else int(next(iter(self._post("/dimemb", {}).values())))

    def _post(self, path: str, body: dict) -> dict:
        for attempt in range(self.retries + 1):
            request = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except OSError as e:
                refused = isinstance(e, urllib.error.HTTPError) and e.code < 500
                if refused or attempt == self.retries:
                    raise FailedEmbedding(f"{self.url}{path}: {e}") from e
                time.sleep(0.2 * 2**attempt)
        raise AssertionError

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        place: dict[str, int] = {}
        rows = [place.setdefault(t or "", len(place)) for t in texts]
        with ThreadPoolExecutor(self.parallel) as pool:
            found = list(pool.map(lambda t: self._post(self.path, {"text": t})["embedding"], place))
        return np.array(found, float).reshape(len(place), self.dim)[rows]


class ProjectedEmbedder:
    """Another embedder's vectors through a seeded Gaussian projection to ``dim`` dimensions."""

    def __init__(self, inner: Embedder, dim: int = 32, seed: int = 0) -> None:
        self.inner, self.dim = inner, dim
        self.matrix = np.random.default_rng(seed).normal(size=(dim, inner.dim)) / np.sqrt(dim)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return self.inner.embed(texts) @ self.matrix.T


def embed_one(embedder: Embedder, text: str) -> list[float]:
    """The vector of a literal, on the driver."""
    got = np.asarray(embedder.embed([text]), dtype=float)
    if got.shape != (1, embedder.dim):
        raise FailedEmbedding(f"expected a vector of {embedder.dim} numbers, got shape {got.shape}")
    return got[0].tolist()


def embed_column(embedder: Embedder, column: Column | str) -> Column:
    """Vectors of a text column, in Arrow batches on the executors; null becomes the empty text's vector."""

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(embedder.embed(texts.fillna("").tolist()), dtype=float)), index=texts.index)

    return embedded(column)
