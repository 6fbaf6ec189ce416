"""Token counts: greedy longest-match pieces counted by a linear automaton, without building pieces.

The automaton is the vocabulary's trie with a failure link for each node and, precomputed, the number of
pieces popped when the link is taken. A word is read once, byte by byte; each byte adds only what it pops.

A text is cut at ASCII white space. Each run is read with one space before it, so pieces that start with a
space are word beginnings and all others continue a word. A run that the pieces cannot spell counts as one
unknown token. Counts of short runs are remembered, since a corpus repeats them.

Defined cases: a null or empty text has no tokens; a text of any length is read run by run; repeated rows are
counted alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import frugal

#: Nodes of the trie that every worker builds, some 250 bytes each (public vocabularies of 50,000 to 200,000
#: pieces have 0.1 to 0.6 million). Vocabularies are bounded by design; a larger one raises.
MOST_NODES = 2_000_000
#: Bytes from which a text's runs are read one after the other and not as a list.
LONG_TEXT = 1 << 20
#: Longest run whose count is remembered, and how many are.
REMEMBERED_LENGTH, REMEMBERED_RUNS = 48, 400_000


def load_pieces(path: str) -> list[bytes]:
    """The pieces of a file of lines ``base64 rank``, read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def trie_nodes(pieces: Iterable[bytes]) -> int:
    """Nodes of the pieces' trie without its root: what each piece adds to its neighbour in order."""
    n, before = 0, b""
    for piece in sorted(pieces):
        n += len(piece) - len(os.path.commonprefix([before, piece]))
        before = piece
    return n


def runs_of(text: bytes) -> Iterable[bytes]:
    """The runs between ASCII white space."""
    if len(text) < LONG_TEXT:
        return text.split()
    return (m[0] for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text))


class Automaton:
    """Counts greedy longest-match pieces of a byte string in time linear in its length."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.step: dict[int, int] = {}
        ends = [False]
        children: list[list[tuple[int, int]]] = [[]]
        for piece in pieces:
            node = 0
            for byte in piece:
                to = self.step.get(node << 8 | byte)
                if to is None:
                    to = self.step[node << 8 | byte] = len(ends)
                    children[node].append((byte, to))
                    ends.append(False)
                    children.append([])
                node = to
            ends[node] = node > 0
        self.fail = [-1] * len(ends)
        self.pops = [0] * len(ends)
        layer = [0]
        while layer:
            below = []
            for node in layer:
                for byte, child in children[node]:
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.pops[child] = 0, 1
                        continue
                    z, popped = self.fail[node], self.pops[node]
                    while z >= 0 and z << 8 | byte not in self.step:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.pops[child] = self.step[z << 8 | byte], popped
            layer = below

    def count(self, word: bytes) -> int | None:
        """Pieces of ``word``, or None if the pieces cannot spell it."""
        step, fail, pops = self.step, self.fail, self.pops
        node = n = 0
        for byte in word:
            to = step.get(node << 8 | byte)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return None
                to = step.get(node << 8 | byte)
            node = to
        while node > 0:
            n += pops[node]
            node = fail[node]
        return None if node < 0 else n


class Counts(dict):
    """Token counts of runs, computed when first asked for; short runs are remembered up to a bound."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, run: bytes) -> int:
        n = self.automaton.count(b" " + run)
        n = 1 if n is None else n
        if len(run) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_RUNS:
                self.clear()
            self[run] = n
        return n


_BUILT: dict[str, Counts] = {}


def _counts(shared: Broadcast) -> Counts:
    if shared._path not in _BUILT:
        _BUILT.clear()
        _BUILT[shared._path] = Counts(Automaton(shared.value))
    return _BUILT[shared._path]


def count_tokens(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, n_runs, n_tokens). One scan, no shuffle."""
    if trie_nodes(pieces) > MOST_NODES:
        raise ValueError(f"the vocabulary's trie has over {MOST_NODES} nodes")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = base.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(shared).__getitem__
        for batch in batches:
            runs, tokens = [], []
            for text in batch.column("text").cast(pa.binary()):
                n = total = 0
                for n, count in enumerate(map(known, runs_of(text.as_py() or b"")), 1):  # noqa: B007
                    total += count
                runs.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.int64()), pa.array(tokens, pa.int64())], [id_col, "n_runs", "n_tokens"])

    return base.mapInArrow(frugal(run), f"`{id_col}` {kind}, n_runs long, n_tokens long")
