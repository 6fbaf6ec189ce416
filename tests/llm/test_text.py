import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lumenq.llm import _common as c
from lumenq.llm import deep_shallow, suffix_dedup
from lumenq.llm.components import components

from .brute import words


@pytest.mark.parametrize("piece", [1 << 21, 7])
def test_words_are_those_of_the_pattern(monkeypatch, piece):
    monkeypatch.setattr(c, "PIECE_BYTES", piece)
    rnd = random.Random(1)
    known = {}
    for _ in range(200):
        texts = [rnd.choice([None, "", "".join(rnd.choice("aZ9 .é-") for _ in range(rnd.randint(0, 60)))]) for _ in range(rnd.randint(1, 6))]
        buf, offs = c.byte_view(pa.array(texts, pa.string()))
        h, s, e, at = c.word_hashes(buf, offs)
        got = [[bytes(c.LOWER[buf[s[k] : e[k]]]).decode() for k in range(at[i], at[i + 1])] for i in range(len(texts))]
        assert got == [words(t) for t in texts]
        for w, x in zip([w for t in got for w in t], h, strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_deep_shallow_sort():
    rnd = random.Random(3)

    def lcp(a, b):
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    for shallow in (64, 0, 8):
        for _ in range(500):
            start = bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 3, 90])))
            strings = [start[: rnd.choice([200, 2])] + bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 9))]
            order, common = deep_shallow.sort_strings(strings, shallow)
            assert sorted(order) == list(range(len(strings)))
            assert [strings[i] for i in order] == sorted(strings)
            assert common[0] == 0 and all(common[k] == lcp(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(strings)))


def test_filter_has_no_false_negative(spark):
    keys = spark.range(0, 1000, 7).withColumn("h", F.col("id") * 3)
    rows = spark.range(0, 1000).withColumn("h", F.col("id") * 3)
    for bits in (c.FILTER_BITS, 1 << 16):
        got = c.maybe_in(rows, ["id", "h"], c.filter_table(keys, bits), "m", bits)
        assert got.where("id % 7 = 0 AND NOT m").count() == 0
        assert got.where("m").count() < 300
    assert c.maybe_in(rows, ["id"], c.filter_table(keys.where("id < 0").select("id")), "m").where("m").count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 5, 100, 3, 0)] + [None]})
    parts = list(c.slices(batch, "t", 8))
    assert np.concatenate([p.column(0).is_valid() for p in parts]).size == 6
    assert [len(p) for p in parts] == [2, 1, 3]


def test_anchors_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage = noise(300)
    texts = [noise(500) + passage + noise(2000), "", noise(30) + passage + noise(40), "xy" * 900, None, noise(59), noise(60)]
    buf, offs = c.byte_view(pa.array(texts, pa.string()))
    found = []
    for chunk in (1 << 19, 700):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
        a = suffix_dedup.anchors(buf, offs, 60, 8)
        window = {}
        for text, first, windows, back, gram in zip(*(a[k].tolist() for k in ("text", "first", "windows", "back", "gram")), strict=True):
            assert all(offs[text] <= first + k <= offs[text + 1] - 60 for k in (0, windows - 1))
            for k in range(windows):
                assert (text, first + k) not in window
                window[text, first + k] = (gram, back - k)
        found.append(window)
    assert found[0] == found[1]
    assert len(found[0]) == sum(max(0, int(n) - 59) for n in np.diff(offs))
    # Equal strings have their anchors at equal places.
    place = {}
    for (_, p), anchor in found[0].items():
        assert place.setdefault(bytes(buf[p : p + 60]), anchor) == anchor


def test_long_text_is_tokenised_in_pieces():
    text = "word Größe 12 " * 100_000 + "x" * (c.PIECE_BYTES + 10) + " end"
    buf, offs = c.byte_view(pa.array(["a", text, "b"]))
    h, s, e, at = c.word_hashes(buf, offs)
    assert at.tolist() == [0, 1, 300_003, 300_004] and len(set(h.tolist())) == 7
    assert int((e - s).max()) == c.PIECE_BYTES + 10
