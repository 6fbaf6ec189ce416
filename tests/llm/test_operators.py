"""The operators against plain versions, and their defined cases."""

from __future__ import annotations

import pickle
import random
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenq.llm import decontamination, exact_dedup, ngram_join, packing, queries, sharding, suffix_dedup, token_count, toxicity, url_filter

from . import brute

SMALL = "/root/testdata/sf0.001"
#: Nulls, empty texts, repeated rows, one repeated identifier, white space, one long word, non-ASCII.
ODD = [
    (1, None), (2, ""), (3, "Same Text Here"), (4, "same text here"), (4, "same text here"), (5, "   \n"), (None, "no id"), (None, "no id"),
    (6, "x" * 5000), (7, "Größe Élan Ñandú 漢字 кот"), (8, "größe Élan Ñandú 漢字 кот"), (9, "a b c"), (9, "A B C d"),
]
CLASHING = {"kept": "x", "id": 1, "h": 2, "key": "k", "sha": "s", "n": 3, "shard": 4, "size": 5, "host": "h", "verdict": "v", "n_bytes": 6, "part": 7, "length": 8, "source": "a"}


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}) if clash else df


def documents(n=None):
    t = pq.read_table(f"{SMALL}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist()[:n], t["text"].to_pylist()[:n], strict=True))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, keep, digest_bytes):
    rows = ODD + documents(150)
    got = exact_dedup.exact_dedup(frame(spark, rows, clash=True), keep=keep, digest_bytes=digest_bytes, memtable_rows=16)
    want = brute.equal_texts(rows, max if keep == "max" else min)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(frame(spark, ODD).where("doc_id < 0")).count() == 0


def test_index_grows_by_runs(spark):
    index = exact_dedup.DigestIndex("min")
    for start, end in ((5, 10), (0, 7), (3, 4)):
        index.flush(spark.range(start, end).select("id", F.unhex(F.sha2((F.col("id") % 4).cast("string"), 256)).alias("sha")))
    assert len(index.runs) == 3
    keys = spark.range(7).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    want = {i: (i if i < 1 else {1: 1, 2: 2, 3: 3}.get(i), 3 if i in (0, 2, 3) else 4 if i == 1 else None) for i in range(7)}
    assert {r.id: (r.keep_id, r.group_size) for r in index.lookup(keys).collect()} == want
    got = {r.keep_id: r.group_size for r in index.compact().collect()}
    assert got == {0: 3, 1: 4, 2: 3, 3: 3} and len(index.runs) == 1
    assert {r.id: (r.keep_id, r.group_size) for r in index.lookup(keys).collect()} == want
    assert index.compact(least=4).count() == 1


def test_merging_needs_one_pass_over_sorted_entries():
    rnd = random.Random(3)
    entries = sorted((bytes([rnd.randrange(5)]), rnd.randrange(100)) for _ in range(300))
    batches, at = [], 0
    while at < len(entries):
        part = entries[at : at + rnd.randint(0, 40)]
        at += len(part)
        batches.append(pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in part], pa.binary()), "id": pa.array([i for _, i in part], pa.int64()), "n": pa.array([1] * len(part), pa.int64())}))
    got = [r for b in exact_dedup.merged_runs("min")(iter(batches)) for r in b.to_pylist()]
    want = [{"key": k, "id": min(i for x, i in entries if x == k), "n": sum(x == k for x, _ in entries)} for k in sorted({k for k, _ in entries})]
    assert got == want


def test_drop_copies_keeps_one_of_each(spark):
    rows = ODD + documents(80)
    docs = frame(spark, rows, clash=True)
    got = exact_dedup.drop_copies(docs, keep="max")
    assert got.columns == docs.columns
    kept = Counter((r.text or "").translate(brute.LOWER) for r in got.collect())
    assert set(kept) == {(t or "").translate(brute.LOWER) for _, t in rows} and set(kept.values()) == {1}


# ---------------------------------------------------------------- n-gram join


def near_copies(seed=0):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for base in range(6):
        body = [rnd.choice(vocabulary) for _ in range(120)]
        for _ in range(12 if base else 60):
            copy = list(body)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_ngram_join_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rows = near_copies() + [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.ngram_join(frame(spark, rows, clash=True)).collect()}
    assert got == brute.similar(rows)


def test_ngram_join_whole_table(spark):
    got = {r.doc_id: (r.class_id, r.links) for r in queries.op1_ngram_join(spark, SMALL).collect()}
    assert got == brute.similar(documents())


def test_band_plan_reaches_the_recall():
    for t in (0.5, 0.8, 0.95, 0.01, 1):
        bands, rows = ngram_join.band_plan(t, 0.99)
        assert 1 - (1 - t**rows) ** bands >= 0.99 - 1e-9 and (bands * rows <= 128 or rows == 1)


def test_drop_similar_keeps_one_of_each_class(spark):
    rows = near_copies(1) + [(None, "one two three four five six"), (None, "One two three four five SIX"), (5000, None), (5001, "")]
    docs = frame(spark, rows, clash=True)
    got = ngram_join.drop_similar(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len({c for c, _ in brute.similar(rows[:-4]).values()}) + 3
    assert {5000, 5001} <= set(kept)
    assert ngram_join.drop_similar(docs.where("doc_id < 0")).count() == 0


# ---------------------------------------------------------------- decontamination

RESULT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items():
    t = pq.read_table(f"{SMALL}/benchmark.parquet")
    return list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True)) + [(900, "short item"), (901, "same"), (902, ""), (903, None), (12, "of the")]


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 3000])
def test_contamination(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = documents() + ODD
    got = decontamination.find_contamination(frame(spark, rows, clash=True), bench)
    want = brute.contamination(rows, items())
    assert rows_of(got, *RESULT) == sorted(want, key=repr)
    docs = frame(spark, rows, clash=True)
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(repr, rows_of(left, "doc_id"))) == sorted(repr((w[0],)) for w in want if not w[5])


def test_no_suffix_that_could_match_is_left_out():
    """The array without the suffixes that the first words rule out finds what the whole array finds."""
    rnd = random.Random(12)
    for _ in range(60):
        line = lambda n: " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, n)))
        suffixes = decontamination.TestSuffixes([(str(i), line(12)) for i in range(rnd.randint(0, 6))], rnd.randint(1, 6))
        shard = decontamination.Shard(pa.array([line(40) for _ in range(4)], pa.string()))
        some, every = (sorted(zip(*(x.tolist() for x in suffixes.search(shard.h, shard.at, e)[:2]), strict=True)) for e in (False, True))
        assert some == every


def test_words_are_compared_by_their_bytes(monkeypatch):
    """With a hash that is the word's length, only the bytes tell words apart."""
    plain = decontamination.word_hashes

    def short(buf, offs):
        _, start, end, at = plain(buf, offs)
        return (end - start).astype(np.uint64), start, end, at

    monkeypatch.setattr(decontamination, "word_hashes", short)
    suffixes = decontamination.TestSuffixes([("7", "ab abc abcd")], 3)
    shard = decontamination.Shard(pa.array(["x ab abc abcd y", "ab xbc abcd", "AB Abc abcD"], pa.string()))
    assert len(suffixes.search(shard.h, shard.at)[0]) == 3
    suffixes.mark(shard)
    assert shard.counts()[1].tolist() == [3, 0, 3] and set(shard.items) == {0, 2}


def test_a_large_benchmark_is_held_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200_000)
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    bench = [(i, " ".join(rnd.choice(words) for _ in range(400))) for i in range(500)]
    docs = [(i, bench[i][1][50:900] + " and " + " ".join(rnd.choice(words) for _ in range(50))) for i in range(0, 500, 25)]
    sent = decontamination._sent(spark.createDataFrame(bench, "item_id long, text string"), "item_id", "text", 13)
    assert 7 <= len(sent) <= 9 and not any("_value" in s.__dict__ for s in sent)
    assert max(len(pickle.dumps(s.value)) for s in sent) < 20 * 200_000 + (4 << 20)
    got = decontamination.find_contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert rows_of(got, *RESULT) == sorted(brute.contamination(docs, bench), key=repr)


def test_longest_match_and_place(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "a b c " + " ".join(f"w{i}" for i in range(5, 30)) + " d " + " ".join(f"W{i}" for i in range(14))
    got = decontamination.find_contamination(frame(spark, [(1, text)]), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (got.longest_match, got.match_item, got.match_start, got.match_item_start, got.n_hit) == (25, "7", 3, 5, 39)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    got = queries.queries()[name](spark, SMALL)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got, *columns) == sorted(cursor.fetchall(), key=repr)


def test_contamination_without_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.find_contamination(frame(spark, ODD), none)
    assert got.where("n_hit > 0 OR n_items > 0 OR contaminated").count() == 0 and got.count() == len(ODD)
    assert decontamination.find_contamination(frame(spark, ODD).where("doc_id < 0"), none).count() == 0


# ---------------------------------------------------------------- URL filter


def plain_verdict(url, rules):
    _, found, rest = (url or "").partition("://")
    rest = rest if found else ""
    host = rest
    for stop in "/?#":
        host = host.split(stop)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(brute.LOWER)
    rules = [(h.translate(brute.LOWER), p, v) for h, p, v in rules]
    fits = [(len(h + p), v == "block", len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter(spark):
    urls = [r["url"] for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()]
    urls += [None, "", "no scheme", "http://", "HTTP://Example.COM/en/77?x#y", "http://com/en/", "ftp://x.com?/en/", "http://a.com:80/en/", "://net/de/", "http://xnet/de/", "http://a//b://c.org/es/", "http://org\n/es/", "http://ex.com/abcdefgh", "http://ÉX.com/q", "http://Éx.com/q", "http://t.co/a/b/c", "http://u.t.co/a/b/cd"]
    rules = [*queries.URL_RULES, ("com", "/abcdefgh", "allow"), ("ex.com", "/abcde", "block"), ("ÉX.COM", "/", "block"), ("co", "/a/b/", "allow"), ("t.co", "/a/", "block"), ("t.co", "/a/b/c", "allow"), ("net", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
    got = url_filter.judge_urls(df, rules)
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    joined = url_filter.judge_urls_by_join(df, table)
    assert rows_of(joined, "page_id", "host", "path", "rule", "verdict") == rows_of(got, "page_id", "host", "path", "rule", "verdict")
    assert url_filter.judge_urls(df.where("page_id < 0"), rules).count() == 0


def test_many_rules_of_one_host():
    trie = url_filter.UrlTrie((("big.example", f"/p/{i:07d}", "block" if i % 2 else "allow") for i in range(300_000)))
    began = time.perf_counter()
    for i in range(0, 300_000, 30):
        assert trie.match("www.big.example", f"/p/{i:07d}/x")[1] == ("block" if i % 2 else "allow")
    assert time.perf_counter() - began < 2 and trie.match("big.example", "/p/x") is None


# ---------------------------------------------------------------- token counts


def test_automaton_is_greedy():
    rnd = random.Random(2)
    for _ in range(400):
        pieces = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        a = token_count.Automaton(pieces)
        for _ in range(10):
            run = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12)))
            n = a.count(run)
            assert (1 if n is None else n) == brute.longest_match(run, pieces)


def test_token_counts_of_the_table(spark):
    pieces = token_count.load_pieces(queries.VOCABULARY)
    known = set(pieces)
    rows = documents(60) + ODD
    want = [(d, len((t or "").encode().split()), sum(brute.longest_match(b" " + w, known) for w in (t or "").encode().split())) for d, t in rows]
    got = token_count.count_tokens(frame(spark, rows, clash=True), pieces)
    assert rows_of(got, "doc_id", "n_runs", "n_tokens") == sorted(want, key=repr)
    assert token_count.count_tokens(frame(spark, rows).where("doc_id < 0"), pieces).count() == 0


def test_token_counts_of_long_texts(spark, monkeypatch):
    pieces = token_count.load_pieces(queries.VOCABULARY)
    assert 50_000 < token_count.trie_nodes(pieces) == len(token_count.Automaton(pieces).fail) - 1 < token_count.MOST_NODES
    text = "word Größe\t12 \x0b\n\x1c" * 60_000
    small, long_ = (token_count.count_tokens(frame(spark, [(1, t)]), pieces).first() for t in ("word Größe\t12 \x0b\n\x1c" * 2, text))
    assert len(text.encode()) > token_count.LONG_TEXT
    monkeypatch.setattr(token_count, "LONG_TEXT", 0)
    again = token_count.count_tokens(frame(spark, [(1, "word Größe\t12 \x0b\n\x1c" * 2)]), pieces).first()
    assert again == small and long_.n_runs > 180_000 and long_.n_tokens > 180_000
    monkeypatch.setattr(token_count, "MOST_NODES", 10)
    with pytest.raises(ValueError):
        token_count.count_tokens(frame(spark, []), pieces)


def test_remembered_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED_RUNS", 10)
    counts = token_count.Counts(token_count.Automaton([b" ", b"a", b"aa"]))
    assert [counts[b"a" * n] for n in range(1, 40)] == [1 + (n + 1) // 2 for n in range(1, 40)]
    assert len(counts) <= 10


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("group_rows", [4096, 30])
def test_packing(spark, group_rows):
    rnd = random.Random(4)
    rows = [(i, "y" * rnd.choice([0, 5, 60, 99, 100, 101, 350]) + str(i // 3), rnd.choice(["hot", "hot", "a", "b", None])) for i in range(200)]
    rows += [(None, None, None), (7, rows[7][1], "a"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumn("piece", F.lit(1)).withColumn("part", F.lit(1))
    got = packing.pack(df, capacity=100, group_rows=group_rows).collect()
    assert sum(r.length for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    by_id = {i: (t, s) for i, t, s in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length <= b.offset for a, b in zip(held, held[1:], strict=False))
        assert held[0].offset == 0 and held[-1].offset + held[-1].length <= 100
        sources = [by_id[r.doc_id][1] for r in held if r.doc_id not in (3, 7) and by_id[r.doc_id][1]]
        assert len(sources) == len(set(sources))
        texts = [by_id[r.doc_id][0] for r in held if r.doc_id is not None]
        assert len(texts) == len(set(texts))
    assert packing.pack(df.where("doc_id < 0")).count() == 0


def test_bins_take_the_tightest_compatible():
    rnd = random.Random(6)
    rows = [(rnd.randint(1, 60), rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, None, 1, 2])) for _ in range(400)]
    got = list(packing.pack_group(rows, 100))
    residual, held = {}, defaultdict(list)
    for i, _, bin_, offset, length in got:
        _, s, c = rows[i]
        fits = [
            (r, b) for b, r in residual.items()
            if r >= length and not any((s is not None and rows[j][1] == s) or (c is not None and rows[j][2] == c) for j in held[b])
        ]
        if fits:
            assert residual[bin_] == min(fits)[0] and bin_ in {b for _, b in fits}
        else:
            assert bin_ not in residual
        assert offset == 100 - residual.setdefault(bin_, 100)
        residual[bin_] -= length
        held[bin_].append(i)


def test_identical_rows_are_dealt_out(spark):
    docs = spark.range(0, 20_000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    bins = packing.pack(docs, group_rows=1000).withColumn("part", F.shiftright("bin_id", 32))
    sizes = [r.n for r in bins.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 2 * sorted(sizes)[10]
    slots = sharding.shard_rows(docs, 4).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.max("slot").alias("m")).collect()
    assert [(r.n, r.k, r.m) for r in slots] == [(20_000, 20_000, 19_999)]


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("shards", [24, 3])
def test_sharding(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    rows = documents() + ODD + [(i, "hot") for i in range(300, 340)]
    docs = frame(spark, rows, clash=True)
    got = sharding.shard_rows(docs, shards).collect()
    data = lambda t: (t or "").encode()
    want = sorted(((i, len(data(t)) + 8, zlib.crc32(data(t))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    place = defaultdict(set)
    for r in got:
        place[(r["size"], r.text_crc32)].add(r.shard)
    assert all(len(p) == 1 for p in place.values())
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    groups = frame(spark, rows).select(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("b"))
    sizes = [r.b for r in groups.groupBy("h").agg(F.sum("b").alias("b")).orderBy("h").collect()]
    load = Counter()
    for r in got:
        load[r.shard] += r["size"]
    assert {r.capacity for r in got} == {brute.smallest_capacity(sizes, shards)}
    assert max(load.values()) <= got[0].capacity and set(load) <= set(range(shards))


def test_sharding_of_little(spark):
    assert sharding.shard_rows(frame(spark, ODD).where("doc_id < 0")).count() == 0
    assert [r.slot for r in sharding.shard_rows(frame(spark, [(1, "a"), (2, "a")]), 24).orderBy("slot").collect()] == [0, 1]


# ---------------------------------------------------------------- suffix-array dedup

KEPT = ("doc_id", "n_bytes", "n_removed", "n_spans")


@pytest.mark.parametrize("group", [4096, 1])
def test_repeated_bytes(spark, group):
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghé ") for _ in range(n))
    passage, hot = noise(700), noise(450)
    rows = [(i, noise(rnd.randint(0, 900)) + (hot if i % 3 else passage[rnd.randint(0, 300) :]) + noise(rnd.randint(0, 500))) for i in range(40)]
    rows += [(100, "ab" * 500), (101, passage[:399]), (102, passage[:400]), (103, "z" * 900), *ODD, (104, rows[0][1]), (104, rows[0][1])]
    got = suffix_dedup.cut_repeats(frame(spark, rows, clash=True), group_contexts=group)
    got = got.select(*KEPT, F.sha2("kept", 256).alias("kept_sha256"))
    assert rows_of(got, "*") == sorted(brute.repeats(rows), key=repr)


def test_repeats_of_the_table_and_short_length(spark):
    rows = documents(90)
    got = suffix_dedup.cut_repeats(frame(spark, rows), length=60)
    assert rows_of(got.select(*KEPT, F.sha2("kept", 256)), "*") == sorted(brute.repeats(rows, 60), key=repr)
    assert suffix_dedup.cut_repeats(frame(spark, rows).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("pairs", [256, 2])
def test_group_marks(pairs):
    rnd = random.Random(9)
    for _ in range(60):
        n, length = rnd.randint(2, 7), 12
        anchor = b"XYZ"
        back, windows, bodies = [], [], []
        for _ in range(n):
            k, right = rnd.randint(0, 9), rnd.randint(9, 20)
            body = bytes(rnd.choice(b"ab") for _ in range(k)) + anchor + bytes(rnd.choice(b"ab") for _ in range(right))
            back.append(k)
            windows.append(min(k + 1, len(body) - length + 1))
            bodies.append(body[: windows[-1] + length - 1])
        got = suffix_dedup.group_marks(bodies, np.array(back), np.array(windows), length, pairs)
        seen = defaultdict(set)
        for i, b in enumerate(bodies):
            for w in range(windows[i]):
                seen[(back[i] - w, b[w : w + length])].add(i)
        for i, b in enumerate(bodies):
            assert [bool(x) for x in got[i, : windows[i]]] == [len(seen[(back[i] - w, b[w : w + length])]) > 1 for w in range(windows[i])]


# ---------------------------------------------------------------- toxicity


def test_isotonic_rises_and_pools():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=500)
    y = (rnd.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, levels = toxicity.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels.min() and levels.max() <= 1
    assert abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.01


def test_boost_learns_and_repeats():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    base, trees = toxicity.boost(x, y)
    margin = toxicity.Model(base=base, trees=trees).margin(x)
    assert ((margin > 0) == y).mean() > 0.95
    assert np.array_equal(margin, toxicity.Model(base=base, trees=toxicity.boost(x, y)[1]).margin(x))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs.withColumn("score", F.lit(9)), model)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.8 and hit / (rows.predicted == 1).sum() > 0.9
    crc = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect()}
    assert all(crc[r.doc_id] == r.held_out for r in got.select("doc_id", "held_out").collect())
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == got.where("score < 0.3").count()


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, ODD, clash=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1), (3, 0), (3, 0), (9, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, some))
    assert got.count() == len(ODD) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score_toxicity(docs.where("doc_id < 0"), model).count() == 0


def test_features_equal_a_plain_version():
    rnd = random.Random(14)
    marks = ["you", "YOU", "tu", "idiot", "St.u.p.id", "y0u", "aaargh", "Größe", "quxx", "quxxes", "word", "word", "...", "!!", "10", "NO", "x"]
    texts = [" ".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    entries = {toxicity.word_hash(b"word"): 1.5, int(toxicity.mix64(np.array([int.from_bytes(b"\x04quxx", "big")], np.uint64))[0]): 2.5}
    keys = sorted(entries)
    model = toxicity.Model(np.array(keys, np.uint64), np.array([entries[k] for k in keys]))
    odds = lambda w: max([1.5] * (w == "word") + [2.5] * (w.startswith("quxx") and w != "quxx") + [0.0])
    want = np.array([brute.toxicity_features(t, odds, toxicity.INSULTS, toxicity.SECOND_PERSON, toxicity.NEAR) for t in texts])
    assert np.allclose(model.features(pa.array(texts)), want)


def test_features_ignore_company():
    texts = ["You IDIOT!!", "plain words only", None, "", "s.t.u.p.i.d y0u", "u r aaaargh"]
    model = toxicity.Model()
    together = model.features(pa.array(texts, pa.string()))
    alone = np.concatenate([model.features(pa.array([t], pa.string())) for t in texts])
    assert together.shape == (6, toxicity.FEATURES) and np.allclose(together, alone)
