"""Sessions: SQL surface, changes, transactions, indexes, retrieval, streaming, shell."""

from __future__ import annotations

import numpy as np
import pytest

from lumenq import queries
from lumenq.errors import DuplicateTable, FailedEmbedding, IllegalTransaction, NoSuchTable, ParseError, TransactionConflict, TypeMismatch
from lumenq.functions.embedding import HashEmbedder, ProjectedEmbedder, embed_one
from lumenq.operators.farthest import farthest_in_group
from lumenq.operators.kmeans import fit_kmeans
from lumenq.session import Session
from lumenq.shell import Shell
from lumenq.sources.scratch import scratch
from lumenq.timing import benchmark
from lumenq.types import CID

CREW = [
    ("ines", 31), ("tomas", 47), ("ruth", 28), ("olek", 19), ("vera", 52), ("hugo", 36), ("ines", 64), ("dana", 28),
    ("bruno", 71), ("mina", 44), ("olek", 58),
]
TRADES = ["baker", "welder", "diver", "printer", "miner"]


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    s = Session(spark, f"file://{tmp_path_factory.mktemp('db')}", HashEmbedder(48))
    s.load_catalog("crew (name string, age int)\nguests (name string, age int)\nlives (name string, age int, story embtext)")
    people = spark.createDataFrame(CREW, "name string, age long").coalesce(1)
    s.insert("crew", people)
    s.insert("guests", people)
    rows = [(n, a, f"{n} has been a {TRADES[i % 5]} for {a - 15} years") for i, (n, a) in enumerate(CREW)]
    s.insert("lives", spark.createDataFrame(rows, "name string, age long, story string").coalesce(1))
    return s


@pytest.fixture
def fresh(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db", HashEmbedder(48))
    s.create_table("p (id int, what string, words embtext)")
    rows = [(i, f"k{i % 4}", f"word{i % 7} and word{i % 5} number {i}") for i in range(60)]
    s.insert("p", spark.createDataFrame(rows, "id long, what string, words string").coalesce(2))
    return s


def ask(s, sql):
    return [tuple(r) for r in s.sql(sql).collect()]


# ---------------------------------------------------------------- statements


def test_statements(db):
    ages = [a for _, a in CREW]
    assert ask(db, "select sum(age * 2 - 1), count(age) from crew") == [(2 * sum(ages) - len(ages), len(ages))]
    assert ask(db, "select max(age) - min(age) spread from crew") == [(max(ages) - min(ages),)]
    assert len(ask(db, "select * from crew limit 2*2")) == 4
    assert set(ask(db, "select sq(imax(3, 2)) from crew")) == {(9,)}
    assert set(ask(db, "select 'k', age from crew")) == {("k", a) for a in ages}
    assert dict(ask(db, "select c.name, max(age) oldest from crew c group by c.name"))["ines"] == 64
    nested = "select n from (select inner1.name n from (select crew.name from crew where age > 40) inner1) outer1 order by n desc"
    assert ask(db, nested) == sorted(((n,) for n, a in CREW if a > 40), reverse=True)
    assert dict(ask(db, "select age / 10, count(*) from crew group by age / 10"))[2] == 2
    got = ask(db, "select c.name, g.age from crew c join guests g on c.name = g.name, guests as h where g.age = h.age and c.age <> g.age order by g.age, c.name")
    want = sorted(((n, b) for n, a in CREW for m, b in CREW for _, e in CREW if n == m and b == e and a != b), key=lambda r: (r[1], r[0]))
    assert got == want
    years = ask(db, "select name, getsubstr(epochtodatetimestring(age * 31557600 + 864000), 24, 4) y from crew")
    assert sorted(y for _, y in years) == sorted(str(1970 + a) for a in ages)
    assert db.sql("select * from lives").columns == ["name", "age", "story"]
    assert "story__emb" in db.sql("select * from lives", vectors=True).columns
    assert len(ask(db, "select name, story from lives where age < 60")) == sum(a < 60 for a in ages)


def test_compatible_values(db):
    assert ask(db, "select avg(age), max(age), min(name), count(*) from crew where age > 1000") == [(0, 0, "", 0)]
    assert ask(db, "select max(age) + 1 a, coalesce(min(name), 'x') b from crew where age > 1000") == [(1, "")]
    assert ask(db, "select t.m + 2 from (select max(age) m from crew where age > 1000) t") == [(2,)]
    mean = sum(a for _, a in CREW) // len(CREW)
    assert ask(db, "select avg(age), sum(age)/count(*) from crew") == [(mean, mean)]
    assert sorted(ask(db, "select name from crew where name like 'i%s'")) == [("ines",), ("ines",)]
    assert ask(db, "select name from crew where name like 'in_s'") == []
    assert sorted(ask(db, 'select name from crew where name = "dana"')) == [("dana",)]
    assert ask(db, "select count(distinct name) n from crew where age > 20 or not name in ('x') having count(*) > 1") == [(9,)]


def test_only_aggregates_of_nothing_become_zero(spark, db):
    spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k long, v long").createOrReplaceTempView("some_values")
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long").createOrReplaceTempView("some_keys")
    joined = "from some_keys a left join some_values b on a.k = b.k order by a.k"
    assert ask(db, f"select b.v, sum(a.k) over (partition by 1) t {joined}") == [(5, 10), (None, 10), (7, 10), (None, 10)]
    assert ask(db, f"select b.v, avg(a.k) over (partition by a.k % 2) t {joined}") == [(5, 2), (None, 3), (7, 2), (None, 3)]
    assert ask(db, f"select b.v, (select max(age) from crew) t {joined}") == [(5, 71), (None, 71), (7, 71), (None, 71)]
    assert ask(db, "select k, max(v) m from some_values where k = 2 group by k") == [(2, None)]
    assert ask(db, "select max(v) m, min(v) filter (where k > 9) f from some_values where k = 2") == [(0, 0)]


def test_standard_dialect(spark, db):
    s = Session(spark, db.catalog.storage.root, db.embedder, compat=False)
    assert ask(s, "select avg(age), 1/2 from crew")[0][1] == 0.5
    assert ask(s, "select max(age) from crew where age > 1000") == [(None,)]
    assert len(ask(s, "select name from crew where name like 'in_s'")) == 2


def test_semantic_operators(db):
    near = ask(db, "select name, (story semlike 'dana has been a diver for 13 years') sim from lives order by sim, name limit 1")
    assert near[0][0] == "dana" and near[0][1] <= -999
    assert ask(db, "select max(story semlike story) from lives")[0][0] <= -999
    assert ask(db, "select name from lives where (story semlike 'dana has been a diver for 13 years') < -999") == [("dana",)]
    assert ask(db, "select count(*) from lives where ('ruth is a diver' semlike story) <= 1000") == [(11,)]
    assert ask(db, "select max(a.story semlike b.story) from lives a join lives b on a.name = b.name where a.age = b.age")[0][0] <= -999
    assert {r[0] for r in ask(db, "select story semlike_cos story from lives")} <= {0, 1}
    a, b = ask(db, "select semlike(story, 'x y') f, (story semlike 'x y') g from lives limit 1")[0]
    assert a == b
    assert ask(db, "select 'it''s' semlike 'it\\'s' d from lives limit 1")[0][0] <= -999
    with pytest.raises(TypeMismatch):
        db.sql("select story semlike 5 from lives")
    with pytest.raises(ParseError):
        db.sql("select semlike 'x' from lives")
    with pytest.raises(ParseError):
        db.sql("select (story semlike 'x' from lives")


def test_own_keywords(spark, db):
    s = Session(spark, db.catalog.storage.root, db.embedder, keywords={"resembles": "semlike", "resembles_cos": "semlike_cos"})
    own, other = (ask(x, f"select name, (story {k} 'a miner') d, (story {k}_cos 'a miner') c from lives order by d, name limit 4") for x, k in ((db, "semlike"), (s, "RESEMBLES")))
    assert own == other
    with pytest.raises(ParseError):
        Session(spark, db.catalog.storage.root, db.embedder, keywords={"x": "y"})


def test_vectors_follow_derived_tables(db):
    inner = "(select name n, story, age from lives where age < 40)"
    near = ask(db, f"select n, (x.story semlike 'dana has been a diver for 13 years') d from {inner} x order by d, n limit 1")
    assert near[0][0] == "dana" and near[0][1] <= -999
    two = "(select y.b about from (select story b from lives) y)"
    assert ask(db, f"select min(z.about semlike 'dana has been a diver for 13 years') m from {two} z")[0][0] <= -999
    assert len(ask(db, "select u.name from (select story name from lives) u, (select name from crew limit 1) v")) == 11
    assert db.sql(f"select * from {inner} x").columns == ["n", "story", "age"]
    assert db.sql("select * from (select distinct name, story from lives) x").columns == ["name", "story"]
    joined = f"select a.n, (a.story semlike b.story) d from {inner} a join {inner} b on a.n = b.n and a.age = b.age order by d limit 1"
    assert ask(db, joined)[0][1] <= -999


def test_catalog_text_is_lossless(spark, db):
    text = db.catalog.text()
    assert "story embtext" in text
    s = Session(spark, db.catalog.storage.root + "/other", db.embedder)
    assert s.load_catalog(text) == ["crew", "guests", "lives"] and s.catalog.text() == text


# ---------------------------------------------------------------- changes and transactions


def test_insert_and_delete(fresh):
    assert ask(fresh, "insert into p values (100, '5', 'a'), ('101', 'b', 'c')") == [(2,)]
    assert ask(fresh, "insert into p select id + 200, what, words from p where id < 3") == [(3,)]
    assert ask(fresh, "select count(*) from p") == [(65,)]
    assert ask(fresh, "delete from p where id >= 100 and what <> 'k0'") == [(4,)]
    assert ask(fresh, "delete from p where (words semlike 'word3 and word3 number 3') < -990") == [(1,)]
    assert ask(fresh, "delete from p where p.id = 12345") == [(0,)]
    assert ask(fresh, "select count(*), max(id) from p") == [(60, 200)]
    assert ask(fresh, "delete from p") == [(60,)] and ask(fresh, "select count(*) from p") == [(0,)]
    assert ask(fresh, "insert into p values (1, 'x', 'y')") == [(1,)] and ask(fresh, "select id from p") == [(1,)]


@pytest.mark.parametrize("kind", [None, "secondary", "clustered"])
def test_delete_over_many_parts(fresh, kind):
    if kind:
        fresh.create_index("p", "words", 4, kind)
    for k in range(3):
        fresh.sql(f"insert into p values ({100 + k}, 'x', 'word{k}'), ({200 + k}, 'y', 'word{k}')")
    before = fresh.catalog.entry("p")["parts"]
    assert len(before) == 4
    assert ask(fresh, "delete from p where id in (100, 102)") == [(2,)]
    after = fresh.catalog.entry("p")["parts"]
    # Parts without deleted rows stay as they are, and the rest of the others is one part.
    assert [x for x in after if x in before] == [before[0], before[2]] and len(after) == 3
    assert ask(fresh, "delete from p where what in ('x', 'y')") == [(4,)]
    assert fresh.catalog.entry("p")["parts"] == [before[0]] and fresh.catalog.entry("p")["rows"] == 60
    assert sorted(r[0] for r in fresh.table("p").select("id").collect()) == list(range(60))
    if kind:
        assert fresh.index("p", "words").postings.count() == 60


@pytest.mark.parametrize("kind", ["secondary", "clustered"])
def test_columns_named_like_folders(fresh, kind):
    fresh.sql("create table q (part int, cid int, words embtext)")
    fresh.sql("insert into q values (1, 10, 'sea'), (2, 20, 'hill'), (3, null, 'sea and hill')")
    fresh.create_index("q", "words", 2, kind)
    fresh.sql("insert into q values (4, 40, 'river')")
    assert ask(fresh, "delete from q where part = 2") == [(1,)]
    assert ask(fresh, "select part, cid from q order by part") == [(1, 10), (3, None), (4, 40)]
    assert ask(fresh, "select part, cid, (words semlike 'river') d from q order by d limit 1")[0][:2] == (4, 40)
    with pytest.raises(ParseError):
        fresh.sql("create table r (_rid int)")
    with pytest.raises(ParseError):
        fresh.sql("create table r (a embtext, a__emb embvec)")


def test_wrong_statements(fresh):
    with pytest.raises(TypeMismatch):
        fresh.sql("insert into p values (1, 'x')")
    with pytest.raises(ParseError):
        fresh.sql("insert into p (id) values (1)")
    with pytest.raises(NoSuchTable):
        fresh.sql("insert into q values (1)")
    with pytest.raises(DuplicateTable):
        fresh.sql("create table p (id int)")
    with pytest.raises(ParseError):
        fresh.sql("create table q (id float)")
    with pytest.raises(ParseError):
        fresh.sql(" ; ")


def test_create_and_drop(fresh):
    fresh.sql("create table q (id int, v embvec)")
    fresh.sql("insert into q values (1, array(1.0, 2.0)), (2, array(0.5, -1.0))")
    assert ask(fresh, "select id, vec_norm2(v) n from q order by id") == [(1, 5.0), (2, 1.25)]
    assert ask(fresh, "select a.id x, b.id y, (a.v semlike b.v) d from q a join q b on a.id < b.id") == [(1, 2, 1500)]
    fresh.sql("drop table q")
    assert fresh.catalog.names() == ["p"]


def test_transactions(spark, fresh):
    other = Session(spark, fresh.catalog.storage.root, fresh.embedder)
    fresh.sql("begin")
    fresh.sql("delete from p where id < 30")
    assert fresh.table("p").count() == 30 and other.table("p").count() == 60
    fresh.sql("rollback")
    assert fresh.table("p").count() == 60
    fresh.sql("begin")
    fresh.sql("insert into p values (900, 'a', 'b')")
    other.sql("delete from p where id = 1")
    with pytest.raises(TransactionConflict):
        fresh.sql("commit")
    assert fresh.table("p").count() == 59 and not fresh.catalog.in_transaction
    with pytest.raises(IllegalTransaction):
        fresh.sql("commit")
    fresh.sql("begin")
    with pytest.raises(IllegalTransaction):
        fresh.sql("begin")
    fresh.sql("commit")


def test_transactions_on_other_tables_merge(spark, fresh):
    other = Session(spark, fresh.catalog.storage.root, fresh.embedder)
    fresh.begin()
    fresh.sql("insert into p values (900, 'a', 'b')")
    other.sql("create table q (id int)")
    fresh.commit()
    assert fresh.catalog.names() == ["p", "q"] and fresh.table("p").count() == 61
    fresh.begin()
    fresh.sql("insert into p values (901, 'a', 'b')")
    other.sql("insert into q values (1)")
    with pytest.raises(TransactionConflict):
        fresh.commit(serializable_reads={"q"})


def test_vacuum_keeps_what_is_used(fresh):
    fresh.create_index("p", "words", 4)
    fresh.sql("delete from p where id < 10")
    assert fresh.vacuum() > 0
    assert fresh.table("p").count() == 50 and len(ask(fresh, "select id, (words semlike 'word1') d from p order by d limit 3")) == 3


# ---------------------------------------------------------------- indexes


@pytest.mark.parametrize("kind", ["secondary", "clustered"])
def test_index_serves_the_statements_it_may(fresh, kind):
    exact = ask(fresh, "select id, (words semlike 'word1 and word2') d from p order by d, id limit 59")
    fresh.create_index("p", "words", 6, kind)
    near = "nearest-neighbour scan"
    assert ask(fresh, "select id, (words semlike 'word1 and word2') d from p order by d, id limit 59") == exact
    assert fresh.last_plan.startswith(near) and "6 of 6" in fresh.last_plan
    for sql in (
        "select id, what, words, ('word1' semlike words) dist from p order by dist limit 2",
        "select id, (words semlike 'word1') sim from p order by sim desc, what limit 5",
        "select x.id, (x.words semlike 'word1') as sim from p x order by sim limit 1+1",
        "select max(words semlike 'word1') from p", "select min(words semlike 'word1') from p",
    ):
        fresh.sql(sql).collect()
        assert fresh.last_plan.startswith(near), sql
    for sql in (
        "select count(*) from p", "select * from p limit 10", "select id, (words semlike 'word1') sim from p order by what, sim desc limit 5",
        "select id, (words semlike 'word1') sim from p where what = 'k1' order by sim limit 5", "select id, (words semlike words) sim from p order by sim limit 5",
        "select max(words semlike 'a'), min(words semlike 'b') from p", "select sum(words semlike 'a') from p", "select distinct id, (words semlike 'a') d from p order by d limit 3",
        "select id, (words semlike 'word1') sim from p order by sim",
    ):
        fresh.sql(sql).collect()
        assert fresh.last_plan == "exact scan", sql
    best = ask(fresh, "select min(words semlike 'word1 and word1 number 1') from p")[0][0]
    assert best <= -999
    text = fresh.sql("explain select id, (words semlike 'word1') d from p order by d limit 2").first()[0]
    assert near in text and "PartitionFilters" in text and "_cid" in text
    assert near not in fresh.sql("explain select id from p").first()[0]


@pytest.mark.parametrize("kind", ["secondary", "clustered"])
def test_index_follows_changes(spark, fresh, kind):
    fresh.create_index("p", "words", 5, kind)
    filed = lambda: fresh.index("p", "words").postings
    assert filed().count() == 60 and filed().select(CID).distinct().count() <= 5
    fresh.sql("insert into p values (500, 'new', 'zebra zebra zebra')")
    assert filed().count() == 61
    assert ask(fresh, "select id, (words semlike 'zebra') d from p order by d limit 1")[0][0] == 500
    fresh.sql("delete from p where id = 500 or id < 5")
    assert filed().count() == 55 == fresh.table("p").count()
    again = Session(spark, fresh.catalog.storage.root, fresh.embedder)
    assert again.index("p", "words").kind == kind
    sizes = ask(again, f"select centroidid, count(indexpageno) n from {kind}__p__words__mapping group by centroidid")
    assert len(sizes) == filed().select(CID).distinct().count()
    assert len(ask(again, f"select * from {kind}__p__words__centroids")) == 5
    assert len(ask(again, "select * from p__words__data")) == 55


def test_probing_more_never_loses(fresh):
    fresh.create_index("p", "words", 8)
    index, q = fresh.index("p", "words"), embed_one(fresh.embedder, "word2 and word4 number 9")
    exact = [r["dist"] for r in index.search(q, 10, probe=8).collect()]
    found = [sum(r["dist"] <= exact[-1] for r in index.search(q, 10, probe=p).collect()) for p in (1, 3, 8)]
    assert found == sorted(found) and found[-1] == 10


def test_limit_rows_come_from_skewed_clusters(spark, tmp_path):
    """All rows but a few lie in one cluster; the empty ones near the query must not use up the probes."""
    from lumenq.operators.ivf import IvfIndex

    rows = [(i, [1.0, 0.01 * i]) for i in range(8)] + [(100 + i, [-1.0, 0.001 * i]) for i in range(92)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    for kind in ("secondary", "clustered"):
        index = IvfIndex.build(df, f"file://{tmp_path}/{kind}", "v", "id", 8, kind, 0)
        for limit in (5, 20, 99):
            assert index.search([1.0, 0.0], limit).count() == limit == index.candidates([1.0, 0.0], limit).limit(limit).count()


def test_services(spark):
    import threading

    from lumenq.functions.embedding import HttpEmbedder
    from lumenq.sources import server, service

    items = [{"id": i, "url": f"u{i}", "title": f"t{i}", "text": "words " * i} for i in range(5)]
    http = server.serve(server.embedding_routes(HashEmbedder(16)) | server.item_routes(items))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{http.server_address[1]}"
        e = HttpEmbedder(url, retries=0)
        texts = ["a b", "c", "a b", "", None]
        assert e.dim == 16 and np.allclose(e.embed(texts), HashEmbedder(16).embed(texts)) and e.embed([]).shape == (0, 16)
        got = service.read_service(spark, service.HttpFetch(url, 10), 5).orderBy("id").collect()
        assert [r.articlestart for r in got] == [(("words " * i)[: max(0, min(6 * i, 10) - 3)] + "...") for i in range(5)]
        assert e._post("/dataitemfull", {"idx": 2})["dataelement"]["text"] == "words words " and e._post("/descriptor", {})["descriptor"][0] == "id"
        for path, body in (("/nothing", {}), ("/embed", {}), ("/dataitem", {"idx": 99, "char_length": 5})):
            with pytest.raises(FailedEmbedding):
                e._post(path, body)
    finally:
        http.shutdown()


def test_user_aggregates(spark):
    from lumenq.functions.user_aggregates import aggregate
    from lumenq.queries import SumOfSquares

    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", None), (None, 4)], "k string, v int").repartition(3)
    assert {tuple(r) for r in aggregate(df, ["k"], "v", SumOfSquares(), "long", "s").collect()} == {("a", 5), (None, 25), ("b", 0)}
    assert [r.s for r in aggregate(df, [], "v", SumOfSquares(), "long", "s").collect()] == [30]
    assert [r.s for r in aggregate(df.where("v > 9"), [], "v", SumOfSquares(), "long", "s").collect()] == [0]


def test_kmeans(spark):
    points = [(1.0, -1.0), (-1.0, 1.0), (1.0, 1.5), (-2.0, -1.0), (-1.0, 1.0), (-1.0, 3.0), (-1.0, -2.0), (-1.0, -1.0)]
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "id long, v array<double>")
    model = fit_kmeans(df, "v", 4, "id")
    assert model.centroids.shape == (4, 2) and model.iterations == 10
    assert np.array_equal(model.centroids, fit_kmeans(df.repartition(3), "v", 4, "id").centroids)

    def loss(n):
        c = fit_kmeans(df, "v", 3, "id", n, "euclidean").centroids
        return sum(min(((np.array(p) - m) ** 2).sum() for m in c) for p in points)

    losses = [loss(n) for n in (0, 1, 2, 5)]
    assert losses == sorted(losses, reverse=True)
    assert fit_kmeans(df, "v", 3, "id", 10, "euclidean", tol=1e-9).iterations < 10
    assert fit_kmeans(df.where("id < 0"), "v", 3, "id").centroids.size == 0


# ---------------------------------------------------------------- embedders, retrieval, streams, shell


def test_embedders():
    e = HashEmbedder(64)
    a, b, c = e.embed(["the red house", "the red houses", "quantum theory"])
    assert np.isclose(a @ a, 1) and a @ b > a @ c and np.array_equal(e.embed([""])[0], np.zeros(64))
    p = ProjectedEmbedder(e, 16, seed=0)
    assert p.embed(["x", "y"]).shape == (2, 16) and np.array_equal(p.embed(["x"]), ProjectedEmbedder(e, 16, 0).embed(["x"]))


def test_retrieval(db):
    rows = db.retrieve("dana has been a diver for 13 years", "lives", "name", "story", 2).collect()
    assert rows[0]["name"] == "dana" and len(rows) == 2
    seen = []
    assert db.fact_check("dana's work: 'diver'", "lives", "name", "story", lambda p: seen.append(p) or "yes") == "yes"
    assert "\n---------\ndana: \n\ndana has been" in seen[0]
    db.fact_check("x", "lives", "name", "story", lambda p: seen.append(p) or "", use_context=False)
    assert "---------" not in seen[1]


def test_stream_is_added_once(spark, fresh, tmp_path):
    from lumenq.streaming.ingest import stream_into

    fresh.create_index("p", "words", 3)
    source = spark.createDataFrame([(700 + i, "s", f"streamed {i}") for i in range(5)], "id long, what string, words string")
    source.write.parquet(f"file://{tmp_path}/in")
    for checkpoint in ("a", "a", "b"):
        stream = spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")
        stream_into(fresh, "p", stream, f"file://{tmp_path}/{checkpoint}", "feed").awaitTermination()
    assert fresh.table("p").count() == 65 == fresh.index("p", "words").postings.count()


def test_shell(db, tmp_path):
    shell = Shell(db)
    assert "\\i TABLE" in shell.handle("\\h") and "lives (name" in shell.handle("\\d") and "getsubstr" in shell.handle("\\f")
    assert shell.handle("select name") == ""
    out = shell.handle("from crew where age = 52;")
    assert "vera" in out and "(1 results)" in out
    assert shell.handle("\\a") == "Output unaligned" and shell.handle("select name, age from crew where age = 52;").startswith("name,age\nvera,52")
    assert shell.handle("select nothing from nowhere;").startswith("error")
    (tmp_path / "c.txt").write_text("u (name string, age int)\n")
    (tmp_path / "u.csv").write_text("name,age\nx,1\ny,2.9\n")
    assert "u (name string, age int)" in shell.handle(f"\\c {tmp_path}/c.txt")
    assert shell.handle(f"\\l u {tmp_path}/u.csv") == "LOAD 2"
    assert shell.handle("select age from u order by age;").startswith("age\n1\n2\n")
    assert shell.handle("\\i lives story 3 secondary") == "INDEX"
    shell.aligned = True
    assert "dana" in shell.handle("\\r dana has been a diver for 13 years | lives | name | story | false")
    assert "== nearest-neighbour scan" in shell.handle("explain select name, (story semlike 'x') d from lives order by d limit 1;")


def test_benchmark_keeps_figures(spark, tmp_path):
    path = str(tmp_path / "timings.csv")
    for _ in range(2):
        got = benchmark({"range": lambda: spark.range(10)}, path)
    assert got["range"] > 0 and len(open(path).read().splitlines()) == 3


def test_dates_and_bytes(db):
    sql = "select datestringtoepoch('1970-01-02') a, datestringtoepoch('nope') b, datestringtoepoch('1970-1-2') c, epochtodatetimestring(0) d, datetimestringtoepoch('Thu Jan  1 00:01:00 UTC 1970') e, datetimestringtoepoch('x') f, getsubstr('hello', 1, 3) g, getsubstr('hi', 2, 5) h, getsubstr('hi', 3, 1) i, mod(0-7, 2) j, (0-7)/2 k, imin(1,2) l, imax(1,2) m from crew limit 1"
    assert ask(db, sql) == [(86400, 0, 0, "Thu Jan  1 00:00:00 UTC 1970", 60, 0, "ell", "", "", -1, -3, 1, 2)]
    assert ask(db, "select rand() >= 0 r, epoch() > 1600000000 e from crew limit 1") == [(True, True)]


def _plain_farthest(rows):
    """By pairs, added in order, as ``sem_dist`` does."""
    def dist(x, y):
        dot = 0.0
        for a, b in zip(x, y, strict=True):
            dot += a * b
        return int(-dot * 1000)

    good = {i: v for i, _, v in rows if v is not None and None not in v}
    return sorted((i, g, max((dist(good[i], good[j]) for j, h, _ in rows if h == g and j in good and len(good[j]) == len(good[i])), default=None) if i in good else None)
                  for i, g, _ in rows if g is not None)


@pytest.mark.parametrize("block", [7, 4096])
def test_farthest_in_group(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), rng.normal(size=6).tolist()) for i in range(90)]
    rows += [(100 + i, 1, rows[0][2]) for i in range(40)]  # copies
    rows += [(200 + i, 4, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(60)]  # distances on the cut
    rows += [(300 + i, 5, (rng.integers(-9, 10, 6) / 10).tolist()) for i in range(60)]  # sums whose rounding decides
    rows += [(400, 6, [0.0] * 6), (401, None, [1.0] * 6), (402, 1, None), (403, 1, [1.0, None, 1.0]), (404, 1, [2.0]), (405, 1, []), (406, 7, None), (407, -8, [0.1])]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    got = farthest_in_group(df, "g", "v", block=block).select("id", "g", "far")
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain_farthest(rows), key=key)


def test_farthest_takes_no_row_for_a_pair(spark):
    """One group of 12,000 different vectors: 144 million pairs, but no rows for them."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12_000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x, 3) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>, label int")
    path = scratch(spark)
    df.write.parquet(path + "/embeddings.parquet")
    query = queries.sem_self_join(spark, path)
    assert "MapInArrow" in query._jdf.queryExecution().executedPlan().toString()
    got = query.orderBy("vec_id").toPandas()
    wide = v.astype(np.float64)
    want = np.concatenate([np.trunc(-(wide[s : s + 1000] @ wide.T).min(axis=1) * 1000) for s in range(0, len(v), 1000)])
    assert got.far.tolist() == want.tolist()


def test_farthest_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, 1, [1e10]), (2, 1, [-1e10])], "id long, g int, v array<double>")
    with pytest.raises(Exception, match="64-bit"):
        farthest_in_group(df, "g", "v").collect()
