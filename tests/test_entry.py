"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenq import queries

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in (*queries.TABLES, "conversations"):
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_engine_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    cursor = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["vec_id", "label", "dist"] and entry.entry(spark).count() == 10


def test_names():
    every, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(every) and set(queries.QUERIES) <= set(every)
    assert not any(hasattr(f, "llm") for f in queries.QUERIES.values())


def test_epoch_strings_of_far_years(spark, tmp_path):
    # Years before 1, to 9999, after it, and from 20237 on, where the SQL's seconds are rounded as a double.
    con = duckdb.connect()
    keys = [-3_000_000, -800_000, -719_893, -719_528, -354_285, 0, 2_932_896, 2_932_897, 6_671_999, *range(8_999_990, 9_000_000), 106_751_990]
    con.execute("CREATE TABLE orders AS SELECT CAST(unnest(?) AS BIGINT) AS o_orderkey", [keys])
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = queries.QUERIES["fn_epoch_string"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE["fn_epoch_string"]).fetchall())
    parsed = [f"datetimestringtoepoch('Sat Jan  1 00:00:00 UTC {y}')" for y in ("970", "10000", "+10000", "300000", "99999999999")]
    assert tuple(spark.sql("SELECT " + ", ".join(parsed)).first()) == (0, 253402300800, 253402300800, 9404918380800, 0)
