"""Readers."""

from __future__ import annotations

import pytest

from lumenq.errors import ParseError
from lumenq.sources import delimited, service
from lumenq.types import TableSchema

SCHEMA = TableSchema.parse("t (name string, age int, rest string)")


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_last_column_keeps_separators(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'name,age,rest\nsam,25.9,"a, b",c\nélan,-3.2,\n')
    rows = sorted(tuple(r) for r in delimited.read_delimited(spark, path, SCHEMA).collect())
    assert rows == [("sam", 25, '"a, b",c'), ("élan", -3, "")]


def test_header_of_each_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        write(tmp_path / "d" / f"{k}.csv", f"name,age,rest\nn{k},{k},r\n")
    assert delimited.read_delimited(spark, str(tmp_path / "d"), SCHEMA).count() == 3
    assert delimited.column_sum(spark, str(tmp_path / "d"), SCHEMA, "age") == 3


def test_trailing_separator(spark, tmp_path):
    path = write(tmp_path / "a.tbl", "x|1|y|\nz|2|w w|\n")
    rows = delimited.read_delimited(spark, path, SCHEMA, "|", header=False, trailing_sep=True)
    assert sorted(tuple(r) for r in rows.collect()) == [("x", 1, "y"), ("z", 2, "w w")]


def test_malformed_lines_raise(spark, tmp_path):
    with pytest.raises(Exception, match="fewer than 3 fields"):
        delimited.read_delimited(spark, write(tmp_path / "a.csv", "h\nonly,1\n"), SCHEMA).collect()
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        delimited.read_delimited(spark, write(tmp_path / "b.csv", "h\nx,notanumber,y\n"), SCHEMA).collect()


def test_strict_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'name,age,rest\n"s, m",25,"say ""hi"""\n')
    assert [(r.name, r.age) for r in delimited.read_csv(spark, path, SCHEMA).collect()] == [("s, m", 25)]


def fetch(i):
    return {"id": i * 2, "url": f"u/{i}", "title": f"T{i}", "articleStart": "text..."}


def test_service(spark):
    rows = service.read_service(spark, fetch, 10, tasks=3).collect()
    assert sorted(r.idx_data for r in rows) == list(range(10)) and all(r.id == 2 * r.idx_data for r in rows)
    drawn = [r.idx_data for r in service.read_service(spark, fetch, 200, random=True, total=1000, seed=5).collect()]
    assert len(set(drawn)) == 200 and max(drawn) < 1000 and sorted(drawn) != list(range(200))
    assert drawn == [r.idx_data for r in service.read_service(spark, fetch, 200, random=True, total=1000, seed=5).collect()]


def test_declarations():
    s = TableSchema.parse("Wiki (idx int, Title varchar(20), body embtext, v embvec)")
    assert s.declaration() == "wiki (idx int, title string, body embtext, v embvec)"
    assert TableSchema.parse(s.declaration()) == s and s.column("BODY").vector == "body__emb" and s.column("idx").vector is None
    for bad in ("x", "x ()", "x (a)", "x (a float)", "x (a int, a int)"):
        with pytest.raises(ParseError):
            TableSchema.parse(bad)
