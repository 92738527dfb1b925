"""Registered llm queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fieldcast.llm import queries, sql

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names
    assert set(sql.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    want = con.sql(sql.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.select(*columns).fetchall()))
