"""Every query that has SQL against DuckDB on the smallest tables; the rest must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted(tuple(norm(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


CORE = [q for m in entry.CORE for q in __import__(m, fromlist=["QUERIES"]).QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql := entry.oracle_sql().get(name):
        rel = duck.sql(sql)
        assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", ["case_agreement", "lag2_override"])
def test_readings_are_not_broadcast(spark, sf, name):
    assert "Broadcast" not in entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
