"""Each query with SQL gives the rows of its SQL; the few others run here and are compared with brute force in tests of their own."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if getattr(QUERIES[n], "__module__", "").find(".llm") < 0)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in SQL:
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    cursor = con.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert got == want


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, name):
    compare(spark, sf, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
