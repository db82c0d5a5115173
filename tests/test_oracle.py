"""Every query with SQL gives the same rows as DuckDB."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rank(row):
    return [(x is None, str(x)) for x in row]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=rank)
    cur = con.execute(SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in cur.fetchall()), key=rank)
    assert got == want


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "strandline")
    for where, _, files in os.walk(root):
        if f"{os.sep}llm" not in where:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(where, f), encoding="utf-8") as text:
                        assert "strandline.llm" not in text.read(), f
