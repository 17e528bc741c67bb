"""Every query with an SQL twin equals it on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from motionloom.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(v) if hasattr(v, "as_tuple") else v


def key(row):
    return tuple((v is None, "" if isinstance(v, (int, float)) else str(type(v)), 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert got == want


def test_every_query_is_registered():
    assert len(catalog.QUERIES) == 179
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "signal_quality" in df.columns and "acc_mag_dominant_hz" in df.columns
