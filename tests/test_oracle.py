"""Every query that has SQL gives the same rows as DuckDB; every other one runs."""

import datetime
import decimal
import math

import pytest

import __spark_entry__ as entry
from glyphkin.plans import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    want = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows_of_numbers(spark, sf, name):
    """What each computes is tested elsewhere; here, that its rows are whole: some, finite, and not all alike."""
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    floats = [v for r in rows for v in r if isinstance(v, float)]
    assert all(math.isfinite(v) for v in floats)
    assert len(rows) == 1 or len({repr(r) for r in rows}) > 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
