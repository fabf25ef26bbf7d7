"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        # Whole numbers with nulls among them come as floats.
        if frame[c].dtype == "float64" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all():
            frame[c] = frame[c].astype("Int64")
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in frame.values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
