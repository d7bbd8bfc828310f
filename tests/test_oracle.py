"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import pytest

from cutframe import queries as frames
from cutframe.oracle import ORACLE


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf, name):
    got = frames.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(a) == len(b) and a == b


def test_every_query_has_sql_or_a_test():
    assert set(frames.QUERIES) == set(ORACLE)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["video_id", "range_idx", "start_frame", "end_frame", "start_sec", "end_sec"]
