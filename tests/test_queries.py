"""Every library query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidewater.plans.catalogue import ORACLES, QUERIES


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    none = lambda v: v is None or v != v or str(v) == "NaT"
    cell = lambda v: "null" if none(v) else repr(float(v) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in ORACLES:
        assert len(got.columns) > 0
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_indicator_document_is_whole(spark, small, duck):
    """One document for each asset, with all its bars, not one for each day."""
    want = duck.execute("SELECT event_type, count(DISTINCT date_trunc('hour', ts)), strftime(max(date_trunc('hour', ts)), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY ALL").fetchall()
    assert sorted((r.symbol, r.n, r.last) for r in QUERIES["indicator_document"](spark, small).collect()) == sorted(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
