"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sloscope import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def tidy(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name.startswith(("slo_alerts", "anomal", "zscore_anom", "stream_anom", "detector"))
    if name in queries.ORACLES:
        want = tables.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert tidy(rows, df.columns) == tidy(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_plans_prune_columns_and_aggregate_before_the_shuffle(spark):
    plan = queries.QUERIES["minute_buckets"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan
    assert "value" not in plan[plan.index("ReadSchema") :].split("\n")[0]
