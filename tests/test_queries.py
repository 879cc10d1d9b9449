"""Registered queries against DuckDB on the given tables, and the entry points."""

import os

import duckdb
import pytest

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

DATA = "/root/testdata"
#: Queries that need slices of 50 bars have rows only at 0.01.
SMALL = ("bars_daily", "bars_by_nation", "snapshot", "exchange_filter", "top_movers", "detect_events", "detect_snapshot", "event_counts", "event_coverage", "grinder_consecutive", "sanitized", "renamed", "asof_purchases", "asof_orders")
LARGE = ("event_history", "lag_summary", "overall_stats", "ind_macd", "ind_adx", "ind_rsi", "stage_round_trip")


def rows(spark, name, sf):
    if not os.path.isdir(f"{DATA}/{sf}"):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{t}'")
    mine = QUERIES[name](spark, f"{DATA}/{sf}")
    con.register("mine", mine.toArrow())
    con.execute(f"CREATE TABLE theirs AS {ORACLES[name]}")
    columns = ", ".join(f'"{c}"' for c in mine.columns)
    spark.catalog.clearCache()
    return [con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall()[0][0] for a, b in (("mine", "theirs"), ("theirs", "mine"))]


@pytest.mark.parametrize("name", SMALL)
def test_small(spark, name):
    assert rows(spark, name, "sf0.001") == [0, 0]


@pytest.mark.parametrize("name", LARGE)
def test_large(spark, name):
    assert rows(spark, name, "sf0.01") == [0, 0]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(f"{DATA}/sf0.001"):
        assert e.entry(spark).count() > 0
