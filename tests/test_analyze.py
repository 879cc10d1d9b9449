"""Comparison, statistics, stage tables and extensions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import analyze, extensions
from tidemark.params import Params
from tidemark.sources import tables

RAW = "Symbol string, Event_Date date, Event_Type string, Exchange string, Time_Lag string, close double, volume double, price_change_1d double, `MACD.macd` double, gap_up int, empty double"
DAY = datetime.date(2024, 1, 2)


def raw(spark, *rows):
    return spark.createDataFrame([("S", DAY, kind, "NYSE", lag, *values) for kind, lag, *values in rows], RAW)


@pytest.fixture
def some(spark):
    return raw(
        spark,
        ("Spiker", "T-3", 1.0, 10.0, 5.0, 2.0, 1, None), ("Spiker", "T-3", 2.0, 20.0, None, 4.0, 0, None), ("Spiker", "T-3", 3.0, 30.0, 7.0, None, 0, None), ("Spiker", "T-3", 10.0, 30.0, 7.0, None, 0, None),
        ("Grinder", "T-3", 4.0, 0.0, 1.0, 0.0, 0, None), ("Other", "T-3", 99.0, 99.0, 99.0, 99.0, 1, None), ("Spiker", "T-10", 1.0, 1.0, 1.0, 1.0, 1, None),
    )


def test_compare(some):
    got = {(r["Time_Lag"], r["Indicator"]): tuple(r)[2:] for r in analyze.compare(some).collect()}
    assert got["T-3", "close"] == (4.0, 4.0, 0.0, 1.0)
    assert got["T-3", "MACD.macd"] == (3.0, 0.0, 3.0, None)  # no ratio to a mean of 0
    assert got["T-10", "close"] == (1.0, None, None, None)
    assert got["T-3", "gap_up"] == (0.25, 0.0, 0.25, None) and ("T-3", "empty") not in got
    order = [(r["Time_Lag"], r["Indicator"]) for r in analyze.report_order(analyze.compare(some)).collect()]
    assert order == sorted(order, key=lambda x: (int(x[0][2:]), x[1]))


def test_statistics(spark, some):
    got = {r["Metric"]: r["Value"] for r in analyze.statistics(some, (1, 3, 10)).collect()}
    assert (got["total_events"], got["total_spikers"], got["spiker_ratio"], got["avg_spiker_change_pct"]) == (5, 4, 0.8, pytest.approx(19 / 3))
    assert (got["avg_spiker_price"], got["median_spiker_price"], got["avg_grinder_volume"]) == (4.0, 2.5, 0.0)
    none = {r["Metric"]: r["Value"] for r in analyze.statistics(raw(spark), (1, 3)).collect()}
    assert none["total_events"] == 0 and none["spiker_ratio"] == 0 and none["avg_spiker_price"] is None


def test_tables(spark, some, tmp_path):
    root = str(tmp_path)
    assert tables.read_candidates(spark, root).count() == 0
    cand = spark.createDataFrame([(DAY, "S", "NYSE", "Spiker", 1.0, 2.0, 3.0)], tables.CANDIDATES)
    assert tables.write_candidates(cand, root) and not tables.write_candidates(cand.limit(0), root)
    assert tables.read_candidates(spark, root).collect() == cand.collect()
    tables.write_raw_data(some, root)
    tables.write_raw_data(some.where("Time_Lag = 'T-10'").limit(1).union(some.where("Time_Lag = 'T-10'")), root)
    back = tables.read_raw_data(spark, root, some.schema)
    assert {r["Time_Lag"]: r["count"] for r in back.groupBy("Time_Lag").count().collect()} == {"T-3": 6, "T-10": 2}  # the other lag stays
    one = tables.read_raw_data(spark, root, some.schema, (10,))
    assert one.count() == 2
    # a version's parts are chosen by folder, not by a filter in the plan: no file of another lag is read
    assert one.inputFiles() and all("/by_lag=T-10/" in f for f in one.inputFiles()) and len(one.inputFiles()) < len(back.inputFiles())
    analysis, stats = analyze.compare(some), analyze.statistics(some, (3,))
    tables.write_analysis(analysis, root)
    assert tables.write_stats(stats, root)
    tables.append_table(stats, root, "stats")
    assert tables.read_table(spark, root, "stats", tables.STATS).count() == 2 * stats.count()
    tables.write_report(analysis, stats, root)
    tables.write_backup(some, root)
    assert spark.read.csv(f"{root}/summary_comparison", header=True).count() == analysis.count()
    assert spark.read.csv(f"{root}/raw_data_csv", header=True).count() == some.count()
    wide = some.drop("Time_Lag")
    tables.write_raw_data(wide, f"{root}/plain")
    assert tables.read_raw_data(spark, f"{root}/plain", wide.schema).count() == some.count()


def test_extensions(spark, some):
    p = Params(min_samples=1)
    sizes = {(r["Time_Lag"], r["Indicator"]): (r["n_spikers"], r["n_grinders"]) for r in extensions.enough_samples(some, p).collect()}
    assert sizes["T-3", "close"] == (4, 1) and ("T-10", "close") not in sizes
    assert extensions.correlations(some, ["close", "volume"]).where("Time_Lag = 'T-3'").first()["Correlation"] is not None
    assert extensions.retained(some, DAY + datetime.timedelta(days=91), p).count() == 0
    snaps = spark.createDataFrame([("A", DAY + datetime.timedelta(days=i), c) for i, c in enumerate([1.0, 0.6, 0.5, 0.4, 2.0])], "symbol string, bar_date date, change double")
    assert [r["change"] for r in extensions.consecutive_grinders(snaps, p).collect()] == [0.5]
    assert extensions.lately(snaps, DAY + datetime.timedelta(days=4), 2).count() == 2


def test_list_tables(spark):
    assert isinstance(tables.list_tables(spark), list)
    assert analyze.distinct_lags(spark.createDataFrame([("T-1",), ("T-1",)], "Time_Lag string")).agg(F.count("*")).first()[0] == 1
