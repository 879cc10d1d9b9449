"""Slices, indicators and samples on hand-made series."""

import dataclasses
import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, lags
from tidemark.operators.indicators import PUBLISHED, indicators, slice_frame
from tidemark.params import Params
from tidemark.sources.bars import BARS
from tidemark.sources.tables import CANDIDATES

EVENT = datetime.date(2024, 6, 3)
DAY = datetime.timedelta(days=1)


def series(symbol, n, price=lambda i: 100.0 + i, volume=lambda i: 1000.0, open_=None, end=EVENT - DAY):
    days = [end - DAY * (n - 1 - i) for i in range(n)]
    return [(symbol, d, (open_ or price)(i), price(i) + 1, price(i) - 1, price(i), volume(i)) for i, d in enumerate(days)]


def events(spark, *symbols, day=EVENT, kind="Spiker"):
    return spark.createDataFrame([(day, s, "NYSE", kind, 10.0, 20.0, 1e6) for s in symbols], CANDIDATES)


def frame(spark, rows, symbol, min_bars=50):
    bars = spark.createDataFrame(rows, BARS)
    got = indicators(history.with_history(history.slices(history.event_keys(events(spark, symbol)), bars, 90), min_bars), bars)
    return got.orderBy("bar_date").toPandas()


@pytest.fixture(scope="module")
def rising(spark):
    return frame(spark, series("R", 60), "R")


def test_all_columns_are_there(rising):
    assert list(rising.columns) == ["symbol", "event_date", "bar_date", *PUBLISHED] and len(PUBLISHED) == 62 and len(rising) == 60


def test_rising_series(rising):
    last = rising.iloc[-1]
    assert last["RSI"] == 100 and last["RSI[1]"] == 100 and last["Mom"] == 10 and last["price_above_EMA20"] == 1 and last["EMA20_above_EMA50"] == 1
    assert last["SMA5"] == pytest.approx(157) and math.isnan(last["SMA100"]) and last["EMA50_above_EMA200"] == 0
    assert last["price_change_1d"] == pytest.approx(100 / 158) and last["high_52w"] == 160 and last["low_52w"] == 99
    assert rising["RSI"].isna().sum() == 14  # a change is missing on the first bar
    closes = rising["close"]
    for n in (5, 10, 20, 50):
        want = closes.ewm(span=n, adjust=False).mean().where(pd.Series(range(1, 61)) >= n)
        pd.testing.assert_series_equal(rising[f"EMA{n}"], want, check_names=False, rtol=1e-9)
    macd = closes.ewm(span=12, adjust=False).mean() - closes.ewm(span=26, adjust=False).mean()
    macd = macd.where(pd.Series(range(1, 61)) >= 26)
    pd.testing.assert_series_equal(rising["MACD.macd"], macd, check_names=False, rtol=1e-8)
    signal = macd.dropna().ewm(span=9, adjust=False).mean()
    assert rising["MACD.signal"].iloc[-1] == pytest.approx(signal.iloc[-1], rel=1e-8) and rising["MACD.signal"].isna().sum() == 33


def test_bands_are_ordered(spark):
    got = frame(spark, series("W", 60, price=lambda i: 100 + 5 * math.sin(i)), "W").dropna(subset=["BB.upper"])
    assert (got["BB.lower"] <= got["BB.middle"]).all() and (got["BB.middle"] <= got["BB.upper"]).all() and len(got) == 41
    closes = pd.Series([100 + 5 * math.sin(i) for i in range(60)])
    assert got["BB.upper"].iloc[-1] == pytest.approx(closes[-20:].mean() + 2 * closes[-20:].std(ddof=0))
    assert got["volatility_20d"].iloc[-1] == pytest.approx((closes.pct_change()[-20:] * 100).std() * math.sqrt(252))


def test_flat_series_divides_by_nothing(spark):
    rows = [(s, d, 5.0, 5.0, 5.0, 5.0, v) for s, d, *_, v in series("F", 60)]
    last = frame(spark, rows, "F").iloc[-1]
    assert all(math.isnan(last[c]) for c in ("Stoch.K", "W.R", "CCI20", "BBPower", "UO", "ADX", "ADX+DI")) and last["RSI"] == 100


def test_gaps_and_volume(spark):
    got = frame(spark, series("G", 60, price=lambda i: 100.0, open_=lambda i: {20: 103.0, 30: 97.0}.get(i, 100.0)), "G")
    assert list(got.index[got["gap_up"] == 1]) == [20] and list(got.index[got["gap_down"] == 1]) == [30] and got["gap_up"].iloc[0] == 0
    got = frame(spark, series("V", 60, volume=lambda i: 0.0 if i < 20 else 10.0), "V")
    assert got["VWAP"].iloc[:20].isna().all() and got["VWAP"].iloc[20:].notna().all() and math.isnan(got["volume_ratio"].iloc[19])


def test_history_and_no_look_ahead(spark):
    rows = series("SHORT", 49) + series("EXACT", 50) + series("LONG", 200, end=EVENT + DAY * 5)
    bars = spark.createDataFrame(rows, BARS)
    cand = events(spark, "SHORT", "EXACT", "LONG", "EXACT", "NONE")
    sliced = history.with_history(history.slices(history.event_keys(cand), bars, 90), 50)
    got = {r["symbol"]: r for r in sliced.groupBy("symbol").agg(F.count("*").alias("n"), F.max("bar_date").alias("last"), F.min("bar_date").alias("first")).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"EXACT": 50, "LONG": 90} and all(r["last"] < EVENT for r in got.values()) and got["LONG"]["first"] == EVENT - DAY * 90
    assert history.coverage(cand, bars, Params()).first().asDict() == {"total": 5, "succeeded": 3, "failed": 2, "cached": 1}


def test_samples(spark):
    weekdays = [r for r in series("W", 84) if r[1].weekday() < 5]
    bars = spark.createDataFrame(weekdays + series("N", 60), BARS)
    p = dataclasses.replace(Params(), lags=(1, 2, 30, 75))
    cand = events(spark, "W", "N", "N")
    raw = lags.collect(cand, bars, p)
    assert raw.columns[:5] == ["Symbol", "Event_Date", "Event_Type", "Exchange", "Time_Lag"] and len(raw.columns) == 67
    assert {r["Time_Lag"]: r["n"] for r in raw.where("Symbol = 'N'").groupBy("Time_Lag").agg(F.count("*").alias("n")).collect()} == {"T-1": 2, "T-2": 2, "T-30": 2}
    # the 3rd of June 2024 is a Monday: both days before it take Friday's bar
    w = {r["Time_Lag"]: r["close"] for r in raw.where("Symbol = 'W'").collect()}
    friday = next(r for r in weekdays if r[1] == datetime.date(2024, 5, 31))[5]
    assert w["T-1"] == w["T-2"] == friday and set(w) == {"T-1", "T-2", "T-30", "T-75"}


def test_another_event_changes_nothing(spark):
    bars = spark.createDataFrame(series("A", 120), BARS)
    one = lags.collect(events(spark, "A"), bars, Params())
    two = lags.collect(events(spark, "A").union(events(spark, "A", day=EVENT - DAY * 20)), bars, Params())
    assert sorted(map(str, one.collect())) == sorted(map(str, two.where(F.col("Event_Date") == EVENT).collect()))


def test_one_exchange_serves_all_windows(spark):
    bars = spark.createDataFrame(series("A", 120), BARS)
    keys = history.event_keys(events(spark, "A"))
    plan = lags.as_of_lags(slice_frame(history.slices(keys, bars, 90)), (1, 3))._jdf.queryExecution().executedPlan().toString()
    after_join = plan[: plan.index("Join")]
    assert after_join.count("Exchange hashpartitioning(symbol") == 1 and "Python" not in plan
