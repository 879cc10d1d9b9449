"""Filters, classification and top-k on hand-made snapshots."""

import dataclasses
import datetime

import pytest

from tidemark.operators import detect
from tidemark.params import Params
from tidemark.sources.bars import SNAPSHOT, market, rename_columns

P = Params(exchanges=("NASDAQ", "NYSE"), as_of=datetime.date(2024, 3, 1))
KEYS = [x.strip().split()[0] for x in SNAPSHOT.split(",")]


def snap(spark, *rows):
    base = {"market": "america", "close": 10.0, "change": None, "change_abs": 1.0, "volume": 200_000.0}
    return spark.createDataFrame([tuple((base | r).get(k) for k in KEYS) for r in rows], SNAPSHOT)


def test_four_symbols(spark):
    rows = snap(
        spark,
        {"symbol": "AAPL", "close": 150.0, "change": 20.0, "volume": 1e6, "relative_volume_10d_calc": 1.5},
        {"symbol": "MSFT", "close": 300.0, "change": 2.0, "volume": 5e5, "relative_volume_10d_calc": 1.3},
        {"symbol": "PENNYST", "close": 0.3, "change": 50.0, "volume": 1e6, "relative_volume_10d_calc": 2.0},
        {"symbol": "LOWVOL", "change": 20.0, "volume": 5e4, "relative_volume_10d_calc": 1.1},
    )
    assert {r["symbol"] for r in detect.universe(rows, P).collect()} == {"AAPL", "MSFT"}
    found = detect.detect(rows, P, dedupe=True).collect()
    assert {(r["Symbol"], r["Event_Type"], r["Change_%"], r["Date"]) for r in found} == {("AAPL", "Spiker", 20.0, P.as_of), ("MSFT", "Grinder", 2.0, P.as_of)}
    # a symbol without an exchange counts for each that is scanned
    assert detect.detect(rows, P).count() == 4
    assert {r["Event_Type"]: r["events"] for r in detect.count_events(detect.detect(rows, P)).collect()} == {"Spiker": 2, "Grinder": 2}


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ({"change": 15.0}, "Spiker"),
        ({"change": 0.5, "relative_volume_10d_calc": 0.8}, "Grinder"),
        ({"change": 0.5, "relative_volume_10d_calc": 0.79}, None),
        ({"change": 2.0}, "Grinder"),
        ({"change_abs": 16.0}, "Spiker"),
        ({"change": float("nan"), "change_abs": 0.1}, None),
        ({"change": 0.49}, None),
        ({"change": 1.0, "rec_vol_m": 0.1, "relative_volume_10d_calc": 5.0}, None),
    ],
)
def test_boundaries(spark, row, want):
    found = detect.detect(snap(spark, {"symbol": "NYSE:X"} | row), P).collect()
    assert [r["Event_Type"] for r in found] == ([want] if want else [])


def test_price_bound_is_strict_only_in_the_screener(spark):
    rows = snap(spark, {"symbol": "NYSE:X", "close": 0.5, "change": 20.0})
    assert detect.universe(rows, P).count() == 1 and detect.screener(rows, P).count() == 0


def test_exchanges(spark):
    rows = snap(spark, {"symbol": "nasdaq:ABC"}, {"symbol": "NYSE:ABC"}, {"symbol": "ABC"}, {"symbol": "LSE:Z"}, {"symbol": "NASDAQ:BRK:B"})
    got = sorted((r["Exchange"], r["symbol"]) for r in detect.by_exchange(rows, P.exchanges).collect())
    assert got == [("NASDAQ", "ABC"), ("NASDAQ", "ABC"), ("NASDAQ", "B"), ("NYSE", "ABC"), ("NYSE", "ABC")]
    markets = rows.select(market(detect.exchange_part(rows["symbol"])).alias("m")).collect()
    assert [r["m"] for r in markets] == ["america", "america", None, "lse", "america"]


def test_top_k_comes_before_the_exchange_filter(spark):
    rows = snap(spark, {"symbol": "LSE:A", "change": 20.0, "change_abs": 9.0}, {"symbol": "NYSE:B", "change": 20.0, "change_abs": 5.0}, {"symbol": "NYSE:C", "change": 20.0, "change_abs": 5.0})
    assert detect.detect(rows, dataclasses.replace(P, top_k=1)).count() == 0
    assert [r["Symbol"] for r in detect.detect(rows, dataclasses.replace(P, top_k=2)).collect()] == ["B"]  # ties by symbol
    assert "TakeOrderedAndProject" in detect.top_movers(rows, 2)._jdf.queryExecution().toString()


def test_empty_and_renamed(spark):
    assert detect.detect(spark.createDataFrame([], SNAPSHOT), P).count() == 0
    assert rename_columns(snap(spark, {"symbol": "A"}), {"price": "close"}).columns[2] == "price"
