"""Blocks, halos, recursive averages and selection against plain loops."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import blocks, history, indicators, quantiles
from tidemark.operators.blocks import Average
from tidemark.params import Params
from tidemark.sources.bars import BARS

DAY = datetime.date(2001, 1, 1)
R = random.Random(9)


def fold(xs, alpha, least):
    out, y, n = [], None, 0
    for x in xs:
        if x is not None:
            y, n = x if y is None else (1 - alpha) * y + alpha * x, n + 1
        out.append(y if n >= least else None)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    """Two histories of which one has 300 rows, with gaps in time and in values."""
    made = [("A", DAY + datetime.timedelta(days=i * 3 + R.randrange(3)), None if i < 4 or R.random() < 0.1 else R.uniform(1, 9)) for i in range(300)]
    made += [("B", DAY + datetime.timedelta(days=900), 5.0)]
    return spark.createDataFrame(made, "symbol string, day date, x double"), made


@pytest.mark.parametrize(("fan", "stretch"), [(64, 512), (3, 10)])
def test_positions(rows, fan, stretch):
    df, made = rows
    got = blocks.positions(df, ["symbol"], "day", blocks.days("day", stretch), fan).orderBy("symbol", "day").collect()
    assert [r["pos"] for r in got] == [*range(300), 0] and got[0].asDict().keys() == {"symbol", "day", "x", "pos"}


def test_halos_make_frames_whole(rows):
    df, _ = rows
    placed = blocks.positions(df, ["symbol"], "day", blocks.days("day", 50))
    cut = blocks.with_halo(placed, 16, 40)  # a halo longer than a block
    assert cut.where("not in_halo").count() == 301 and cut.groupBy("symbol", "block").count().agg(F.max("count")).first()[0] <= 16 + 40
    frame = lambda *by: Window.partitionBy(*by).orderBy("day").rowsBetween(-40, 0)
    mine = cut.withColumn("s", F.sum("pos").over(frame("symbol", "block"))).where("not in_halo").select("symbol", "day", "s")
    theirs = placed.withColumn("s", F.sum("pos").over(frame("symbol"))).select("symbol", "day", "s")
    assert mine.exceptAll(theirs).count() == 0


@pytest.mark.parametrize(("fan", "block"), [(64, 512), (3, 8)])
def test_averages(rows, fan, block):
    df, made = rows
    placed = blocks.positions(df.withColumn("z", F.col("x") * 2), ["symbol"], "day", blocks.days("day", 50)).withColumn("block", F.floor(F.col("pos") / block))
    series = [Average("fast", "x", 1 / 3, 5), Average("slow", "z", 1 / 14, 14), Average("all", "x", 2 / 201, 1)]
    got = blocks.averages(placed, series, ["symbol"], "day", fan).orderBy("symbol", "day").collect()
    xs = [x for s, _, x in made if s == "A"]
    for name, alpha, least, k in (("fast", 1 / 3, 5, 1), ("slow", 1 / 14, 14, 2), ("all", 2 / 201, 1, 1)):
        for r, want in zip(got, fold([None if x is None else k * x for x in xs], alpha, least), strict=False):
            assert (r[name] is None) == (want is None) and (want is None or math.isclose(r[name], want, rel_tol=1e-9)), (r, want)
    assert got[-1]["all"] == 5.0 and got[-1]["fast"] is None


def test_nothing_to_average(rows):
    df = rows[0].limit(0).withColumn("block", F.lit(0).cast("long"))
    assert blocks.averages(df, [Average("y", "x", 0.5, 1)], ["symbol"], "day").collect() == []
    assert blocks.positions(rows[0].limit(0), ["symbol"], "day", blocks.days("day")).collect() == []


def test_slices_longer_than_running_sums_hold(spark):
    n = 5000
    price = [100 + 10 * math.sin(i / 50) for i in range(n)]
    bars = spark.createDataFrame([("L", DAY + datetime.timedelta(days=i), p, p + 1, p - 1, p, 1e3) for i, p in enumerate(price)], BARS)
    event = DAY + datetime.timedelta(days=n)
    keys = spark.createDataFrame([("L", event)], "symbol string, event_date date")
    p = Params(lookback_days=n)
    sliced = history.slices(keys, bars, p.lookback_days)
    last = indicators.indicators(sliced, bars, ("EMA5", "EMA200", "MACD.macd", "RSI", "ADX"), p.lookback_days).orderBy(F.desc("bar_date")).first()
    assert math.isclose(last["EMA5"], fold(price, 1 / 3, 5)[-1], rel_tol=1e-9) and math.isclose(last["EMA200"], fold(price, 2 / 201, 200)[-1], rel_tol=1e-9)
    assert math.isclose(last["MACD.macd"], fold(price, 2 / 13, 12)[-1] - fold(price, 2 / 27, 26)[-1], rel_tol=1e-7)
    assert 0 <= last["RSI"] <= 100 and 0 <= last["ADX"] <= 100
    whole = indicators.whole_histories(bars).orderBy(F.desc("bar_date")).first()
    assert math.isclose(whole["ema5"], last["EMA5"], rel_tol=1e-9) and math.isclose(whole["adx"], last["ADX"], rel_tol=1e-6)


def test_ranks_are_exact(spark):
    made = [("even", float(R.choice((1, 2, 2, 3, 1000, -5)))) for _ in range(800)] + [("wide", R.choice((1, -1)) * 10.0 ** R.uniform(-300, 300)) for _ in range(900)]
    made += [("two", 1.0)] * 301 + [("two", 2.0)] * 299 + [("one", 7.0), ("one", None), ("none", None)]
    df = spark.createDataFrame(made, "g string, x double")
    ranks = F.array(F.lit(0), F.floor(F.col("n") / 3), F.floor(F.col("n") / 2), F.col("n") - 1)
    for most in (10_000, 12):
        got = {(r["g"], r["rank"]): r["answer"] for r in quantiles.order_statistics(df, ["g"], "x", ranks, most).collect()}
        want = {}
        for g in ("even", "wide", "two", "one"):
            xs = sorted(x for k, x in made if k == g and x is not None)
            want |= {(g, i): xs[i] for i in (0, len(xs) // 3, len(xs) // 2, len(xs) - 1)}
        assert got == want
    medians = {r["g"]: r["median"] for r in quantiles.exact_medians(df, ["g"], "x", 12).collect()}
    assert medians["two"] == 1.0 and medians["one"] == 7.0 and "none" not in medians
    assert quantiles.exact_medians(df.limit(0), ["g"], "x").collect() == []
