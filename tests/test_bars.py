"""Bars of trades against plain loops."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.sources.bars import bars_of

DAY = datetime.date(2024, 1, 1)
R = random.Random(4)
#: A few orders are on many days and of all symbols; some lines have no order, some share order and line.
ROWS = [(R.choice((None, *range(40))), R.choice((None, 1, 2)), R.choice("ABC"), DAY + datetime.timedelta(days=R.randrange(30)), float(i), float(R.randrange(1, 9))) for i in range(900)]
SCHEMA = "k int, n int, symbol string, day date, price double, quantity double"


def made(spark, rows):
    return bars_of(spark.createDataFrame(rows, SCHEMA), lambda lines: lines.where("price >= 0"), ["k", "n", "price"])


def test_bars_are_those_of_a_loop(spark):
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[2], r[3]].append(r)
    first = lambda r: [(x is not None, x or 0) for x in (r[0], r[1], r[4])]
    want = {}
    for key, found in groups.items():
        found.sort(key=first)
        want[key] = (found[0][4], max(r[4] for r in found), min(r[4] for r in found), found[-1][4], sum(r[5] for r in found))
    got = made(spark, ROWS)
    assert got.columns == ["symbol", "bar_date", "open", "high", "low", "close", "volume"]
    assert {(r["symbol"], r["bar_date"]): tuple(r)[2:] for r in got.collect()} == want and got.count() == len(want)
    assert made(spark, [r for r in ROWS if r[4] < 0]).collect() == []


def test_only_lines_at_an_end_are_ordered(spark):
    """Of 20 000 lines of one bar two or three go into the aggregates by a struct, which sort their rows."""
    lines = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.lit("A").alias("symbol"), F.lit(DAY).alias("day"), F.col("id").cast("double").alias("price"), F.lit(1.0).alias("quantity"))
    bars = bars_of(lines, lambda some: some, ["k", "n"])
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.index("partial_min_by") < plan.index("LeftSemi")
    assert [tuple(r)[2:] for r in bars.collect()] == [(0.0, 19_999.0, 0.0, 19_999.0, 20_000.0)]
