"""The as-of join against a plain search, p-values against closed forms, and rates of false discoveries against their definition."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, significance

R = random.Random(4)
START = datetime.date(1990, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 3, 64, None])
def test_as_of_join(spark, width):
    right = [(R.choice("AAAB"), R.choice([R.randrange(40), R.randrange(20_000)]), i) for i in range(300)] + [(None, 5, 900), ("A", None, 901)]
    left = [(i, R.choice("AAABC"), R.randrange(-50, 21_000)) for i in range(300)] + [(400, None, 9), (401, "A", None), (402, "A", 9), (402, "A", 9)]
    l = spark.createDataFrame(left, "id long, k string, at long")
    r = spark.createDataFrame(right, "k string, seen long, v long")
    got = rows_of(asof.as_of_join(l, r, ["k"], "at", "seen", width=width))

    def best(k, at):
        met = [(s, v) for k2, s, v in right if k is not None and k == k2 and None not in (s, at) and s <= at]
        return max(met, default=(None, None))

    assert got == sorted(((i, k, at, *best(k, at)) for i, k, at in left), key=repr)


def test_as_of_join_of_dates_and_odd_names(spark):
    day = lambda n: START + datetime.timedelta(days=n)
    l = spark.createDataFrame([("x", day(9000), {"m": 1}), ("y", day(1), {})], "`k.1` string, `_at` date, `a b` map<string,int>")
    r = spark.createDataFrame([("x", day(0), 1.5), ("x", day(9001), 2.5)], "`k.1` string, `d.1` date, `v.1` double")
    with pytest.raises(ValueError):
        asof.as_of_join(l, l, ["k.1"], "_at", "_at")
    got = asof.as_of_join(l.withColumnRenamed("_at", "at"), r, ["k.1"], "at", "d.1", order=["v.1"])
    assert rows_of(got) == [("x", day(9000), {"m": 1}, day(0), 1.5), ("y", day(1), {}, None, None)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_as_of_join_of_timestamps(spark, kind):
    times = lambda *texts: [(1, x) for x in texts]
    l = spark.createDataFrame(times("2024-03-10 01:59:59.999999", "2024-03-10 02:00:00.000001", "1969-12-31 23:59:59.5"), "k int, s string").select("k", F.col("s").cast(kind).alias("at"))
    r = spark.createDataFrame(times("2024-03-10 02:00:00", "1969-12-31 23:59:59.499999"), "k int, s string").select("k", F.col("s").cast(kind).alias("seen"))
    got = asof.as_of_join(l, r, ["k"], "at", "seen").select(F.col("at").cast("string"), F.col("seen").cast("string"))
    assert rows_of(got) == [("1969-12-31 23:59:59.5", "1969-12-31 23:59:59.499999"), ("2024-03-10 01:59:59.999999", "1969-12-31 23:59:59.499999"), ("2024-03-10 02:00:00.000001", "2024-03-10 02:00:00")]


def test_as_of_join_of_empty_tables(spark):
    l, r = spark.createDataFrame([(1, 5)], "k int, at int"), spark.createDataFrame([(1, 3, "a")], "k int, seen int, v string")
    assert rows_of(asof.as_of_join(l, r.limit(0), ["k"], "at", "seen")) == [(1, 5, None, None)]
    assert rows_of(asof.as_of_join(l.limit(0), r, ["k"], "at", "seen")) == []
    with pytest.raises(ValueError):
        asof.as_of_join(l.withColumn("at", F.lit(1.5)), r, ["k"], "at", "seen")


def by_angle(t, v, steps=20_000):
    def area(end):
        f = lambda x: max(math.cos(x), 0.0) ** (v - 1)
        return end / steps / 3 * sum(f(end * i / steps) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))

    return 1 - area(math.atan(abs(t) / math.sqrt(v))) / area(math.pi / 2)


CLOSED = {
    1: lambda t: 1 - 2 / math.pi * math.atan(t),
    2: lambda t: 1 - t / math.sqrt(2 + t * t),
    4: lambda t: 1 - 2 * (3 / 8 * t / math.sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4)))),
}


def test_p_values(spark):
    exact = [(t, float(v), f(t)) for v, f in CLOSED.items() for t in (1e-6, 0.01, 0.5, 1.0, 2.0, 5.0, 40.0)]
    exact += [(t, v, by_angle(t, v)) for v in (3.7, 10.0, 29.5, 250.0, 1900.3) for t in (0.02, 0.9, 1.96, 3.0, 6.0)]
    exact += [(2.228138851964939, 10.0, 0.05), (1.959963984540054, 1e9, math.erfc(1.959963984540054 / math.sqrt(2))), (-2.0, 2.0, CLOSED[2](2.0)), (0.0, 7.0, 1.0)]
    got = spark.createDataFrame(exact, "t double, v double, p double").withColumn("mine", significance.two_sided_p(F.col("t"), F.col("v"))).collect()
    assert max(abs(r["mine"] - r["p"]) for r in got) < 1e-9, [(r["t"], r["v"], r["mine"], r["p"]) for r in got if abs(r["mine"] - r["p"]) >= 1e-9]
    none = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0)], "t double, v double").select(significance.two_sided_p(F.col("t"), F.col("v")))
    assert [r[0] for r in none.collect()] == [None] * 3


def test_false_discoveries(spark):
    tests = [("a", p) for p in (0.01, 0.02, 0.02, 0.03, 0.9, 1.0)] + [("a", None), ("b", 0.04)]
    got = significance.with_false_discovery_rate(spark.createDataFrame(tests, "lag string, p double"), "p", ["lag"])

    def rate(lag, p):
        ps = [q for g, q in tests if g == lag and q is not None]
        return None if p is None else min([1.0] + [q * len(ps) / sum(x <= q for x in ps) for q in ps if q >= p])

    assert {(r["lag"], r["p"], r["fdr"] and round(r["fdr"], 12)) for r in got.collect()} == {(g, p, p and round(rate(g, p), 12)) for g, p in tests}
