"""finite, flags, guarded frames and recursive filters."""

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cumulative, ema, finite, finite_columns, flag, full, percent


def values(df, c):
    return [r[c] for r in df.collect()]


def test_finite(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert values(df.select(finite(F.col("x")).alias("x")), "x") == [1.5, None, None, None, None]
    text = spark.createDataFrame([("2.5",), ("n/a",), ("NaN",)], "x string")
    assert values(text.select(finite(F.col("x")).alias("x")), "x") == [2.5, None, None]
    mixed = spark.createDataFrame([(float("nan"), "s", 1)], "`a.b` double, s string, i int")
    assert finite_columns(mixed).first() == (None, "s", 1)


def test_flag_and_percent(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 2.0), (None, 2.0), (3.0, 0.0)], "a double, b double")
    assert values(df.select(flag(F.col("a") > F.col("b")).alias("f")), "f") == [1, 0, 0, 1]
    assert values(df.select(percent(F.col("a"), F.col("b")).alias("p")), "p") == [50.0, -50.0, None, None]


def test_full_frames(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])], "i int, x double")
    w = Window.orderBy("i")
    assert values(df.select(full(F.avg, F.col("x"), w, 2).alias("m")), "m") == [None, 1.5, None, None, 4.5, 5.5]


def test_ema_is_the_recursion(spark):
    xs = [None, 3.0, 5.0, 4.0, None, 8.0, 7.5, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    w = Window.orderBy("i")
    counted = df.withColumn("n", F.count("x").over(cumulative(w)))
    got = values(counted.select(ema(F.col("x"), F.col("n"), 0.3, 3, w).alias("y")), "y")
    known = pd.Series([x for x in xs if x is not None]).ewm(alpha=0.3, adjust=False).mean()
    # a null repeats the last value
    want = [None, None, None, known[2], known[2], known[3], known[4], known[5]]
    assert all(a == b if b is None else math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, want, strict=True))
