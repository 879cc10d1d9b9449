"""Each event's slice of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.params import Params


def slices(events: DataFrame, bars: DataFrame, lookback_days: int) -> DataFrame:
    """Bars of the days [event_date - lookback, event_date) for each distinct event (symbol, event_date).

    A range join: time is cut into stretches of the look-back, of which a slice
    meets two at most. Joining on symbol and stretch keeps a busy symbol's
    bars in many groups, each of bounded size, instead of pairing all its events
    with all its bars. The rows are then dealt by event, whose windows need them together.
    """
    day = F.datediff(F.col("event_date"), F.lit("1970-01-01").cast("date"))
    stretch = F.sequence(F.floor((day - lookback_days) / lookback_days), F.floor((day - 1) / lookback_days))
    wanted = events.select("symbol", "event_date").where("symbol is not null and event_date is not null").distinct().withColumn("stretch", F.explode(stretch))
    dated = bars.withColumn("stretch", F.floor(F.datediff(F.col("bar_date"), F.lit("1970-01-01").cast("date")) / lookback_days))
    met = wanted.join(dated, ["symbol", "stretch"]).where((F.col("bar_date") >= F.date_sub("event_date", lookback_days)) & (F.col("bar_date") < F.col("event_date")))
    return met.drop("stretch").repartition("symbol", "event_date")


def with_history(sliced: DataFrame, min_bars: int) -> DataFrame:
    """Slices of ``min_bars`` bars or more."""
    n = F.count("*").over(Window.partitionBy("symbol", "event_date"))
    return sliced.withColumn("bar_count", n).where(F.col("bar_count") >= min_bars).drop("bar_count")


def event_keys(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("Symbol").alias("symbol"), F.col("Date").alias("event_date")).distinct()


def coverage(candidates: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """One row of counts: events, those with and without enough bars, and those that repeat another."""
    n = slices(event_keys(candidates), bars, p.lookback_days).groupBy("symbol", "event_date").agg(F.count("*").alias("n"))
    each = candidates.select(F.col("Symbol").alias("symbol"), F.col("Date").alias("event_date")).groupBy("symbol", "event_date").agg(F.count("*").alias("times"))
    joined = each.join(n, ["symbol", "event_date"], "left").withColumn("enough", F.coalesce(F.col("n") >= p.min_bars, F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.agg(total("times").alias("total"), total(F.when(F.col("enough"), F.col("times"))).alias("succeeded"), total(F.when(~F.col("enough"), F.col("times"))).alias("failed"), total(F.col("times") - 1).alias("cached"))
