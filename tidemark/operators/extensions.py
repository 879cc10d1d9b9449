"""Operators beyond the core pipeline; none is on by default."""

from __future__ import annotations

import datetime
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.analyze import numeric_columns, of, text
from tidemark.params import Params


def consecutive_grinders(snapshots: DataFrame, p: Params) -> DataFrame:
    """Days that end ``grinder_days`` bars in a row with a moderate gain or more."""
    w = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(-(p.grinder_days - 1), 0)
    run = F.sum(F.coalesce(F.col("change") >= p.grinder_threshold, F.lit(False)).cast("int")).over(w)
    return snapshots.withColumn("_run", run).where(F.col("_run") == p.grinder_days).drop("_run")


def lately(snapshots: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """The last days of a table of snapshots, the day itself included."""
    day = F.lit(as_of)
    return snapshots.where((F.col("bar_date") > F.date_sub(day, days)) & (F.col("bar_date") <= day))


def sample_sizes(raw: DataFrame) -> DataFrame:
    """Per lag and indicator: values, mean and variance of both classes."""
    names = numeric_columns(raw)
    parts = (("n_s", F.count, "Spiker"), ("n_g", F.count, "Grinder"), ("m_s", F.avg, "Spiker"), ("m_g", F.avg, "Grinder"), ("v_s", F.var_samp, "Spiker"), ("v_g", F.var_samp, "Grinder"))
    wide = raw.groupBy("Time_Lag").agg(*[f(of(kind, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f, kind in parts])
    stacked = ", ".join(f"{text(c)}, " + ", ".join(f"{k}{i}" for k, _, _ in parts) for i, c in enumerate(names))
    return wide.selectExpr("Time_Lag", f"stack({len(names)}, {stacked}) as (Indicator, n_spikers, n_grinders, mean_spikers, mean_grinders, var_spikers, var_grinders)")


def enough_samples(raw: DataFrame, p: Params) -> DataFrame:
    """Indicators with ``min_samples`` values in each class."""
    return sample_sizes(raw).where((F.col("n_spikers") >= p.min_samples) & (F.col("n_grinders") >= p.min_samples))


def critical_t(level: float, freedom: Column) -> Column:
    """The two-sided critical value of Student's t, by its expansion about the normal quantile
    (Cornish and Fisher): three digits and more from 5 degrees of freedom on."""
    z = statistics.NormalDist().inv_cdf(0.5 + level / 2)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return F.lit(z) + sum((F.lit(c) / F.pow(freedom, F.lit(float(i + 1))) for i, c in enumerate(terms)), F.lit(0.0))


def welch(raw: DataFrame, p: Params) -> DataFrame:
    """Welch's t statistic and degrees of freedom per lag and indicator, its critical value at
    ``confidence_level`` and whether t exceeds it; NULL without spread."""
    s, g = F.col("var_spikers") / F.col("n_spikers"), F.col("var_grinders") / F.col("n_grinders")
    freedom = F.try_divide((s + g) * (s + g), F.try_divide(s * s, F.col("n_spikers") - 1) + F.try_divide(g * g, F.col("n_grinders") - 1))
    t = F.try_divide(F.col("mean_spikers") - F.col("mean_grinders"), F.sqrt(s + g))
    tested = enough_samples(raw, p).select("Time_Lag", "Indicator", t.alias("t"), freedom.alias("freedom"))
    return tested.withColumn("critical", critical_t(p.confidence_level, F.col("freedom"))).withColumn("significant", F.abs("t") > F.col("critical"))


def correlations(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each pair of indicators (all, by default) per lag, over the rows that have both.

    A row's pairs are exploded and met at once by partial aggregation, whose co-moments merge: a task sends a
    row for each lag and pair, and the plan is the same for any number of indicators. Pairs
    of which one doesn't vary are left out.
    """
    names = numeric_columns(raw) if names is None else names
    listed = F.array(*[F.lit(c) for c in names])
    values = raw.select("Time_Lag", F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("v"))
    left = values.select("Time_Lag", "v", F.posexplode("v").alias("i", "x")).where("x is not null")
    pairs = left.select("Time_Lag", "i", "x", F.posexplode(F.slice("v", F.col("i") + 2, len(names))).alias("k", "y")).where("y is not null")
    moments = pairs.groupBy("Time_Lag", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    name = lambda c: F.element_at(listed, F.col(c) + 1)
    found = moments.select("Time_Lag", name("i").alias("Indicator_A"), name("j").alias("Indicator_B"), finite(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("Correlation"))
    return found.where("Correlation is not null")


def retained(raw: DataFrame, as_of: datetime.date, p: Params) -> DataFrame:
    """Raw rows of events no older than ``retention_days``."""
    return raw.where(F.col("Event_Date") >= F.date_sub(F.lit(as_of), p.retention_days))
