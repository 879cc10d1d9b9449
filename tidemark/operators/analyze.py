"""Events of both classes compared, per lag and indicator, and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators.quantiles import exact_medians

META = ("Symbol", "Event_Date", "Event_Type", "Exchange", "Time_Lag")


def numeric_columns(raw: DataFrame) -> list[str]:
    """Indicators by name: numeric columns that aren't metadata."""
    return sorted(f.name for f in raw.schema.fields if f.name not in META and isinstance(f.dataType, NumericType))


def of(kind: str, c: str) -> Column:
    return F.when(F.col("Event_Type") == kind, F.col(f"`{c}`"))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def compare(raw: DataFrame) -> DataFrame:
    """One row per lag and indicator: both means, their difference and ratio.

    One pass of partial aggregation leaves a row per lag; only those are turned
    into a row per indicator. Indicators without a mean are left out.
    """
    names = numeric_columns(raw)
    means = [F.avg(of(kind, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, kind in (("s", "Spiker"), ("g", "Grinder"))]
    wide = raw.groupBy("Time_Lag").agg(*means)
    stacked = ", ".join(f"{text(c)}, s{i}, g{i}" for i, c in enumerate(names))
    long = wide.selectExpr("Time_Lag", f"stack({len(names)}, {stacked}) as (Indicator, AVG_Spikers, AVG_Grinders)")
    s, g = F.col("AVG_Spikers"), F.col("AVG_Grinders")
    return long.where(F.coalesce(s, g).isNotNull()).withColumns({"Difference": s - g, "Ratio": F.try_divide(s, g)})


def report_order(analysis: DataFrame) -> DataFrame:
    """By lag, in days, and indicator."""
    return analysis.orderBy(F.substring_index("Time_Lag", "-", -1).cast("int"), "Indicator")


def first_named(raw: DataFrame, parts: tuple[str, ...], whole: bool) -> str | None:
    """The first numeric column whose lower-case name is, or contains, one of the parts."""
    numeric = set(numeric_columns(raw))
    for c in raw.columns:
        if c in numeric and any(c.lower() == x if whole else x in c.lower() for x in parts):
            return c
    return None


def statistics(raw: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(Metric, Value) over the first lag that has rows; counts of 0 and ratios of 0 without any.

    One aggregation gives a row for each lag, of which the first in the order of
    ``lags`` is taken. Exact medians of its prices are selected, from brackets that are narrowed
    until they hold few values.
    """
    change, price, volume = first_named(raw, ("change", "cambio"), False), first_named(raw, ("price", "close"), True), first_named(raw, ("volume",), True)
    kinds = (("spiker", "Spiker"), ("grinder", "Grinder"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(lags) for x in (f"T-{k}", i)])
    aggregates = {f"total_{k}s": F.count_if(F.col("Event_Type") == kind).cast("double") for k, kind in kinds}
    for c, name in ((change, "avg_{}_change_pct"), (price, "avg_{}_price"), (volume, "avg_{}_volume")):
        aggregates |= {name.format(k): F.avg(of(kind, c)) for k, kind in kinds if c}
    each = raw.groupBy("Time_Lag").agg(*[m.alias(k) for k, m in aggregates.items()]).withColumn("_order", order[F.col("Time_Lag")]).where("_order is not null")
    names = ["Time_Lag", *aggregates]
    first = each.agg(F.min_by(F.struct(*names), "_order").alias("first"))  # a row for each lag comes here
    total = F.coalesce(F.col("first.total_spikers") + F.col("first.total_grinders"), F.lit(0.0))
    share = lambda k: F.coalesce(F.try_divide(F.col(f"first.total_{k}s"), total), F.lit(0.0))
    metrics: dict[str, Column] = {"total_events": total} | {f"total_{k}s": F.coalesce(F.col(f"first.total_{k}s"), F.lit(0.0)) for k, _ in kinds} | {f"{k}_ratio": share(k) for k, _ in kinds}
    metrics |= {name: F.col(f"first.{name}") for name in aggregates if name.startswith("avg_")}
    one = first
    if price:
        rows = raw.join(F.broadcast(first.select("first.Time_Lag")), "Time_Lag").where(F.col("Event_Type").isin([kind for _, kind in kinds]))
        medians = exact_medians(rows, ["Event_Type"], price)
        mine = lambda kind: F.max(F.when(F.col("Event_Type") == kind, F.col("median")))
        one = first.crossJoin(F.broadcast(medians.agg(*[mine(kind).alias(f"median_{k}") for k, kind in kinds])))  # a row by a row
        metrics |= {f"median_{k}_price": F.col(f"median_{k}") for k, _ in kinds}
    return one.select(*[m.alias(k) for k, m in metrics.items()]).selectExpr(f"stack({len(metrics)}, " + ", ".join(f"{text(k)}, {k}" for k in metrics) + ") as (Metric, Value)")


def distinct_lags(raw: DataFrame) -> DataFrame:
    return raw.select("Time_Lag").distinct()
