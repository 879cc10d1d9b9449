"""Column expressions: finite values, flags, guarded frames and recursive filters.

Rows with NaN or infinity count as rows without a value, so sources apply
``finite`` once and everything after it sees NULL only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finite(c: Column) -> Column:
    """The value as double; NULL for NaN, infinities and what is no number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def finite_columns(df: DataFrame) -> DataFrame:
    """df with every floating column made finite."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def cumulative(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(agg, x: Column, w: WindowSpec, n: int) -> Column:
    """agg over the last n rows, once n values are there."""
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def percent(a: Column, b: Column) -> Column:
    """By how many per cent a exceeds b."""
    return (F.try_divide(a, b) - 1) * 100


def ema(x: Column, seen: Column, alpha: float, n: int, w: WindowSpec) -> Column:
    """y0 = x0, y = (1 - alpha) y' + alpha x over the non-null x; reported once n are seen.

    ``seen`` counts the non-null x up to the row. Written as a running sum, so it
    shares the window's sort and needs no arrays; the powers stay within a
    double's range for slices of up to about 1 700 rows at alpha 1/3.
    """
    beta = 1.0 - alpha
    i = seen - 1
    total = F.sum(x * F.pow(F.lit(beta), -i)).over(cumulative(w))
    first = F.first(x, ignorenulls=True).over(cumulative(w))
    return F.when(seen >= n, F.pow(F.lit(beta), i) * (alpha * total + beta * first))

