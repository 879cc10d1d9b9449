"""p-values of Student's t and control of false discoveries, in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.extensions import welch
from tidemark.params import Params


def log_gamma_step(a: Column) -> Column:
    """ln(gamma(a + 1/2) / gamma(a)) for a > 0, to 11 digits: the asymptotic series at a + 8, led back by recurrence."""
    z = a + 8
    back = sum((F.log1p(F.lit(0.5) / (a + k)) for k in range(8)), F.lit(0.0))
    return F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3.0))) - 1 / (640 * F.pow(z, F.lit(5.0))) + 17 / (14336 * F.pow(z, F.lit(7.0))) - back


def beta_fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, of so many pairs of terms, from the last one up."""

    def pair(rest: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / rest)

    inner = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda rest, m: pair(rest, m.cast("double")))
    return 1 / (1 - (a + b) * x / (a + 1) / inner)


def two_sided_p(t: Column, freedom: Column) -> Column:
    """The probability of a Student's t at least as far from 0: the regularised incomplete beta function at
    freedom / (freedom + t^2), by the branch in which its fraction converges, for any degrees of freedom above 0.

    Terms grow with the root of the degrees of freedom, as the fraction needs. NULL where t or the degrees of freedom are.
    """
    a, half = freedom / 2, F.lit(0.5)
    square = t * t
    near, far = square / (freedom + square), freedom / (freedom + square)
    terms = (F.lit(40) + F.ceil(3 * F.sqrt(freedom))).cast("int")
    # x^a (1 - x)^b / B(a, b), the same for both branches
    front = F.exp(-a * F.log1p(square / freedom) + F.log(near) / 2 + log_gamma_step(a) - math.log(math.pi) / 2)
    tail = front / a * beta_fraction(far, a, half, terms)
    body = 1 - front / half * beta_fraction(near, half, a, terms)
    p = F.when(square == 0, 1.0).when(far < (a + 1) / (a + 2.5), tail).otherwise(body)
    return F.when((freedom > 0) & t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def with_false_discovery_rate(tests: DataFrame, p_value: str, family: list[str]) -> DataFrame:
    """tests with fdr, by Benjamini and Hochberg: the least rate of false discoveries at which a test of a family counts.

    Tests without a p-value belong to no family and have none. A family is the tests of a lag, one an indicator: its
    size does not grow with the data.
    """
    p = F.col(p_value)
    together = Window.partitionBy(*family, p.isNull())
    upto = F.count(p).over(together.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raised = tests.withColumn("_rate", p * F.count(p).over(together) / F.when(p.isNotNull(), upto))
    least = F.min("_rate").over(together.orderBy(p.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return raised.withColumn("fdr", F.least(F.lit(1.0), least)).withColumn("fdr", F.when(p.isNotNull(), F.col("fdr"))).drop("_rate")


def discoveries(raw: DataFrame, p: Params) -> DataFrame:
    """Welch's test of every indicator with its p-value, the rate of false discoveries within its lag, and
    whether it is a discovery at ``1 - confidence_level``."""
    tests = welch(raw, p).select("Time_Lag", "Indicator", "t", "freedom", two_sided_p(F.col("t"), F.col("freedom")).alias("p_value"))
    return with_false_discovery_rate(tests, "p_value", ["Time_Lag"]).withColumn("discovery", F.col("fdr") <= 1 - p.confidence_level)
