"""Exact order statistics by distributed selection.

A rank's value is bracketed, and the bracket narrowed until few values are left inside. In each
round approximate quantiles of the values inside give two splitters around the rank, and exact
counts tell on which side of them it lies, or that it is one of them. A bracket's ends lie outside it,
so ties never hold a round up, and a round leaves about one value in 200 inside. No task ever has
more than ``most`` values of a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Splitters at every thousandth; percentile_approx errs by a rank in so many at most.
GRID, ACCURACY = 1000, 10_000
MOST = 10_000

STATE = ("rank", "low", "high", "below", "inside", "answer")


def inside_of(rows: DataFrame, live: DataFrame, group: list[str]) -> DataFrame:
    """The values strictly inside the brackets of their group."""
    met = rows.join(live, group)
    return met.where((F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high"))))


def narrowed(rows: DataFrame, live: DataFrame, group: list[str]) -> DataFrame:
    """One round: the state of each bracket after it."""
    own = [*group, "rank"]
    grid = F.percentile_approx("x", [i / GRID for i in range(1, GRID)], ACCURACY)
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * GRID).cast("int")
    cut = inside_of(rows, live, group).groupBy(*own).agg(grid.alias("s"))
    # two steps of the grid to either side cover what percentile_approx errs
    split = live.join(cut, own).withColumns({"a": F.when(at >= 3, F.col("s")[F.greatest(at - 3, F.lit(0))]), "b": F.when(at <= GRID - 4, F.col("s")[F.least(at + 2, F.lit(GRID - 2))])}).drop("s")
    split = stored(split, name="splitters")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    n = inside_of(rows, F.broadcast(split), group).groupBy(*own).agg(F.count_if(x < a).alias("under_a"), F.count_if(x == a).alias("at_a"), F.count_if(x < b).alias("under_b"), F.count_if(x == b).alias("at_b"))
    q = F.col("rank") - F.col("below")
    done_a, done_b = F.col("under_a") + F.col("at_a"), F.col("under_b") + F.col("at_b")
    case = F.when(a.isNotNull() & (q < F.col("under_a")), 0).when(a.isNotNull() & (q < done_a), 1).when(b.isNull() | (q < F.col("under_b")), 2).when(q < done_b, 3).otherwise(4)

    def by(*values: Column) -> Column:
        out = F.when(F.col("case") == 0, values[0])
        for i, v in enumerate(values[1:], 1):
            out = out.when(F.col("case") == i, v)
        return out

    none = F.lit(None).cast("double")
    top = F.when(b.isNull(), F.col("inside")).otherwise(F.col("under_b"))
    return split.join(n, own).withColumn("case", case).select(
        *own, by(F.col("low"), none, F.coalesce(a, "low"), none, b).alias("low"), by(a, none, F.coalesce(b, "high"), none, F.col("high")).alias("high"),
        by(F.col("below"), F.col("below"), F.col("below") + done_a, F.col("below"), F.col("below") + done_b).alias("below"),
        by(F.col("under_a"), F.lit(0), top - done_a, F.lit(0), F.col("inside") - done_b).cast("long").alias("inside"), by(none, a, none, b, none).alias("answer"),
    )


def order_statistics(rows: DataFrame, group: list[str], value: str, ranks: Column, most: int = MOST) -> DataFrame:
    """group, rank, answer: the value of each rank (from 0) among a group's values, missing ones apart.

    ranks: an array of whole numbers, from a column n, the number of values. Groups are few:
    their brackets, a row for each rank, are broadcast. Values are doubles, none of them NaN; group columns aren't null.
    """
    rows = rows.select(*[F.col(f"`{g}`") for g in group], F.col(f"`{value}`").cast("double").alias("x")).where("x is not null")
    none = F.lit(None).cast("double")
    n = rows.groupBy(*group).agg(F.count("*").alias("n"))
    state = n.select(*group, F.explode(F.array_distinct(ranks).cast("array<long>")).alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), none.alias("answer"))
    state = stored(state.where("rank >= 0 and rank < inside"), name="brackets")
    while not (live := state.where(f"answer is null and inside > {most}")).isEmpty():
        state = stored(state.where(f"answer is not null or inside <= {most}").unionByName(narrowed(rows, F.broadcast(live), group)), name="brackets")
    left = F.broadcast(state.where("answer is null"))
    few = inside_of(rows, left, group).groupBy(*group, "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.first("below").alias("below"))  # at most ``most`` values
    found = few.select(*group, "rank", F.expr("xs[cast(rank - below as int)]").alias("answer"))
    return state.where("answer is not null").select(*group, "rank", "answer").unionByName(found)


def exact_medians(rows: DataFrame, group: list[str], value: str, most: int = MOST) -> DataFrame:
    """group, median: the middle value, or the mean of both middle ones, of each group with values."""
    both = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    return order_statistics(rows, group, value, both, most).groupBy(*group).agg(((F.min("answer") + F.max("answer")) / 2).alias("median"))
