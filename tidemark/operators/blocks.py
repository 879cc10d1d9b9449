"""Histories of any length in blocks of bounded size: positions, halos, recursive averages.

A window partitioned by symbol alone makes one task of a symbol's whole history. Here
histories are cut into blocks that are tasks of their own. What a block must know of
those before it is passed on in two ways. Frames of a fixed length get a halo: the last rows
before the block, copied into it. Recursions y = a y' + x have no such length, but what a block does to
the value it starts from is an affine map, known without that value. Maps compose:
a block's carry is the composition of all maps before it, found level by level, each fold over
``FAN`` maps at most. Each block then replays its rows from its carry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cumulative

#: Maps that are composed in one group.
FAN = 64
#: Rows of a block: (2/3) ** -512 is well within a double's range.
BLOCK_ROWS = 512


@dataclass(frozen=True)
class Average:
    """y0 = x0, y = (1 - alpha) y' + alpha x over the non-null x of a column; reported once ``least`` are seen."""

    name: str
    value: str
    alpha: float
    least: int


def prefixes(maps: DataFrame, key: list[str], fan: int = FAN) -> DataFrame:
    """key, series, block, n, b: of each block the composition of all maps before it.

    maps: key, series, beta, block (whole numbers in order), n and b, for the map y -> beta^n y + b.
    """
    low, high = maps.agg(F.min("block"), F.max("block")).first()
    by = [*key, "series", "beta"]
    if low is None:
        return maps.select(*key, "series", "block", "n", "b")
    listed = maps.groupBy(*by, F.floor((F.col("block") - F.lit(low)) / fan).alias("upper")).agg(F.sort_array(F.collect_list(F.struct("block", "n", "b"))).alias("maps"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("b"), F.array().cast("array<struct<block: bigint, n: bigint, b: double>>").alias("before"))

    def then(held: Column, x: Column) -> Column:
        before = F.concat(held["before"], F.array(F.struct(x["block"].alias("block"), held["n"].alias("n"), held["b"].alias("b"))))
        return F.struct((held["n"] + x["n"]).alias("n"), (held["b"] * F.pow("beta", x["n"]) + x["b"]).alias("b"), before.alias("before"))

    folded = listed.select(*by, "upper", F.aggregate("maps", start, then).alias("s"))
    each = folded.select(*by, "upper", F.explode("s.before").alias("x")).select(*by, "upper", "x.*")
    if high - low < fan:
        return each.select(*key, "series", "block", "n", "b")
    above = prefixes(folded.select(*by, F.col("upper").alias("block"), "s.n", "s.b"), key, fan)
    above = above.withColumnsRenamed({"block": "upper", "n": "_n", "b": "_b"})
    b = F.col("_b") * F.pow("beta", F.col("n")) + F.col("b")
    return each.join(above, [*key, "series", "upper"]).select(*key, "series", "block", (F.col("_n") + F.col("n")).alias("n"), b.alias("b"))


def positions(rows: DataFrame, key: list[str], time: str, stretch: Column, fan: int = FAN) -> DataFrame:
    """rows with pos, their number (from 0) in the history of their key, by time.

    stretch: a whole number that grows with time, by which a history falls into bounded
    pieces: rows are numbered within these, and only the pieces' sizes are added up.
    """
    cut = rows.withColumn("_stretch", stretch.cast("long"))
    sizes = cut.groupBy(*key, F.col("_stretch").alias("block")).agg(F.count("*").alias("n")).withColumns({"series": F.lit(0), "beta": F.lit(1.0), "b": F.lit(0.0)})
    before = prefixes(sizes, key, fan).select(*key, F.col("block").alias("_stretch"), F.col("n").alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key, "_stretch").orderBy(time)) - 1
    return cut.withColumn("_own", own).join(before, [*key, "_stretch"]).withColumn("pos", F.col("_before") + F.col("_own")).drop("_stretch", "_own", "_before")


def days(time: str, n: int = BLOCK_ROWS) -> Column:
    """The stretch of so many days that a date lies in."""
    return F.floor(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) / n)


def with_halo(placed: DataFrame, rows: int = BLOCK_ROWS, halo: int = 0) -> DataFrame:
    """Rows with pos, dealt into blocks of ``rows`` by a column block; the ``halo`` rows before each block come once
    more as its own, with in_halo true. Frames of at most halo + 1 rows are whole for all others."""
    own, last = F.floor(F.col("pos") / rows), F.floor((F.col("pos") + halo) / rows)
    return placed.withColumn("block", F.explode(F.sequence(own, last))).withColumn("in_halo", F.col("block") != own)


def averages(rows: DataFrame, series: list[Average], key: list[str], time: str, fan: int = FAN) -> DataFrame:
    """rows with a column for each average over their whole history.

    rows have a column block, bounded pieces of each history in the order of time.
    """
    w = cumulative(Window.partitionBy(*key, "block").orderBy(time))
    values = list(dict.fromkeys(s.value for s in series))
    of = {s.name: f"_n{values.index(s.value)}" for s in series}
    counted = rows.withColumns({f"_n{i}": F.count(v).over(w) for i, v in enumerate(values)})
    run = counted.withColumns({f"_s{i}": F.sum(F.col(s.value) * F.pow(F.lit(1 - s.alpha), 1 - F.col(of[s.name]))).over(w) for i, s in enumerate(series)})
    last = F.struct(*[f"_n{i}" for i in range(len(values))], *[f"_s{i}" for i in range(len(series))])
    first = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(time))).cast("double").alias(f"_f{i}") for i, v in enumerate(values)]
    ends = run.groupBy(*key, "block").agg(F.max_by(last, time).alias("e"), *first).select(*key, F.col("block").cast("long").alias("block"), "e.*", *[f"_f{i}" for i in range(len(values))])

    def entry(i: int, s: Average) -> Column:
        n, beta = F.col(of[s.name]), 1 - s.alpha
        moved = s.alpha * F.pow(F.lit(beta), n - 1) * F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        return F.struct(F.lit(i).alias("series"), F.lit(beta).alias("beta"), n.alias("n"), moved.alias("b"), F.col(f"_f{values.index(s.value)}").alias("first"))

    maps = ends.select(*key, "block", F.explode(F.array(*[entry(i, s) for i, s in enumerate(series)])).alias("m")).select(*key, "block", "m.*")
    begin = maps.where("first is not null").groupBy(*key, "series").agg(F.min_by("first", "block").alias("x0"))
    before = prefixes(maps.drop("first"), key, fan).join(begin, [*key, "series"], "left")
    beta = F.element_at(F.array(*[F.lit(1 - s.alpha) for s in series]), F.col("series") + 1)
    # before its first value an average stands at that value, which leaves it there
    carry = before.withColumn("y", F.pow(beta, F.col("n")) * F.col("x0") + F.col("b"))
    mine = lambda c, i: F.max(F.when(F.col("series") == i, F.col(c)))
    wide = carry.groupBy(*key, "block").agg(*[mine("y", i).alias(f"_y{i}") for i in range(len(series))], *[mine("n", i).alias(f"_m{i}") for i in range(len(series))])

    def replayed(i: int, s: Average) -> Column:
        n, power = F.col(of[s.name]), lambda k: F.pow(F.lit(1 - s.alpha), k)
        y = power(n) * F.col(f"_y{i}") + s.alpha * power(n - 1) * F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        return F.when(F.col(f"_m{i}") + n >= s.least, y)

    joined = run.join(wide, [*key, "block"])
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[replayed(i, s).alias(s.name) for i, s in enumerate(series)])
