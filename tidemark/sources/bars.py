"""Daily bars and market snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite, percent
from tidemark.sources.shared import stored

BARS = "symbol string, bar_date date, open double, high double, low double, close double, volume double"


def exchange_of(symbol: Column) -> Column:
    """Where a part type is listed."""
    kind = F.split(symbol, " ")[0]
    return F.when(kind.isin("ECONOMY", "STANDARD"), "NASDAQ").when(kind.isin("MEDIUM", "SMALL"), "NYSE").otherwise("AMEX")


def bars_of(lines: DataFrame, trades: Callable[[DataFrame], DataFrame], order: list[str]) -> DataFrame:
    """One bar for each symbol and day of the trades (symbol, day, price, quantity) that ``trades`` makes of lines.

    ``order``, columns of lines that trades keep, must order the trades of a day totally: the first gives open, the
    last close. Symbols and days aren't null. Aggregates of plain numbers are hashed, but those by a struct sort
    all their rows. So a table of the former is written, with each bar's ends in the first column of ``order``, and
    only lines at an end, be it of another bar, go on to be ordered by all columns.
    """
    end, bar = F.col(f"`{order[0]}`"), ["symbol", "bar_date"]
    dated = lambda some: trades(some).withColumnRenamed("day", "bar_date")
    sums = (F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"))
    plain = stored(dated(lines).groupBy(*bar).agg(*sums, F.min(end).alias("_first"), F.max(end).alias("_last"), F.count_if(end.isNull()).alias("_unknown")), name="plain")
    # NULL comes before all values
    ends = plain.select(F.explode(F.array("_first", "_last", F.when(F.col("_unknown") == 0, F.col("_first")))).alias("_end"))
    key = F.struct(*order)
    both = dated(lines.join(ends, end.eqNullSafe(F.col("_end")), "left_semi")).groupBy(*bar).agg(F.min_by("price", key).alias("open"), F.max_by("price", key).alias("close"))
    return plain.join(both, bar).select(*bar, "open", "high", "low", "close", "volume")


#: What orders the lines of a day.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_ORDER, "l_shipdate")


def priced(lines: DataFrame) -> DataFrame:
    """Trades of lines with a symbol."""
    trades = lines.withColumns({"day": F.to_date("l_shipdate"), "price": finite(F.try_divide("l_extendedprice", "l_quantity")), "quantity": finite(F.col("l_quantity"))})
    return trades.where("symbol is not null and day is not null and price is not null")


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of order lines, the part's type being the symbol."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("symbol"))
    return bars_of(order_lines(spark, sf_dir), lambda lines: priced(lines.join(part, F.col("l_partkey") == F.col("p_partkey"))), LINE_ORDER)


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of order lines, the supplier's nation being the symbol: a larger universe."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("symbol"))
    listed = lambda lines: lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return bars_of(order_lines(spark, sf_dir), lambda lines: priced(listed(lines)), LINE_ORDER)


SNAPSHOT = "market string, symbol string, close double, change double, change_abs double, volume double, rec_vol_m double, relative_volume_10d_calc double, relative_volume_10d_calc_alt double"


def snapshots(bars: DataFrame) -> DataFrame:
    """A snapshot row for each bar: what a screener shows at the end of that day.

    Symbols are ``EXCHANGE:SYMBOL``; change is in per cent of the last close,
    relative volume against the mean of the ten bars before.
    """
    w = Window.partitionBy("symbol").orderBy("bar_date")
    last = F.lag("close").over(w)
    mean = F.avg("volume").over(w.rowsBetween(-10, -1))
    exchange = exchange_of(F.col("symbol"))
    return bars.select(
        F.col("bar_date"), market(exchange).alias("market"), F.concat_ws(":", exchange, "symbol").alias("symbol"), "close", "volume",
        percent(F.col("close"), last).alias("change"), (F.col("close") - last).alias("change_abs"), F.lit(None).cast("double").alias("rec_vol_m"),
        F.try_divide("volume", mean).alias("relative_volume_10d_calc"), F.lit(None).cast("double").alias("relative_volume_10d_calc_alt"),
    )


def market(exchange: Column) -> Column:
    """The screener's market of an exchange."""
    return F.when(F.upper(exchange).isin("NASDAQ", "NYSE", "AMEX", "NYSEAMERICAN"), "america").otherwise(F.lower(exchange))


def rename_columns(snapshot: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A snapshot's columns by their indicator names: ``mapping`` goes from names to columns."""
    return snapshot.withColumnsRenamed({column: name for name, column in mapping.items()})
