"""Which symbols of a snapshot moved, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite_columns
from tidemark.params import Params


def screener(snapshot: DataFrame, p: Params) -> DataFrame:
    """What a remote screener would send: strictly above both bounds and with a change."""
    return snapshot.where((F.col("close") > p.min_price) & (F.col("volume") > p.min_volume) & F.col("change_abs").isNotNull())


def top_movers(snapshot: DataFrame, k: int) -> DataFrame:
    """The k largest changes; equal ones by symbol. Applied before the exchange filter, which a sort's limit keeps above it."""
    return snapshot.orderBy(F.col("change_abs").desc(), "symbol").limit(k)


def top_movers_by_day(snapshots: DataFrame, k: int) -> DataFrame:
    """top_movers of each day of many snapshots: Spark drops rows beyond rank k before the shuffle."""
    w = Window.partitionBy("bar_date").orderBy(F.col("change_abs").desc(), "symbol")
    return snapshots.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def exchange_part(symbol: Column) -> Column:
    """Upper-case text before the first colon; NULL without a colon."""
    return F.when(F.contains(symbol, F.lit(":")), F.upper(F.split(symbol, ":", 2)[0]))


def bare_symbol(symbol: Column) -> Column:
    """The text after the first colon, and of that again: ``A:B:C`` ends as ``C``."""
    after = lambda s: F.when(F.contains(s, F.lit(":")), F.split(s, ":", 2)[1]).otherwise(s)
    return after(after(symbol))


def by_exchange(snapshot: DataFrame, exchanges: tuple[str, ...]) -> DataFrame:
    """One row for each row and exchange it counts for, with Exchange and the bare symbol.

    A row without a prefix counts for every exchange.
    """
    own = exchange_part(F.col("symbol"))
    listed = F.array(*[F.lit(x) for x in exchanges])
    counts = F.filter(listed, lambda x: F.coalesce(own == F.upper(x), F.lit(True)))
    return snapshot.withColumn("Exchange", F.explode(counts)).withColumn("symbol", bare_symbol(F.col("symbol")))


def universe(snapshot: DataFrame, p: Params) -> DataFrame:
    """Bounds included; a missing value is 0."""
    return snapshot.where((F.coalesce("close", F.lit(0.0)) >= p.min_price) & (F.coalesce("volume", F.lit(0.0)) >= p.min_volume))


def change_percent() -> Column:
    return F.coalesce("change", "change_abs", F.lit(0.0))


def rel_volume() -> Column:
    return F.coalesce("rec_vol_m", "relative_volume_10d_calc", "relative_volume_10d_calc_alt", F.lit(1.0))


def event_type(p: Params) -> Column:
    """Spiker from the threshold on; Grinder below it with a moderate gain and volume; else NULL."""
    change = change_percent()
    grinder = (change >= p.grinder_threshold) & (change < p.spiker_threshold) & (rel_volume() >= p.min_rel_volume)
    return F.when(change >= p.spiker_threshold, "Spiker").when(grinder, "Grinder")


def classify(rows: DataFrame, p: Params, day: Column) -> DataFrame:
    """Candidates: the seven columns, for rows of either type."""
    return rows.select(
        day.alias("Date"), F.col("symbol").alias("Symbol"), F.coalesce("Exchange", F.lit("NASDAQ")).alias("Exchange"), event_type(p).alias("Event_Type"),
        F.col("close").alias("Price"), change_percent().alias("Change_%"), F.col("volume").alias("Volume"),
    ).where(F.col("Event_Type").isNotNull())


def detect(snapshot: DataFrame, p: Params, dedupe: bool = False) -> DataFrame:
    """Candidates of one snapshot, as of ``p.as_of`` or today.

    Duplicates of a symbol stay unless ``dedupe`` is set.
    """
    day = F.lit(p.as_of) if p.as_of else F.current_date()
    rows = top_movers(screener(finite_columns(snapshot), p), p.top_k)
    found = classify(universe(by_exchange(rows, p.exchanges), p), p, day)
    return first_of_each(found) if dedupe else found


def first_of_each(candidates: DataFrame) -> DataFrame:
    """One candidate for each day and symbol: the first exchange by name, then the lower price."""
    w = Window.partitionBy("Date", "Symbol").orderBy("Exchange", "Price", "Volume")
    return candidates.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def detect_history(snapshots: DataFrame, p: Params) -> DataFrame:
    """Candidates of every day of a table of snapshots."""
    rows = top_movers_by_day(screener(finite_columns(snapshots), p), p.top_k)
    return classify(universe(by_exchange(rows, p.exchanges), p), p, F.col("bar_date"))


def count_events(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("Event_Type").agg(F.count("*").alias("events"))
