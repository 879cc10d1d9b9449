"""Registered queries of the event engine: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import dataclasses
import datetime
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import finite_columns
from tidemark.operators import analyze, asof, detect, extensions, history, indicators, lags, quantiles, significance
from tidemark.params import LINE_BARS, Params
from tidemark.plans import pipeline
from tidemark.plans.oracles import ORACLES  # noqa: F401
from tidemark.sources import bars as bar_source
from tidemark.sources import tables, versions

P = LINE_BARS
#: The day of queries about one snapshot.
DAY = datetime.date(1997, 6, 2)


def fix(c):
    """A value in steps of a thousandth, off the decimal ties: engines differ in the last bits of sums."""
    return F.floor(c.cast("double") * 1000 + 0.37) / 1000


def fixed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: fix(F.col(f"`{c}`")) for c in columns})


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.line_bars(spark, sf_dir)


def bars_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.supplier_bars(spark, sf_dir)


def all_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.snapshots(bar_source.line_bars(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_snapshots(spark, sf_dir).select("bar_date", "market", "symbol", "close", "change", "change_abs", "volume", "relative_volume_10d_calc")
    return fixed(found, "close", "change", "change_abs", "relative_volume_10d_calc")


def screener_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(detect.screener(all_snapshots(spark, sf_dir), P).select("bar_date", "symbol", "close", "volume"), "close")


def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(detect.universe(all_snapshots(spark, sf_dir), P).select("bar_date", "symbol", "close", "volume"), "close")


def exchange_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.by_exchange(all_snapshots(spark, sf_dir), ("NASDAQ", "NYSE"))
    return found.groupBy("Exchange", "symbol", "market").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(detect.top_movers(all_snapshots(spark, sf_dir).where("change_abs is not null"), 100).select("bar_date", "symbol", "change_abs"), "change_abs")


def detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(pipeline.events_of_bars(bar_source.line_bars(spark, sf_dir), P), "Price", "Change_%")


def detect_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dataclasses.replace(P, as_of=DAY)
    return fixed(detect.detect(all_snapshots(spark, sf_dir).where(F.col("bar_date") == F.lit(DAY)), p, dedupe=True), "Price", "Change_%")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.count_events(pipeline.events_of_bars(bar_source.line_bars(spark, sf_dir), P))


def sliced(spark: SparkSession, sf_dir: str, p: Params = P) -> tuple[DataFrame, DataFrame]:
    """Slices of all events with enough history, and the bars they are of."""
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    keys = history.event_keys(pipeline.events_of_bars(bars, p))
    return history.with_history(history.slices(keys, bars, p.lookback_days), p.min_bars), bars


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sliced(spark, sf_dir)[0].groupBy("symbol", "event_date").agg(F.count("*").alias("bars"), F.min("bar_date").alias("first_day"), F.max("bar_date").alias("last_day"), F.sum("volume").alias("volume"))
    return found


def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    return history.coverage(pipeline.events_of_bars(bars, P), bars, P)


def indicator_query(*names: str):
    """The named indicators on the last bar before each event, and how many bars of its slice have them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = indicators.indicators(*sliced(spark, sf_dir), names, P.lookback_days)
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        last = frame.groupBy("symbol", "event_date").agg(F.max_by(row, "bar_date").alias("row"), *[F.count(f"`{c}`").alias(f"n_{i}") for i, c in enumerate(names)])
        return last.select("symbol", "event_date", *[fix(F.col(f"row.`{c}`")).alias(c) for c in names], *[f"n_{i}" for i in range(len(names))])

    return query


INDICATOR_QUERIES = {
    "ind_price": ("close", "open", "high", "low", "volume"),
    "ind_sma": ("SMA5", "SMA10", "SMA20", "SMA50", "SMA100", "SMA200"),
    "ind_price_change": ("price_change_1d", "price_change_3d", "price_change_5d", "price_change_10d", "price_change_20d"),
    "ind_bollinger": ("BB.upper", "BB.lower", "BB.middle", "BB_width", "BBPower"),
    "ind_stochastic": ("Stoch.K", "Stoch.D", "Stoch.K[1]", "Stoch.D[1]"),
    "ind_williams": ("W.R",),
    "ind_cci": ("CCI20",),
    "ind_ao": ("AO",),
    "ind_uo": ("UO",),
    "ind_volume": ("volume_sma5", "volume_sma20", "volume_ratio"),
    "ind_volatility": ("volatility_20d",),
    "ind_52w": ("high_52w", "low_52w", "price_vs_high_52w", "price_vs_low_52w"),
    "ind_gap": ("gap_%", "gap_up", "gap_down"),
    "ind_vwap": ("VWAP",),
    "ind_momentum": ("Mom", "Mom[1]"),
    "ind_ema": ("EMA5", "EMA10", "EMA20", "EMA50", "EMA100", "EMA200"),
    "ind_macd": ("MACD.macd", "MACD.signal", "MACD_diff"),
    "ind_rsi": ("RSI", "RSI[1]"),
    "ind_atr": ("ATR",),
    "ind_adx": ("ADX", "ADX+DI", "ADX-DI"),
    "ind_trend_flags": ("EMA20_above_EMA50", "EMA50_above_EMA200", "price_above_EMA20", "EMA10_above_EMA20"),
}


def lag_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lags.samples(*sliced(spark, sf_dir), P, ("close", "volume", "price_change_1d"))
    return fixed(found.select("symbol", "event_date", "lag", "bar_date", "close", "volume", "price_change_1d"), "close", "price_change_1d")


def raw(spark: SparkSession, sf_dir: str, p: Params = P) -> DataFrame:
    return pipeline.raw_of_bars(pipeline.stored(bar_source.line_bars(spark, sf_dir)), p)


def raw_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(raw(spark, sf_dir), *VALUES)


#: The published columns that aren't flags.
VALUES = [c for c in indicators.PUBLISHED if c not in indicators.FLAGS]


def lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(analyze.compare(raw(spark, sf_dir)), "AVG_Spikers", "AVG_Grinders", "Difference", "Ratio")


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stage table of raw data, of whose columns three are read."""
    found = raw(spark, sf_dir).select(*analyze.META, "close", "volume", "price_change_1d")
    root = pipeline.shared_root(spark)
    tables.write_raw_data(found, root)
    return fixed(analyze.statistics(tables.read_raw_data(spark, root, found.schema, P.lags), P.lags), "Value")


def distinct_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.distinct_lags(raw(spark, sf_dir).select("Time_Lag"))


def latest_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = indicators.indicators(*sliced(spark, sf_dir), ("close", "SMA20", "VWAP"), P.lookback_days)
    return fixed(lags.latest_per_symbol(frame), "close", "SMA20", "VWAP")


def grinder_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(extensions.consecutive_grinders(all_snapshots(spark, sf_dir), P).select("bar_date", "symbol", "change"), "change")


def detect_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_history(extensions.lately(all_snapshots(spark, sf_dir), DAY, 7), P)
    return fixed(found, "Price", "Change_%")


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages after values that aren't finite are made NULL: a ratio by zero stands for such values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value", (F.col("user_id") % 3).cast("double").alias("d"))
    odd = events.withColumn("odd", F.when(F.col("d") == 0, F.lit(float("nan"))).when(F.col("d") == 1, F.lit(float("inf"))).otherwise(F.col("value")))
    return finite_columns(odd).groupBy("event_type").agg(F.count("odd").alias("finite"), fix(F.avg("odd")).alias("mean"))


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bar_source.rename_columns(all_snapshots(spark, sf_dir).select("bar_date", "symbol", "close", "change"), {"price": "close", "gain": "change"})
    return fixed(found, "price", "gain")


def enough_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extensions.enough_samples(raw(spark, sf_dir), P)
    return found.select("Time_Lag", "Indicator", "n_spikers", "n_grinders")


def welch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(extensions.welch(raw(spark, sf_dir), P), "t", "freedom", "critical")


def welch_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator's p-value and the rate of false discoveries within its lag."""
    return fixed(significance.discoveries(raw(spark, sf_dir), P), "t", "freedom", "p_value", "fdr")


def asof_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its symbol's last bar of a year before or earlier, of any age."""
    bars = pipeline.stored(bar_source.supplier_bars(spark, sf_dir))
    keys = history.event_keys(pipeline.events_of_bars(bars, P)).withColumn("year_before", F.date_sub("event_date", 365))
    found = asof.as_of_join(keys, bars.select("symbol", "bar_date", "close", F.col("volume").alias("bar_volume")), ["symbol"], "year_before", "bar_date")
    return fixed(found, "close")


def asof_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last click before it, in buckets of an hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return asof.as_of_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id"])


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last line of its status shipped by its day: three keys hold all rows, and many share a day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linestatus").alias("o_orderstatus"), F.to_date("l_shipdate").alias("shipped"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    found = asof.as_of_join(orders, lines, ["o_orderstatus"], "day", "shipped", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], width=16)
    return found.select("o_orderkey", "o_orderstatus", "day", "shipped", "l_orderkey", "l_extendedprice")


CORRELATED = ("close", "volume", "SMA20", "price_change_5d", "RSI", "MACD.macd", "ATR", "volatility_20d", "gap_up")


def indicator_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extensions.correlations(raw(spark, sf_dir), list(CORRELATED))
    return fixed(found, "Correlation")


def retained_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extensions.retained(raw(spark, sf_dir).select(*analyze.META, "close"), datetime.date(1998, 6, 1), P)
    return fixed(found, "close")


def stage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw data through its partitioned table: two lags are read back, by partition."""
    root = pipeline.shared_root(spark)
    rows = raw(spark, sf_dir).select(*analyze.META, "close", "volume")
    tables.write_raw_data(rows, root)
    back = tables.read_raw_data(spark, root, rows.schema, (1, 30))
    return back.groupBy("Time_Lag", "Event_Type").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


def stage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through their table; a write without rows leaves it as it is."""
    root = pipeline.shared_root(spark)
    found = pipeline.events_of_bars(pipeline.stored(bar_source.line_bars(spark, sf_dir)), P)
    tables.write_candidates(found, root)
    tables.write_candidates(tables.read_candidates(spark, root).limit(0), root)
    return fixed(tables.read_candidates(spark, root), "Price", "Change_%")


def stage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table overwritten with one class of events, and appended with the other."""
    root = pipeline.shared_root(spark)
    found = pipeline.stored(pipeline.events_of_bars(pipeline.stored(bar_source.line_bars(spark, sf_dir)), P), root, "found")
    tables.write_table(found, root, "candidates")
    tables.write_table(found.where("Event_Type = 'Spiker'"), root, "candidates")
    tables.append_table(found.where("Event_Type = 'Grinder'"), root, "candidates")
    return fixed(tables.read_candidates(spark, root), "Price", "Change_%")


def stage_raw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lags of the raw table, after one lag was written again with fewer rows."""
    root = pipeline.shared_root(spark)
    rows = raw(spark, sf_dir).select(*analyze.META, "close")
    tables.write_raw_data(rows, root)
    tables.write_raw_data(tables.read_raw_data(spark, root, rows.schema, (3,)).where("Event_Type = 'Spiker'"), root)
    return tables.read_raw_data(spark, root, rows.schema).groupBy("Time_Lag", "Event_Type").agg(F.count("*").alias("rows"), fix(F.avg("close")).alias("close"))


def stage_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw data through its CSV backup."""
    root = pipeline.shared_root(spark)
    rows = raw(spark, sf_dir).select(*analyze.META, "close", "volume", "RSI", "gap_up")
    tables.write_backup(rows, root)
    return fixed(spark.read.schema(rows.schema).option("header", True).csv(f"{root}/raw_data_csv"), "close", "RSI")


def ran(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a run of all stages."""
    root = pipeline.shared_root(spark)
    pipeline.run(spark, bar_source.line_bars(spark, sf_dir), root, P)
    return root


def stage_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from table to table, and the analysis they end with."""
    return fixed(tables.read_table(spark, ran(spark, sf_dir), "analysis", tables.ANALYSIS), "AVG_Spikers", "AVG_Grinders", "Difference", "Ratio")


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run, both CSV tables read back."""
    analysis, stats = tables.read_report(spark, ran(spark, sf_dir))
    rows = analysis.select("Time_Lag", "Indicator", fix(F.col("Difference")).alias("Value"))
    return rows.unionByName(stats.select(F.lit(None).cast("string").alias("Time_Lag"), F.col("Metric").alias("Indicator"), fix(F.col("Value")).alias("Value")))


def stage_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage alone over what earlier ones left: detection adds the days that came later, collection computes
    only what is new, and the analysis that follows with the number of events computed anew."""
    root = pipeline.shared_root(spark)
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    pipeline.analyze_stage(spark, root, P)  # there is nothing yet
    for known in (bars.where("bar_date < DATE '1997-01-01'"), bars):
        pipeline.detect_stage(known, root, P, fresh=False)
        computed = pipeline.collect_stage(spark, known, root, P, memo=True)
    pipeline.analyze_stage(spark, root, P)
    found = fixed(tables.read_table(spark, root, "analysis", tables.ANALYSIS), "AVG_Spikers", "AVG_Grinders", "Difference", "Ratio")
    return found.withColumn("computed", F.lit(computed).cast("long"))


def detect_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on snapshots with symbols without an exchange, in lower case or of another one, and with missing measures, by the day."""
    day = F.dayofyear("bar_date") % 6
    odd = all_snapshots(spark, sf_dir).withColumns({
        "symbol": F.when(day == 0, F.element_at(F.split("symbol", ":"), 2)).when(day == 1, F.lower("symbol")).when(day == 2, F.concat(F.lit("LSE:"), F.element_at(F.split("symbol", ":"), 2))).otherwise(F.col("symbol")),
        "change": F.when(day == 3, F.lit(None).cast("double")).otherwise(F.col("change")),
        "rec_vol_m": F.when(day == 4, F.lit(0.1)), "relative_volume_10d_calc_alt": F.lit(0.9),
        "relative_volume_10d_calc": F.when(day == 5, F.lit(float("nan"))).otherwise(F.col("relative_volume_10d_calc")),
    })
    return fixed(detect.detect_history(odd, dataclasses.replace(P, exchanges=("NASDAQ", "NYSE"))), "Price", "Change_%")


def repeated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw data where some candidates come twice, the second time without an exchange."""
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    found = pipeline.stored(pipeline.events_of_bars(bars, P), name="found")
    again = found.where(F.dayofmonth("Date") % 3 == 0).withColumn("Exchange", F.lit(None).cast("string"))
    rows = lags.collect(found.unionByName(again), bars, P)
    return fixed(rows.groupBy("Symbol", "Event_Date", "Exchange", "Time_Lag").agg(F.count("*").alias("rows"), F.max("close").alias("close")), "close")


def recursive_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive averages of every bar over its symbol's whole history, in blocks of 100 bars."""
    found = indicators.whole_histories(pipeline.stored(bar_source.line_bars(spark, sf_dir)), rows=100)
    return fixed(found, *indicators.RECURSIVE)


def recursive_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the larger universe, in blocks of the default size."""
    found = indicators.whole_histories(pipeline.stored(bar_source.supplier_bars(spark, sf_dir)))
    return fixed(found, *indicators.RECURSIVE)


def frames_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of fixed frames for every bar, computed in blocks of 250 bars with halos."""
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    found = indicators.bar_frame(bars, 250).select("symbol", "bar_date", "sma50", "sma200", "price_change_20d", "stoch_d_1", "ao", "volatility_20d", "mom_1", "volume_sma20")
    return fixed(found, *found.columns[2:])


def exact_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the line prices by flag and status, selected in rounds down to 500 values at most."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_extendedprice")
    ranks = F.array(*[F.floor((F.col("n") - 1) * k / 4) for k in range(5)])
    found = quantiles.order_statistics(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", ranks, 500)
    return found.withColumnRenamed("answer", "price")


def all_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the 62 indicators per lag, from the stored raw data."""
    found = extensions.correlations(pipeline.stored(raw(spark, sf_dir), name="raw"))
    return fixed(found, "Correlation")


def memo_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples through a memo: a run before the bars of some days came late, one after, and one more; what each computed and the last one's samples."""
    root = pipeline.shared_root(spark)
    bars = pipeline.stored(bar_source.line_bars(spark, sf_dir))
    keys = pipeline.stored(history.event_keys(pipeline.events_of_bars(bars, P)), name="keys")
    early = bars.where(~((F.year("bar_date") == 1996) & (F.dayofmonth("bar_date") == 13)))
    computed = [lags.remembered_samples(keys, b, P, root)[1] for b in (early, bars)]
    found, again = lags.remembered_samples(keys, bars, P, root)
    total = found.groupBy("lag").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"), fix(F.avg("close")).alias("close"))
    return total.select("lag", "rows", "volume", "close", *[F.lit(n).cast("long").alias(c) for c, n in (("first_run", computed[0]), ("second_run", computed[1]), ("third_run", again))])


def stage_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table after its old events were dropped: whole months by the commit, the border's written again."""
    root = pipeline.shared_root(spark)
    rows = raw(spark, sf_dir).select(*analyze.META, "close")
    tables.write_raw_data(rows, root)
    tables.retain_raw_data(spark, root, datetime.date(1998, 6, 1), P.retention_days)
    return fixed(tables.read_raw_data(spark, root, rows.schema), "close")


def stage_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the raw table, read side by side: the second replaced one lag."""
    root = pipeline.shared_root(spark)
    rows = raw(spark, sf_dir).select(*analyze.META, "close")
    tables.write_raw_data(rows, root)
    tables.write_raw_data(tables.read_raw_data(spark, root, rows.schema, (3,)).where("Event_Type = 'Spiker'"), root)
    each = [versions.read(spark, root, "raw_data", rows.schema, number=n).withColumn("version", F.lit(n)) for n in (1, 2)]
    return each[0].unionByName(each[1]).groupBy("version", "Time_Lag", "Event_Type").agg(F.count("*").alias("rows"), fix(F.avg("close")).alias("close"))


def stage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a run as the catalog lists them, with their rows as it reads them."""
    root = ran(spark, sf_dir)
    database = f"run_{root.rpartition('-')[2]}"
    tables.register_tables(spark, root, database)
    counts = [spark.table(f"`{database}`.`{t}`").agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows") for t in tables.list_tables(spark, database)]
    return functools.reduce(DataFrame.unionByName, counts)


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by the market of their exchange: eleven nations are listed on American ones, the others on their own."""
    listed = F.when(F.col("symbol").startswith("NATION_1"), "NYSEAmerican").otherwise(F.col("symbol"))
    bars = bar_source.supplier_bars(spark, sf_dir).withColumn("market", bar_source.market(listed))
    return bars.groupBy("market").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


def rows_without_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of samples of which some have no finite value at all, and so no row."""
    slices, bars = sliced(spark, sf_dir)
    sampled = lags.samples(slices, bars, P, ("close", "volume"))
    none = F.dayofmonth("event_date") % 4 == 0
    odd = sampled.withColumns({"close": F.when(none, F.lit(float("nan"))).otherwise(F.col("close")), "volume": F.when(none, F.lit(float("inf"))).otherwise(F.col("volume"))})
    rows = lags.raw_rows(pipeline.events_of_bars(bars, P), odd)
    return rows.groupBy("Time_Lag", "Event_Type").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


#: A look-back over which averages of 200 bars and the extremes of 252 are there.
YEAR = dataclasses.replace(P, lookback_days=400)


def year_query(*names: str):
    """The named indicators on the last bar before each event, over slices of 400 days."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = indicators.indicators(*sliced(spark, sf_dir, YEAR), names, YEAR.lookback_days)
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        last = frame.groupBy("symbol", "event_date").agg(F.max_by(row, "bar_date").alias("row"), F.count("*").alias("bars"))
        return last.select("symbol", "event_date", "bars", *[fix(F.col(f"row.`{c}`")).alias(c) for c in names])

    return query


YEAR_QUERIES = {
    "year_ema": ("EMA100", "EMA200", "EMA50_above_EMA200"),
    "year_sma": ("SMA100", "SMA200"),
    "year_extremes": ("high_52w", "low_52w", "price_vs_high_52w", "price_vs_low_52w"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison. Small tables have few bars a day, so the look-back is a year."""
    p = dataclasses.replace(P, lookback_days=365)
    return analyze.report_order(analyze.compare(raw(spark, sf_dir, p)))


QUERIES = {
    f.__name__: f
    for f in (
        bars_daily, bars_by_nation, snapshot, screener_filter, universe_filter, exchange_filter, top_movers, detect_events, detect_snapshot, event_counts, event_history, event_coverage,
        lag_asof, raw_data, lag_summary, overall_stats, distinct_lags, latest_per_symbol, grinder_consecutive, detect_lookback, sanitized, renamed, enough_samples, welch_test,
        indicator_correlations, retained_raw, stage_round_trip, stage_candidates, stage_append, stage_raw_all, stage_backup, stage_analysis, stage_report, detect_odd, repeated_candidates,
        recursive_histories, recursive_by_nation, frames_in_blocks, exact_quartiles, all_correlations, memo_rerun, stage_retained, stage_versions, stage_listing,
        markets, rows_without_values, welch_discoveries, asof_bars, asof_purchases, asof_orders, stage_by_stage,
    )
} | {k: indicator_query(*names) for k, names in INDICATOR_QUERIES.items()} | {k: year_query(*names) for k, names in YEAR_QUERIES.items()}
