"""Indicators as of some days before each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.history import event_keys, slices, with_history
from tidemark.operators.indicators import EVENT, PUBLISHED, published, slice_frame, window
from tidemark.params import Params
from tidemark.sources import versions
from tidemark.sources.shared import stored


def as_of_lags(frame: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """For each event and lag the row of the last bar on or before that many calendar days earlier.

    A bar serves a lag's day if it lies between the bar and the next one, so each
    row knows by its successor which lags it serves, and only those rows go on:
    no row is copied for a lag it doesn't serve, and nothing is shuffled or
    grouped again. A lag before the event's first bar has no row.
    """
    values = [c for c in frame.columns if c not in (*EVENT, "bar_date")]
    after = F.lead("bar_date").over(window())
    serves = lambda k: (F.col("bar_date") <= F.date_sub("event_date", k)) & F.coalesce(F.col("_next") > F.date_sub("event_date", k), F.lit(True))
    served = F.filter(F.array(*[F.lit(k) for k in lags]), serves)
    return frame.withColumn("_next", after).withColumn("lag", F.explode(served)).select(*EVENT, "lag", "bar_date", *[F.col(f"`{c}`") for c in values])


def raw_rows(candidates: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows of the raw data: each candidate with its samples, lags as ``T-k``.

    Values are made finite; rows without any are dropped; repeated candidates
    give repeated rows.
    """
    values = [c for c in sampled.columns if c not in (*EVENT, "lag", "bar_date")]
    types = dict(sampled.dtypes)
    clean = {c: finite(F.col(f"`{c}`")) if types[c] == "double" else F.col(f"`{c}`") for c in values}
    some = F.coalesce(*[x.cast("double") for x in clean.values()]).isNotNull()
    keys = candidates.select("Symbol", F.col("Date").alias("Event_Date"), "Event_Type", F.coalesce("Exchange", F.lit("NASDAQ")).alias("Exchange"))
    joined = keys.join(sampled.where(some).withColumnsRenamed({"symbol": "_symbol", "event_date": "_event_date"}), (F.col("Symbol") == F.col("_symbol")) & (F.col("Event_Date") == F.col("_event_date")))
    label = F.concat(F.lit("T-"), F.col("lag").cast("string"))
    return joined.select("Symbol", "Event_Date", "Event_Type", "Exchange", label.alias("Time_Lag"), *[x.alias(c) for c, x in clean.items()])


def collect(candidates: DataFrame, bars: DataFrame, p: Params) -> DataFrame:
    """Slices, history filter, indicators and samples of all candidates."""
    sliced = with_history(slices(event_keys(candidates), bars, p.lookback_days), p.min_bars)
    return raw_rows(candidates, samples(sliced, bars, p))


#: A memo's key, and the marker of an event that was computed, which has no lag.
MEMO_KEY = (*EVENT, "print")


def slice_prints(sliced: DataFrame, p: Params) -> DataFrame:
    """symbol, event_date, print: a fingerprint of each slice's bars and of what else its samples depend on."""
    bar = F.xxhash64("bar_date", "open", "high", "low", "close", "volume")
    said = F.concat_ws(":", F.lit(f"{p.lookback_days}:{p.min_bars}:{','.join(map(str, p.lags))}"), F.count("*"), F.bit_xor(bar), F.sum(bar.cast("decimal(38,0)")))
    return sliced.groupBy(*EVENT).agg(said.alias("print"))


def remembered_samples(events: DataFrame, bars: DataFrame, p: Params, root: str, name: str = "memo") -> tuple[DataFrame, int]:
    """(samples of all events, number of events computed in this run).

    events: symbol, event_date. A versioned table below root remembers the samples of every
    slice ever computed, by event and fingerprint. What it lacks, because the event is new or its bars have changed, is computed
    and added in one commit, with a row without a lag for each event, so that events too short for samples are remembered as well.
    """
    spark = bars.sparkSession
    prints = stored(slice_prints(slices(events, bars, p.lookback_days), p), name="prints")
    known = versions.read(spark, root, name)
    new = prints if known is None else prints.join(known.where("lag is null").select(*MEMO_KEY), list(MEMO_KEY), "left_anti")
    new = stored(new, name="new")
    n = new.count()
    if n:
        sliced = with_history(slices(new.select(*EVENT), bars, p.lookback_days), p.min_bars)
        made = samples(sliced, bars, p).join(new, list(EVENT))
        versions.write(made.unionByName(new, allowMissingColumns=True), root, name, keep=lambda v, _: True)
        known = versions.read(spark, root, name)
    if known is None:
        return samples(with_history(slices(events.limit(0), bars, p.lookback_days), p.min_bars), bars, p), 0
    return known.where("lag is not null").join(prints, list(MEMO_KEY)).drop("print"), n


def samples(sliced: DataFrame, bars: DataFrame, p: Params, names: tuple[str, ...] = tuple(PUBLISHED)) -> DataFrame:
    """Indicators as of each lag: only the rows that serve one are joined with what is computed once a bar."""
    return published(as_of_lags(slice_frame(sliced, p.lookback_days), p.lags), bars, names)


def latest_per_symbol(frame: DataFrame) -> DataFrame:
    """Each symbol's current indicators: the row of its last bar of its last event."""
    values = [c for c in frame.columns if c != "symbol"]
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    latest = frame.groupBy("symbol").agg(F.max_by(row, F.struct("bar_date", "event_date")).alias("row"))
    return latest.select("symbol", *[F.col(f"row.`{c}`").alias(c) for c in values])
