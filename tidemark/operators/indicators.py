"""62 technical indicators over each event's slice, as window expressions.

Columns whose frame has a fixed length don't depend on where a slice begins, but for
the rows too near its beginning, where they are NULL. They are computed once a bar, over
the symbol's history in blocks with halos, and joined to the rows that are wanted. Recursive averages, the VWAP,
the extremes of a year and what looks at a slice's first bar are computed in each slice: windows
partitioned by event and ordered by day, so that one shuffle and one sort serve them all.
Columns have plain names here; ``NAMES`` gives the published ones, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cumulative, ema, flag, full, percent, trailing
from tidemark.operators import blocks
from tidemark.operators.blocks import Average

EVENT = ("symbol", "event_date")
EMAS = (5, 10, 20, 50, 100, 200)

#: Published column names, in order.
PUBLISHED = (
    "close open high low volume RSI RSI[1] Mom Mom[1] MACD.macd MACD.signal MACD_diff Stoch.K Stoch.D Stoch.K[1] Stoch.D[1] ADX ADX+DI ADX-DI CCI20 AO W.R UO "
    "BB.upper BB.lower BB.middle BB_width BBPower ATR EMA5 EMA10 EMA20 EMA50 EMA100 EMA200 SMA5 SMA10 SMA20 SMA50 SMA100 SMA200 volume_sma5 volume_sma20 volume_ratio "
    "price_change_1d price_change_3d price_change_5d price_change_10d price_change_20d volatility_20d EMA20_above_EMA50 EMA50_above_EMA200 price_above_EMA20 EMA10_above_EMA20 "
    "high_52w low_52w price_vs_high_52w price_vs_low_52w gap_% gap_up gap_down VWAP"
).split()
#: Names that differ from the plain ones.
PLAIN = {
    "RSI": "rsi", "RSI[1]": "rsi_1", "Mom": "mom", "Mom[1]": "mom_1", "MACD.macd": "macd", "MACD.signal": "macd_signal", "MACD_diff": "macd_diff", "Stoch.K": "stoch_k", "Stoch.D": "stoch_d",
    "Stoch.K[1]": "stoch_k_1", "Stoch.D[1]": "stoch_d_1", "ADX": "adx", "ADX+DI": "di_plus", "ADX-DI": "di_minus", "CCI20": "cci", "AO": "ao", "W.R": "williams", "UO": "uo", "BB.upper": "bb_upper",
    "BB.lower": "bb_lower", "BB.middle": "bb_middle", "BB_width": "bb_width", "BBPower": "bb_power", "ATR": "atr", "gap_%": "gap_pct", "VWAP": "vwap",
}
NAMES = {name: PLAIN.get(name, name.lower()) for name in PUBLISHED}


#: Columns that are 1 or 0.
FLAGS = ("EMA20_above_EMA50", "EMA50_above_EMA200", "price_above_EMA20", "EMA10_above_EMA20", "gap_up", "gap_down")


def window():
    return Window.partitionBy(*EVENT).orderBy("bar_date")


#: Of each column computed once a bar: how many bars of the slice must lie before it.
DEPTH = (
    {f"sma{n}": n - 1 for n in EMAS} | {f"price_change_{k}d": k for k in (1, 3, 5, 10, 20)} | {"mom": 10, "mom_1": 11, "stoch_k": 13, "stoch_k_1": 14, "stoch_d": 15, "stoch_d_1": 16, "williams": 13, "ao": 33, "cci": 19}
    | {c: 19 for c in ("bb_upper", "bb_lower", "bb_middle", "bb_width", "bb_power", "volume_sma20", "volume_ratio")} | {"volume_sma5": 4, "volatility_20d": 20, "gap_pct": 1, "gap_up": 1, "gap_down": 1}
)


#: The bars whose columns of DEPTH a task computes; as many as the longest frame precede them.
BLOCK_ROWS = 2048


def bar_frame(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """symbol, bar_date and the columns of DEPTH, once for each bar, over the symbol's history (a row a day).

    A history is cut into blocks of ``rows`` bars with the bars before that the frames reach back to.
    """
    w = Window.partitionBy("symbol", "block").orderBy("bar_date")
    c, v, tp, hl2 = F.col("close"), F.col("volume"), F.col("tp"), F.col("hl2")
    placed = blocks.positions(bars.select("symbol", "bar_date", "open", "high", "low", "close", "volume"), ["symbol"], "bar_date", blocks.days("bar_date", rows))
    base = blocks.with_halo(placed, rows, max(DEPTH.values())).withColumns(
        {f"c{k}": F.lag("close", k).over(w) for k in (1, 3, 5, 10, 20)} | {"tp": (F.col("high") + F.col("low") + c) / 3, "hl2": (F.col("high") + F.col("low")) / 2}
    )
    changed = base.withColumns({f"price_change_{k}d": percent(c, F.col(f"c{k}")) for k in (1, 3, 5, 10, 20)} | {"gap_pct": F.try_divide(F.col("open") - F.col("c1"), F.col("c1")) * 100})
    out = changed.withColumns(
        {f"sma{n}": full(F.avg, c, w, n) for n in EMAS}
        | {"mom": c - F.col("c10"), "ll": full(F.min, F.col("low"), w, 14), "hh": full(F.max, F.col("high"), w, 14), "ao": full(F.avg, hl2, w, 5) - full(F.avg, hl2, w, 34)}
        | {"sigma": full(F.stddev_pop, c, w, 20), "volume_sma5": full(F.avg, v, w, 5), "volume_sma20": full(F.avg, v, w, 20), "volatility_20d": full(F.stddev_samp, F.col("price_change_1d"), w, 20) * (252**0.5)}
        | {"tp_mean": full(F.avg, tp, w, 20), "tps": full(F.collect_list, tp, w, 20)}
    )
    deviation = F.aggregate(F.col("tps"), F.lit(0.0), lambda total, x: total + F.abs(x - F.col("tp_mean"))) / 20
    span = F.col("hh") - F.col("ll")
    out = out.withColumns({
        "stoch_k": F.try_divide(c - F.col("ll"), span) * 100, "williams": F.try_divide(F.col("hh") - c, span) * -100, "cci": F.try_divide(tp - F.col("tp_mean"), 0.015 * deviation),
        "bb_middle": F.col("sma20"), "bb_upper": F.col("sma20") + 2 * F.col("sigma"), "bb_lower": F.col("sma20") - 2 * F.col("sigma"), "volume_ratio": F.try_divide(v, F.col("volume_sma20")),
        "gap_up": flag(F.col("gap_pct") > 2), "gap_down": flag(F.col("gap_pct") < -2), "mom_1": F.lag("mom").over(w),
    }).withColumns({
        "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")) * 100, "bb_power": F.try_divide(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        "stoch_d": full(F.avg, F.col("stoch_k"), w, 3),
    }).withColumns({"stoch_k_1": F.lag("stoch_k").over(w), "stoch_d_1": F.lag("stoch_d").over(w)})
    return out.where(~F.col("in_halo")).select("symbol", "bar_date", *DEPTH)


def movements(bars: DataFrame, w) -> DataFrame:
    """What a bar shows beside the one before it: gains, losses, directional movement, true range."""
    c = F.col("close")
    lagged = bars.withColumns({"c1": F.lag("close").over(w), "h1": F.lag("high").over(w), "l1": F.lag("low").over(w)})
    delta, up, down = c - F.col("c1"), F.col("high") - F.col("h1"), F.col("l1") - F.col("low")
    zero = F.lit(0.0)
    return lagged.withColumns({
        "gain": F.when(delta.isNotNull(), F.greatest(delta, zero)), "loss": F.when(delta.isNotNull(), F.greatest(-delta, zero)),
        "plus_dm": F.when(up.isNotNull() & down.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(zero)),
        "minus_dm": F.when(up.isNotNull() & down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(zero)),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("c1")), F.abs(F.col("low") - F.col("c1"))),
    })


def base(sliced: DataFrame) -> DataFrame:
    """What columns of a slice share."""
    w = window()
    made = movements(sliced.withColumn("place", F.row_number().over(w) - 1), w)
    return made.withColumns({"bp": F.col("close") - F.least(F.col("low"), F.col("c1")), "tp": (F.col("high") + F.col("low") + F.col("close")) / 3})


def from_the_start(df: DataFrame, longest: int | None) -> DataFrame:
    """What looks at a slice's first bar, other than recursive averages. Slices of ``longest`` rows
    or fewer, if that is known to be below a year's, need no sliding frame for its extremes."""
    w = window()
    year = cumulative(w) if longest and longest <= 252 else trailing(w, 252)
    average = lambda n: F.try_divide(full(F.sum, F.col("bp"), w, n), full(F.sum, F.col("tr"), w, n))
    out = df.withColumns({
        "uo": 100 * (4 * average(7) + 2 * average(14) + average(28)) / 7, "high_52w": F.max("high").over(year), "low_52w": F.min("low").over(year),
        "vwap": F.try_divide(F.sum(F.col("tp") * F.col("volume")).over(cumulative(w)), F.sum("volume").over(cumulative(w))),
    })
    return out.withColumns({"price_vs_high_52w": percent(F.col("close"), F.col("high_52w")), "price_vs_low_52w": percent(F.col("close"), F.col("low_52w"))})


#: Averages of what a bar shows, and those of what rests on them.
FIRST = (
    [Average(f"ema{k}", "close", 2 / (k + 1), k) for k in EMAS] + [Average("fast", "close", 2 / 13, 12), Average("slow", "close", 2 / 27, 26), Average("atr", "tr", 1 / 14, 14)]
    + [Average(f"avg_{x}", x, 1 / 14, 14) for x in ("gain", "loss", "plus_dm", "minus_dm")]
)
SECOND = [Average("macd_signal", "macd", 0.2, 9), Average("adx", "dx", 1 / 14, 14)]
#: A slice has a bar a day at most, and (2/3) ** -1700 is the last power of its kind that a double holds well.
LONGEST_SUM = 1700


def averages_in_slices(df: DataFrame, series: list[Average], longest: int | None) -> DataFrame:
    """The averages over each slice: as running sums where slices are known to be short enough, else block by block."""
    if not longest or longest > LONGEST_SUM:
        cut = df.withColumn("block", F.floor(F.col("place") / blocks.BLOCK_ROWS))
        return blocks.averages(cut, series, list(EVENT), "bar_date").drop("block")
    w = window()
    values = list(dict.fromkeys(s.value for s in series))
    seen = {v: f"_seen{i}" for i, v in enumerate(values)}
    counted = df.withColumns({seen[v]: F.count(v).over(cumulative(w)) for v in values})
    return counted.withColumns({s.name: ema(F.col(s.value), F.col(seen[s.value]), s.alpha, s.least, w) for s in series}).drop(*seen.values())


def between_averages(df: DataFrame) -> DataFrame:
    """What rests on the first averages."""
    c = F.col("close")
    made = df.withColumns({
        "macd": F.col("fast") - F.col("slow"),
        "rsi": F.when(F.col("avg_loss") == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("avg_gain", "avg_loss"))),
        "di_plus": F.try_divide("avg_plus_dm", "atr") * 100, "di_minus": F.try_divide("avg_minus_dm", "atr") * 100,
        "ema20_above_ema50": flag(F.col("ema20") > F.col("ema50")), "ema50_above_ema200": flag(F.col("ema50") > F.col("ema200")),
        "price_above_ema20": flag(c > F.col("ema20")), "ema10_above_ema20": flag(F.col("ema10") > F.col("ema20")),
    })
    return made.withColumn("dx", F.try_divide(F.abs(F.col("di_plus") - F.col("di_minus")), F.col("di_plus") + F.col("di_minus")) * 100)


def recursive(df: DataFrame, longest: int | None) -> DataFrame:
    """Exponential averages of slices and what rests on them."""
    derived = between_averages(averages_in_slices(df, FIRST, longest)).withColumn("rsi_1", F.lag("rsi").over(window()))
    return averages_in_slices(derived, SECOND, longest).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))


#: Columns of whole_histories.
RECURSIVE = (*[f"ema{k}" for k in EMAS], "macd", "macd_signal", "macd_diff", "rsi", "atr", "di_plus", "di_minus", "adx")


def whole_histories(bars: DataFrame, rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """symbol, bar_date and the columns of RECURSIVE for every bar, over the symbol's history from its first bar on.

    Histories of any length: tasks hold blocks of ``rows`` bars.
    """
    placed = blocks.positions(bars.select("symbol", "bar_date", "high", "low", "close"), ["symbol"], "bar_date", blocks.days("bar_date", rows))
    w = Window.partitionBy("symbol", "block").orderBy("bar_date")
    made = movements(blocks.with_halo(placed, rows, 1), w).where(~F.col("in_halo"))
    derived = between_averages(blocks.averages(made, FIRST, ["symbol"], "bar_date"))
    out = blocks.averages(derived, SECOND, ["symbol"], "bar_date").withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    return out.select("symbol", "bar_date", *RECURSIVE)


def slice_frame(sliced: DataFrame, longest: int | None = None) -> DataFrame:
    """Each bar of each slice with its place there (0 is the first) and the columns computed in slices.

    sliced: bars of events, dealt by event. Columns that a later select leaves
    out are pruned with their windows.
    """
    made = recursive(from_the_start(base(sliced), longest), longest)
    return made.select(*EVENT, "bar_date", "place", *[c for c in NAMES.values() if c not in DEPTH])


def published(rows: DataFrame, bars: DataFrame, names: tuple[str, ...] = tuple(PUBLISHED)) -> DataFrame:
    """Rows of a slice_frame, all or some, with the named columns in place of the plain ones.

    Those of DEPTH come from the bars, by symbol and day, and count where the slice reaches back far enough.
    """
    plain = {NAMES[n] for n in names}
    rest = [c for c in rows.columns if c not in NAMES.values() and c != "place"]
    if plain & DEPTH.keys():
        once = bar_frame(bars).select(F.col("symbol").alias("_symbol"), F.col("bar_date").alias("_day"), *sorted(plain & DEPTH.keys()))
        rows = rows.join(once, (F.col("symbol") == F.col("_symbol")) & (F.col("bar_date") == F.col("_day")))
    deep = lambda c: F.when(F.col("place") >= DEPTH[c], F.col(c)) if c in DEPTH else F.col(c)
    zero = lambda c, x: F.coalesce(x, F.lit(0)) if c in ("gap_up", "gap_down") else x
    return rows.select(*rest, *[zero(NAMES[n], deep(NAMES[n])).alias(n) for n in names])


def indicators(sliced: DataFrame, bars: DataFrame, names: tuple[str, ...] = tuple(PUBLISHED), longest: int | None = None) -> DataFrame:
    """symbol, event_date, bar_date and the named columns for every bar of every slice."""
    return published(slice_frame(sliced, longest), bars, names)
