"""DuckDB SQL for every registered query of the event engine.

Common table expressions build bars, snapshots, events and slices; recursive
averages are folds over lists, unlike the running sums of the engine.
"""

from __future__ import annotations


def fix(c: str) -> str:
    return f"floor(({c})::DOUBLE * 1000 + 0.37) / 1000"


def bars_of(symbol: str, join: str) -> str:
    key = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    return f"""SELECT {symbol} AS symbol, l_shipdate::DATE AS bar_date, arg_min(l_extendedprice / l_quantity, {key}) AS open, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {key}) AS close, sum(l_quantity) AS volume FROM lineitem {join} GROUP BY ALL"""


BARS = bars_of("p_type", "JOIN part ON l_partkey = p_partkey")
NATION_BARS = bars_of("n_name", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
EXCHANGE = "CASE WHEN symbol LIKE 'ECONOMY%' OR symbol LIKE 'STANDARD%' THEN 'NASDAQ' WHEN symbol LIKE 'MEDIUM%' OR symbol LIKE 'SMALL%' THEN 'NYSE' ELSE 'AMEX' END"
SNAP = f"""bars AS ({BARS}),
snap AS (SELECT bar_date, symbol AS bare, {EXCHANGE} AS exchange, 'america' AS market, {EXCHANGE} || ':' || symbol AS symbol, close, volume,
  (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS change, close - lag(close) OVER w AS change_abs,
  volume / nullif(avg(volume) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS rel
  FROM bars WINDOW w AS (PARTITION BY bars.symbol ORDER BY bar_date))"""
EVENTS = f"""{SNAP},
events AS (SELECT bar_date AS Date, bare AS Symbol, exchange AS Exchange, CASE WHEN coalesce(change, change_abs, 0) >= 15 THEN 'Spiker'
  WHEN coalesce(change, change_abs, 0) >= 0.5 AND coalesce(rel, 1) >= 0.8 THEN 'Grinder' END AS Event_Type, close AS Price, coalesce(change, change_abs, 0) AS "Change_%", volume AS Volume
  FROM snap WHERE close > 0.5 AND volume > 35 AND change_abs IS NOT NULL AND Event_Type IS NOT NULL)"""
SLICES = f"""{EVENTS},
slices AS (SELECT b.symbol, e.event_date, b.bar_date, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT Symbol, Date AS event_date FROM events) e
  JOIN bars b ON b.symbol = e.Symbol AND b.bar_date >= e.event_date - 90 AND b.bar_date < e.event_date QUALIFY count(*) OVER (PARTITION BY b.symbol, e.event_date) >= 50)"""
W = "WINDOW w AS (PARTITION BY symbol, event_date ORDER BY bar_date)"
FRAME = "(PARTITION BY symbol, event_date ORDER BY bar_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def full(f: str, x: str, n: int) -> str:
    frame = FRAME.format(n - 1)
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {f}({x}) OVER {frame} END"


def fold(values: str, alpha: float, n: int) -> str:
    """The recursive average of a list, NULL below n values."""
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce({values}, lambda a, b: {1 - alpha!r} * a + {alpha!r} * b) END"


def so_far(x: str) -> str:
    """The non-null values up to each row, as a list."""
    return f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY symbol, event_date ORDER BY bar_date ROWS UNBOUNDED PRECEDING)"


#: The layers below add columns to slices, each as "name AS expression".
BASE = f"""{SLICES},
base AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, (high + low + close) / 3 AS tp, (high + low) / 2 AS hl2, row_number() OVER w AS i FROM slices {W}),
step AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS gain, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS loss,
  CASE WHEN h1 IS NOT NULL THEN CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END END AS pdm,
  CASE WHEN h1 IS NOT NULL THEN CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END END AS mdm,
  greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, close - least(low, c1) AS bp, (close / nullif(c1, 0) - 1) * 100 AS chg, (open - c1) / nullif(c1, 0) * 100 AS gap FROM base)"""


def last_rows(cte: str, source: str, columns: dict[str, str], window: str = "") -> str:
    """The query of one indicator group: values on each slice's last bar, and counts."""
    made = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    values = ", ".join(f'{fix(f"""arg_max_null("{c}", bar_date)""")} AS "{c}"' for c in columns)
    counts = ", ".join(f'count("{c}") AS n_{i}' for i, c in enumerate(columns))
    return f"WITH {cte}, made AS (SELECT symbol, event_date, bar_date, {made} FROM {source} {window}) SELECT symbol, event_date, {values}, {counts} FROM made GROUP BY symbol, event_date"


EMAS = (5, 10, 20, 50, 100, 200)
LISTS = f"{BASE}, lists AS (SELECT *, {so_far('close')} AS closes FROM step)"
EMA_CTE = LISTS + ", emas AS (SELECT *, " + ", ".join(f"{fold('closes', 2 / (n + 1), n)} AS ema{n}" for n in EMAS) + " FROM lists)"
MACD_CTE = f"{LISTS}, m AS (SELECT *, {fold('closes', 2 / 13, 12)} - {fold('closes', 2 / 27, 26)} AS macd FROM lists), ms AS (SELECT *, {so_far('macd')} AS macds FROM m), sg AS (SELECT *, {fold('macds', 0.2, 9)} AS sig FROM ms)"
RSI_CTE = f"{BASE}, g AS (SELECT *, {so_far('gain')} AS gs, {so_far('loss')} AS ls FROM step), a AS (SELECT *, {fold('gs', 1 / 14, 14)} AS ag, {fold('ls', 1 / 14, 14)} AS al FROM g), r AS (SELECT *, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM a)"
ATR_CTE = f"{BASE}, g AS (SELECT *, {so_far('tr')} AS trs, {so_far('pdm')} AS ps, {so_far('mdm')} AS ns FROM step), a AS (SELECT *, {fold('trs', 1 / 14, 14)} AS atr, {fold('ps', 1 / 14, 14)} AS ap, {fold('ns', 1 / 14, 14)} AS an FROM g)"
ADX_CTE = f"{ATR_CTE}, d AS (SELECT *, 100 * ap / nullif(atr, 0) AS dip, 100 * an / nullif(atr, 0) AS dim FROM a), x AS (SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM d), y AS (SELECT *, {so_far('dx')} AS dxs FROM x)"
LL, HH = full("min", "low", 14), full("max", "high", 14)
STOCH_CTE = f"{BASE}, k AS (SELECT *, {LL} AS ll, {HH} AS hh FROM step), k2 AS (SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS k FROM k), k3 AS (SELECT *, {full('avg', 'k', 3)} AS d FROM k2)"
BB_CTE = f"{BASE}, s AS (SELECT *, {full('avg', 'close', 20)} AS m, {full('stddev_pop', 'close', 20)} AS sd FROM step)"
CCI_CTE = f"{BASE}, s AS (SELECT *, {full('avg', 'tp', 20)} AS m, {full('list', 'tp', 20)} AS tps FROM step)"
RATIO = lambda n: f"({full('sum', 'bp', n)}) / nullif({full('sum', 'tr', n)}, 0)"
YEAR = FRAME.format(251)
ALL = "(PARTITION BY symbol, event_date ORDER BY bar_date ROWS UNBOUNDED PRECEDING)"
FLAG = "coalesce({}, false)::INT"

INDICATORS = {
    "ind_price": last_rows(SLICES, "slices", {c: c for c in ("close", "open", "high", "low", "volume")}),
    "ind_sma": last_rows(BASE, "step", {f"SMA{n}": full("avg", "close", n) for n in EMAS}),
    "ind_price_change": last_rows(BASE, "step", {f"price_change_{k}d": f"(close / nullif(lag(close, {k}) OVER w, 0) - 1) * 100" for k in (1, 3, 5, 10, 20)}, W),
    "ind_bollinger": last_rows(BB_CTE, "s", {"BB.upper": "m + 2 * sd", "BB.lower": "m - 2 * sd", "BB.middle": "m", "BB_width": "4 * sd / nullif(m, 0) * 100", "BBPower": "(close - (m - 2 * sd)) / nullif(4 * sd, 0)"}),
    "ind_stochastic": last_rows(STOCH_CTE, "k3", {"Stoch.K": "k", "Stoch.D": "d", "Stoch.K[1]": "lag(k) OVER w", "Stoch.D[1]": "lag(d) OVER w"}, W),
    "ind_williams": last_rows(STOCH_CTE, "k3", {"W.R": "-100 * (hh - close) / nullif(hh - ll, 0)"}),
    "ind_cci": last_rows(CCI_CTE, "s", {"CCI20": "(tp - m) / nullif(0.015 * list_sum(list_transform(tps, lambda x: abs(x - m))) / 20, 0)"}),
    "ind_ao": last_rows(BASE, "step", {"AO": f"({full('avg', 'hl2', 5)}) - ({full('avg', 'hl2', 34)})"}),
    "ind_uo": last_rows(BASE, "step", {"UO": f"100 * (4 * {RATIO(7)} + 2 * {RATIO(14)} + {RATIO(28)}) / 7"}),
    "ind_volume": last_rows(BASE, "step", {"volume_sma5": full("avg", "volume", 5), "volume_sma20": full("avg", "volume", 20), "volume_ratio": f"volume / nullif({full('avg', 'volume', 20)}, 0)"}),
    "ind_volatility": last_rows(BASE, "step", {"volatility_20d": f"({full('stddev_samp', 'chg', 20)}) * sqrt(252)"}),
    "ind_52w": last_rows(BASE, "step", {"high_52w": f"max(high) OVER {YEAR}", "low_52w": f"min(low) OVER {YEAR}", "price_vs_high_52w": f"(close / nullif(max(high) OVER {YEAR}, 0) - 1) * 100", "price_vs_low_52w": f"(close / nullif(min(low) OVER {YEAR}, 0) - 1) * 100"}),
    "ind_gap": last_rows(BASE, "step", {"gap_%": "gap", "gap_up": FLAG.format("gap > 2"), "gap_down": FLAG.format("gap < -2")}),
    "ind_vwap": last_rows(BASE, "step", {"VWAP": f"sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0)"}),
    "ind_momentum": last_rows(BASE, "step", {"Mom": "close - lag(close, 10) OVER w", "Mom[1]": "c1 - lag(close, 11) OVER w"}, W),
    "ind_ema": last_rows(EMA_CTE, "emas", {f"EMA{n}": f"ema{n}" for n in EMAS}),
    "ind_macd": last_rows(MACD_CTE, "sg", {"MACD.macd": "macd", "MACD.signal": "sig", "MACD_diff": "macd - sig"}),
    "ind_rsi": last_rows(RSI_CTE, "r", {"RSI": "rsi", "RSI[1]": "lag(rsi) OVER w"}, W),
    "ind_atr": last_rows(ATR_CTE, "a", {"ATR": "atr"}),
    "ind_adx": last_rows(ADX_CTE, "y", {"ADX": fold("dxs", 1 / 14, 14), "ADX+DI": "dip", "ADX-DI": "dim"}),
    "ind_trend_flags": last_rows(EMA_CTE, "emas", {"EMA20_above_EMA50": FLAG.format("ema20 > ema50"), "EMA50_above_EMA200": FLAG.format("ema50 > ema200"), "price_above_EMA20": FLAG.format("close > ema20"), "EMA10_above_EMA20": FLAG.format("ema10 > ema20")}),
}

FRAME_CTE = f"""{BASE}, ind AS (SELECT *, {full('avg', 'close', 5)} AS SMA5, {full('avg', 'close', 20)} AS SMA20, chg AS price_change_1d, (close / nullif(lag(close, 5) OVER w, 0) - 1) * 100 AS price_change_5d,
  max(high) OVER {YEAR} AS high_52w, min(low) OVER {YEAR} AS low_52w, {FLAG.format('gap > 2')} AS gap_up, {FLAG.format('gap < -2')} AS gap_down, sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0) AS vwap FROM step {W})"""
SAMPLED = f"""{FRAME_CTE}, wanted AS (SELECT symbol, event_date, lag, event_date - lag AS lag_date FROM (SELECT DISTINCT symbol, event_date FROM slices), (VALUES (1), (3), (5), (10), (30)) t(lag)),
sampled AS (SELECT w.lag, ind.* FROM wanted w ASOF JOIN ind ON w.symbol = ind.symbol AND w.event_date = ind.event_date AND w.lag_date >= ind.bar_date)"""
RAW = f"{SAMPLED}, raw AS (SELECT e.Symbol, e.Date AS Event_Date, e.Event_Type, e.Exchange, 'T-' || lag AS Time_Lag, s.* EXCLUDE (symbol, event_date) FROM events e JOIN sampled s ON s.symbol = e.Symbol AND s.event_date = e.Date)"

#: All 62 columns on one frame: lists and rolling values, then averages of the lists, then what rests on those.
A1 = f"""a1 AS (SELECT *, {so_far('close')} AS closes, {so_far('gain')} AS gs, {so_far('loss')} AS ls, {so_far('tr')} AS trs, {so_far('pdm')} AS ps, {so_far('mdm')} AS ns, {LL} AS ll, {HH} AS hh,
  {full('avg', 'close', 20)} AS m, {full('stddev_pop', 'close', 20)} AS sd, {full('avg', 'tp', 20)} AS tpm, {full('list', 'tp', 20)} AS tps, {full('avg', 'volume', 20)} AS v20 FROM step)"""
A2 = f"""a2 AS (SELECT * EXCLUDE (closes, gs, ls, trs, ps, ns, tps), {', '.join(f"{fold('closes', 2 / (n + 1), n)} AS ema{n}" for n in EMAS)}, {fold('closes', 2 / 13, 12)} - {fold('closes', 2 / 27, 26)} AS macd,
  {fold('gs', 1 / 14, 14)} AS ag, {fold('ls', 1 / 14, 14)} AS al, {fold('trs', 1 / 14, 14)} AS atr, {fold('ps', 1 / 14, 14)} AS ap, {fold('ns', 1 / 14, 14)} AS an,
  (tp - tpm) / nullif(0.015 * list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 20, 0) AS cci, 100 * (close - ll) / nullif(hh - ll, 0) AS k FROM a1)"""
A3 = f"""a3 AS (SELECT *, CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi, 100 * ap / nullif(atr, 0) AS dip, 100 * an / nullif(atr, 0) AS dim, {full('avg', 'k', 3)} AS d FROM a2)"""
A4 = f"""a4 AS (SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx, {so_far('macd')} AS macds FROM a3), a5 AS (SELECT *, {fold('macds', 0.2, 9)} AS sig, {so_far('dx')} AS dxs FROM a4)"""
EVERY = (
    {c: c for c in ("close", "open", "high", "low", "volume")}
    | {"RSI": "rsi", "RSI[1]": "lag(rsi) OVER w", "Mom": "close - lag(close, 10) OVER w", "Mom[1]": "c1 - lag(close, 11) OVER w", "MACD.macd": "macd", "MACD.signal": "sig", "MACD_diff": "macd - sig"}
    | {"Stoch.K": "k", "Stoch.D": "d", "Stoch.K[1]": "lag(k) OVER w", "Stoch.D[1]": "lag(d) OVER w", "ADX": fold("dxs", 1 / 14, 14), "ADX+DI": "dip", "ADX-DI": "dim", "CCI20": "cci"}
    | {"AO": f"({full('avg', 'hl2', 5)}) - ({full('avg', 'hl2', 34)})", "W.R": "-100 * (hh - close) / nullif(hh - ll, 0)", "UO": f"100 * (4 * {RATIO(7)} + 2 * {RATIO(14)} + {RATIO(28)}) / 7"}
    | {"BB.upper": "m + 2 * sd", "BB.lower": "m - 2 * sd", "BB.middle": "m", "BB_width": "4 * sd / nullif(m, 0) * 100", "BBPower": "(close - (m - 2 * sd)) / nullif(4 * sd, 0)", "ATR": "atr"}
    | {f"EMA{n}": f"ema{n}" for n in EMAS} | {f"SMA{n}": full("avg", "close", n) for n in EMAS}
    | {"volume_sma5": full("avg", "volume", 5), "volume_sma20": "v20", "volume_ratio": "volume / nullif(v20, 0)"}
    | {f"price_change_{k}d": f"(close / nullif(lag(close, {k}) OVER w, 0) - 1) * 100" for k in (1, 3, 5, 10, 20)} | {"volatility_20d": f"({full('stddev_samp', 'chg', 20)}) * sqrt(252)"}
    | {"EMA20_above_EMA50": FLAG.format("ema20 > ema50"), "EMA50_above_EMA200": FLAG.format("ema50 > ema200"), "price_above_EMA20": FLAG.format("close > ema20"), "EMA10_above_EMA20": FLAG.format("ema10 > ema20")}
    | {"high_52w": f"max(high) OVER {YEAR}", "low_52w": f"min(low) OVER {YEAR}", "price_vs_high_52w": f"(close / nullif(max(high) OVER {YEAR}, 0) - 1) * 100", "price_vs_low_52w": f"(close / nullif(min(low) OVER {YEAR}, 0) - 1) * 100"}
    | {"gap_%": "gap", "gap_up": FLAG.format("gap > 2"), "gap_down": FLAG.format("gap < -2"), "VWAP": f"sum(tp * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0)"}
)
EVERY_SAMPLED = f"""{BASE}, {A1}, {A2}, {A3}, {A4}, ind AS (SELECT symbol, event_date, bar_date, {', '.join(f'{e} AS "{c}"' for c, e in EVERY.items() if c not in ('close', 'open', 'high', 'low', 'volume'))}, close, open, high, low, volume FROM a5 {W}),
wanted AS (SELECT symbol, event_date, lag, event_date - lag AS lag_date FROM (SELECT DISTINCT symbol, event_date FROM slices), (VALUES (1), (3), (5), (10), (30)) t(lag)),
sampled AS (SELECT w.lag, ind.* FROM wanted w ASOF JOIN ind ON w.symbol = ind.symbol AND w.event_date = ind.event_date AND w.lag_date >= ind.bar_date)"""
EVERY_RAW = f"{EVERY_SAMPLED}, raw AS (SELECT e.Symbol, e.Date AS Event_Date, e.Event_Type, e.Exchange, 'T-' || lag AS Time_Lag, s.* EXCLUDE (symbol, event_date, lag, bar_date) FROM events e JOIN sampled s ON s.symbol = e.Symbol AND s.event_date = e.Date)"
LONG = f"{EVERY_RAW}, long AS (UNPIVOT (SELECT Time_Lag, Event_Type, " + ", ".join(f'"{c}"::DOUBLE AS "{c}"' for c in EVERY) + ' FROM raw) ON COLUMNS(* EXCLUDE (Time_Lag, Event_Type)) INTO NAME Indicator VALUE x)'
MEANS = f"{LONG}, means AS (SELECT Time_Lag, Indicator, avg(x) FILTER (Event_Type = 'Spiker') AS s, avg(x) FILTER (Event_Type = 'Grinder') AS g FROM long GROUP BY ALL)"
SIZES = f"{LONG}, sizes AS (SELECT Time_Lag, Indicator, count(x) FILTER (Event_Type = 'Spiker') AS ns, count(x) FILTER (Event_Type = 'Grinder') AS ng, avg(x) FILTER (Event_Type = 'Spiker') AS s, avg(x) FILTER (Event_Type = 'Grinder') AS g, var_samp(x) FILTER (Event_Type = 'Spiker') / ns AS vs, var_samp(x) FILTER (Event_Type = 'Grinder') / ng AS vg FROM long GROUP BY ALL HAVING ns >= 30 AND ng >= 30)"
EVENT_OUT = f"""SELECT Date, Symbol, Exchange, Event_Type, {fix("Price")} AS Price, {fix('"Change_%"')} AS "Change_%", Volume FROM events"""
ANALYSIS = f"WITH {MEANS} SELECT Time_Lag, Indicator, {fix('s')} AS AVG_Spikers, {fix('g')} AS AVG_Grinders, {fix('s - g')} AS Difference, {fix('s / nullif(g, 0)')} AS Ratio FROM means WHERE coalesce(s, g) IS NOT NULL"
Z = 1.959963984540054
CRITICAL = f"{Z} + {(Z**3 + Z) / 4!r} / f + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96!r} / (f * f) + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384!r} / (f * f * f)"


def stats() -> str:
    first = "raw WHERE Time_Lag = 'T-1'"
    kinds = (("spiker", "Spiker"), ("grinder", "Grinder"))
    rows = [("total_events", "count(*)")] + [(f"total_{k}s", f"count(*) FILTER (Event_Type = '{v}')") for k, v in kinds] + [(f"{k}_ratio", f"count(*) FILTER (Event_Type = '{v}') / count(*)") for k, v in kinds]
    rows += [(f"avg_{k}_change_pct", f"avg(price_change_1d) FILTER (Event_Type = '{v}')") for k, v in kinds]
    rows += [(f"{n}_{k}_price", f"{f}(close) FILTER (Event_Type = '{v}')") for k, v in kinds for n, f in (("avg", "avg"), ("median", "median"))]
    rows += [(f"avg_{k}_volume", f"avg(volume) FILTER (Event_Type = '{v}')") for k, v in kinds]
    return f"WITH {RAW} " + " UNION ALL ".join(f"SELECT '{m}' AS Metric, {fix(e)} AS Value FROM {first}" for m, e in rows)


CORRELATED = ("close", "volume", "SMA20", "price_change_5d", "RSI", "MACD.macd", "ATR", "volatility_20d", "gap_up")
PAIRS = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
STEPS = 4000


def simpson(end: str) -> str:
    """The integral of cos(x) ^ (f - 1) from 0 to an end, by Simpson's rule: of Student's t with f degrees of freedom, by the angle."""
    power = "coalesce(pow(greatest(cos({0}), 0), f - 1), 0)".format
    return f"""(({end}) / {3 * STEPS} * list_sum(list_transform(range({STEPS + 1}), lambda i: {power(f"({end}) * i / {STEPS}")} * CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)))"""


RUN = "(PARTITION BY bare ORDER BY bar_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"



def whole(bars: str) -> str:
    """Recursive averages of whole histories, a bar after the other: h holds each symbol's state after its bar i."""
    step = lambda y, x, a: f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} ELSE {1 - a!r} * {y} + {a!r} * {x} END"
    plain = [(f"e{n}", "close", 2 / (n + 1)) for n in (*EMAS, 12, 26)] + [(f"w_{x}", x, 1 / 14) for x in ("tr", "gain", "loss", "pdm", "mdm")]
    later = [("sig", "macd", 0.2), ("wdx", "dx", 1 / 14)]
    macd = "CASE WHEN i >= 26 THEN e12 - e26 END"
    di = lambda m: f"CASE WHEN i >= 15 THEN 100 * w_{m} / nullif(w_tr, 0) END"
    dx = f"100 * abs(({di('pdm')}) - ({di('mdm')})) / nullif(({di('pdm')}) + ({di('mdm')}), 0)"
    names = [n for n, _, _ in plain]
    start = ", ".join(f"{x} AS {n}" for n, x, _ in plain)
    more = ", ".join(f"{step('h.' + n, 'b.' + x, a)} AS {n}" for n, x, a in plain)
    second = ", ".join(f"{step('s.' + n, 't.' + x, a)} AS {n}" for n, x, a in later)
    return f"""WITH RECURSIVE bars AS ({bars}),
    lagged AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
    b AS MATERIALIZED (SELECT symbol, bar_date, i, close, CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS gain, CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS loss,
      CASE WHEN h1 IS NOT NULL THEN CASE WHEN high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END END AS pdm, CASE WHEN h1 IS NOT NULL THEN CASE WHEN l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END END AS mdm,
      greatest(high - low, abs(high - c1), abs(low - c1)) AS tr FROM lagged),
    h AS (SELECT symbol, bar_date, i, {start} FROM b WHERE i = 1 UNION ALL SELECT b.symbol, b.bar_date, b.i, {more} FROM h JOIN b ON b.symbol = h.symbol AND b.i = h.i + 1),
    t AS MATERIALIZED (SELECT symbol, bar_date, i, {', '.join(names)}, {macd} AS macd, {dx} AS dx FROM h),
    s AS (SELECT symbol, i, macd AS sig, dx AS wdx FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.i, {second} FROM s JOIN t ON t.symbol = s.symbol AND t.i = s.i + 1),
    d AS (SELECT t.*, s.sig, s.wdx, count(dx) OVER (PARTITION BY t.symbol ORDER BY t.i) AS n_dx FROM t JOIN s ON s.symbol = t.symbol AND s.i = t.i)
    SELECT symbol, bar_date, {', '.join(f"{fix(f'CASE WHEN i >= {n} THEN e{n} END')} AS ema{n}" for n in EMAS)}, {fix('macd')} AS macd, {fix('CASE WHEN i >= 34 THEN sig END')} AS macd_signal,
      {fix('CASE WHEN i >= 34 THEN macd - sig END')} AS macd_diff, {fix('CASE WHEN i >= 15 THEN CASE WHEN w_loss = 0 THEN 100 ELSE 100 - 100 / (1 + w_gain / nullif(w_loss, 0)) END END')} AS rsi,
      {fix('CASE WHEN i >= 14 THEN w_tr END')} AS atr, {fix(di('pdm'))} AS di_plus, {fix(di('mdm'))} AS di_minus, {fix('CASE WHEN n_dx >= 14 THEN wdx END')} AS adx FROM d"""


def over_symbol(sql: str) -> str:
    """Frames of slices as frames of whole histories."""
    return sql.replace("PARTITION BY symbol, event_date", "PARTITION BY symbol")


BAR_STEP = f"""bars AS ({BARS}), step AS (SELECT *, (high + low) / 2 AS hl2, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS chg, close - lag(close, 10) OVER w AS mom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)),
  k AS (SELECT *, 100 * (close - ({over_symbol(LL)})) / nullif(({over_symbol(HH)}) - ({over_symbol(LL)}), 0) AS k FROM step), d AS (SELECT *, {over_symbol(full('avg', 'k', 3))} AS d FROM k)"""
BAR_FRAME = {
    "sma50": full("avg", "close", 50), "sma200": full("avg", "close", 200), "price_change_20d": "(close / nullif(lag(close, 20) OVER w, 0) - 1) * 100", "stoch_d_1": "lag(d) OVER w",
    "ao": f"({full('avg', 'hl2', 5)}) - ({full('avg', 'hl2', 34)})", "volatility_20d": f"({full('stddev_samp', 'chg', 20)}) * sqrt(252)", "mom_1": "lag(mom) OVER w", "volume_sma20": full("avg", "volume", 20),
}
YEAR_SLICES = SLICES.replace("e.event_date - 90", "e.event_date - 400")
YEAR_EMA = f"""WITH {YEAR_SLICES}, l AS (SELECT symbol, event_date, count(*) AS bars, max(bar_date) AS day, list(close ORDER BY bar_date) AS xs FROM slices GROUP BY ALL),
  e AS (SELECT symbol, event_date, bars, {', '.join(f"{fold('xs', 2 / (n + 1), n)} AS e{n}" for n in (50, 100, 200))} FROM l)
  SELECT symbol, event_date, bars, {fix('e100')} AS EMA100, {fix('e200')} AS EMA200, coalesce(e50 > e200, false)::INT::DOUBLE AS EMA50_above_EMA200 FROM e"""


def of_last(columns: dict[str, str]) -> str:
    """Aggregates over the last rows of slices of 400 days."""
    made = ", ".join(f'{fix(e)} AS "{c}"' for c, e in columns.items())
    return f"WITH {YEAR_SLICES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_date ORDER BY bar_date DESC) AS k FROM slices) SELECT symbol, event_date, count(*) AS bars, {made} FROM r GROUP BY symbol, event_date"


LAST_CLOSE, TOP, BOTTOM = "max(close) FILTER (k = 1)", "max(high) FILTER (k <= 252)", "min(low) FILTER (k <= 252)"
QUARTILES = " UNION ".join(f"SELECT l_returnflag, l_linestatus, ((n - 1) * {k} // 4)::BIGINT AS rank, xs[(n - 1) * {k} // 4 + 1]::DOUBLE AS price FROM l" for k in range(5))

ORACLES = INDICATORS | {
    "recursive_histories": whole(BARS),
    "recursive_by_nation": whole(NATION_BARS),
    "frames_in_blocks": f"WITH {BAR_STEP} SELECT symbol, bar_date, " + ", ".join(f"{fix(over_symbol(e))} AS {c}" for c, e in BAR_FRAME.items()) + " FROM d WINDOW w AS (PARTITION BY symbol ORDER BY bar_date)",
    "exact_quartiles": f"WITH l AS (SELECT l_returnflag, l_linestatus, count(*) AS n, list(l_extendedprice ORDER BY l_extendedprice) AS xs FROM lineitem GROUP BY ALL) {QUARTILES}",
    "all_correlations": f"""WITH {EVERY_RAW}, numbered AS (SELECT *, row_number() OVER () AS rid FROM raw), long AS MATERIALIZED (UNPIVOT (SELECT rid, Time_Lag, {', '.join(f'"{c}"::DOUBLE AS "{c}"' for c in EVERY)} FROM numbered) ON COLUMNS(* EXCLUDE (rid, Time_Lag)) INTO NAME Indicator VALUE x),
      r AS (SELECT a.Time_Lag, a.Indicator AS Indicator_A, b.Indicator AS Indicator_B, corr(a.x, b.x) AS r FROM long a JOIN long b ON a.rid = b.rid AND a.Indicator < b.Indicator GROUP BY ALL)
      SELECT Time_Lag, Indicator_A, Indicator_B, {fix('r')} AS Correlation FROM r WHERE r IS NOT NULL AND isfinite(r)""",
    "memo_rerun": f"""WITH {SAMPLED}, every AS (SELECT e.Symbol, e.Date, count(*) FILTER (year(b.bar_date) = 1996 AND day(b.bar_date) = 13) AS late, count(*) AS n FROM (SELECT DISTINCT Symbol, Date FROM events) e
      JOIN bars b ON b.symbol = e.Symbol AND b.bar_date >= e.Date - 90 AND b.bar_date < e.Date GROUP BY ALL)
      SELECT lag, count(*) AS rows, sum(volume) AS volume, {fix('avg(close)')} AS close, (SELECT count(*) FROM every WHERE n > late) AS first_run, (SELECT count(*) FROM every WHERE late > 0) AS second_run, 0::BIGINT AS third_run FROM sampled GROUP BY lag""",
    "stage_retained": f"WITH {RAW} SELECT Symbol, Event_Date, Event_Type, Exchange, Time_Lag, {fix('close')} AS close FROM raw WHERE Event_Date >= DATE '1998-06-01' - 90",
    "stage_versions": f"WITH {RAW} SELECT v AS version, Time_Lag, Event_Type, count(*) AS rows, {fix('avg(close)')} AS close FROM raw, (VALUES (1), (2)) t(v) WHERE v = 1 OR Time_Lag <> 'T-3' OR Event_Type = 'Spiker' GROUP BY ALL",
    "stage_listing": f"SELECT 'candidates' AS name, count(*) AS rows FROM (WITH {EVENTS} SELECT * FROM events) UNION ALL SELECT 'raw_data', count(*) FROM (WITH {RAW} SELECT * FROM raw) UNION ALL SELECT 'analysis', count(*) FROM ({ANALYSIS}) UNION ALL SELECT 'stats', count(*) FROM ({stats()})",
    "markets": f"WITH bars AS ({NATION_BARS}) SELECT CASE WHEN starts_with(symbol, 'NATION_1') THEN 'america' ELSE lower(symbol) END AS market, count(*) AS bars, sum(volume) AS volume FROM bars GROUP BY ALL",
    "rows_without_values": f"WITH {RAW} SELECT Time_Lag, Event_Type, count(*) AS rows, sum(volume) AS volume FROM raw WHERE day(Event_Date) % 4 <> 0 GROUP BY ALL",
    "year_ema": YEAR_EMA,
    "year_sma": of_last({f"SMA{n}": f"CASE WHEN count(*) >= {n} THEN avg(close) FILTER (k <= {n}) END" for n in (100, 200)}),
    "year_extremes": of_last({"high_52w": TOP, "low_52w": BOTTOM, "price_vs_high_52w": f"({LAST_CLOSE} / nullif({TOP}, 0) - 1) * 100", "price_vs_low_52w": f"({LAST_CLOSE} / nullif({BOTTOM}, 0) - 1) * 100"}),
    "bars_daily": BARS,
    "bars_by_nation": NATION_BARS,
    "snapshot": f"WITH {SNAP} SELECT bar_date, market, symbol, {fix('close')} AS close, {fix('change')} AS change, {fix('change_abs')} AS change_abs, volume, {fix('rel')} AS relative_volume_10d_calc FROM snap",
    "screener_filter": f"WITH {SNAP} SELECT bar_date, symbol, {fix('close')} AS close, volume FROM snap WHERE snap.close > 0.5 AND volume > 35 AND change_abs IS NOT NULL",
    "universe_filter": f"WITH {SNAP} SELECT bar_date, symbol, {fix('close')} AS close, volume FROM snap WHERE coalesce(snap.close, 0) >= 0.5 AND coalesce(volume, 0) >= 35",
    "exchange_filter": f"WITH {SNAP} SELECT exchange AS Exchange, bare AS symbol, market, count(*) AS rows, sum(volume) AS volume FROM snap WHERE exchange IN ('NASDAQ', 'NYSE') GROUP BY exchange, bare, market",
    "top_movers": f"WITH {SNAP} SELECT bar_date, symbol, {fix('change_abs')} AS change_abs FROM (SELECT * FROM snap WHERE change_abs IS NOT NULL ORDER BY change_abs DESC, symbol LIMIT 100)",
    "detect_events": f"WITH {EVENTS} {EVENT_OUT}",
    "detect_snapshot": f"WITH {EVENTS} {EVENT_OUT} WHERE Date = DATE '1997-06-02'",
    "event_counts": f"WITH {EVENTS} SELECT Event_Type, count(*) AS events FROM events GROUP BY Event_Type",
    "event_history": f"WITH {SLICES} SELECT symbol, event_date, count(*) AS bars, min(bar_date) AS first_day, max(bar_date) AS last_day, sum(volume) AS volume FROM slices GROUP BY symbol, event_date",
    "event_coverage": f"""WITH {EVENTS}, n AS (SELECT e.Symbol, e.Date, (SELECT count(*) FROM bars b WHERE b.symbol = e.Symbol AND b.bar_date >= e.Date - 90 AND b.bar_date < e.Date) AS n FROM events e)
      SELECT count(*) AS total, count(*) FILTER (n >= 50) AS succeeded, count(*) FILTER (n < 50) AS failed, count(*) - count(DISTINCT (Symbol, Date)) AS cached FROM n""",
    "lag_asof": f"WITH {SAMPLED} SELECT symbol, event_date, lag, bar_date, {fix('close')} AS close, volume, {fix('price_change_1d')} AS price_change_1d FROM sampled",
    "raw_data": f"WITH {EVERY_RAW} SELECT Symbol, Event_Date, Event_Type, Exchange, Time_Lag, " + ", ".join(f'"{c}"' if e.startswith("coalesce") else f"""{fix(f'"{c}"')} AS "{c}\"""" for c, e in EVERY.items()) + " FROM raw",
    "lag_summary": ANALYSIS,
    "overall_stats": stats(),
    "distinct_lags": f"WITH {RAW} SELECT DISTINCT Time_Lag FROM raw",
    "latest_per_symbol": f"WITH {FRAME_CTE} SELECT symbol, event_date, bar_date, {fix('close')} AS close, {fix('SMA20')} AS SMA20, {fix('vwap')} AS VWAP FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC, event_date DESC) = 1",
    "grinder_consecutive": f"WITH {SNAP}, r AS (SELECT *, sum((coalesce(change, 0) >= 0.5)::INT) OVER {RUN} AS run FROM snap) SELECT bar_date, symbol, {fix('change')} AS change FROM r WHERE run = 3",
    "detect_lookback": f"WITH {EVENTS} {EVENT_OUT} WHERE Date > DATE '1997-06-02' - 7 AND Date <= DATE '1997-06-02'",
    "sanitized": f"SELECT event_type, count(*) FILTER (user_id % 3 = 2 AND value IS NOT NULL) AS finite, {fix('avg(value) FILTER (user_id % 3 = 2)')} AS mean FROM events GROUP BY event_type",
    "renamed": f"WITH {SNAP} SELECT bar_date, symbol, {fix('close')} AS price, {fix('change')} AS gain FROM snap",
    "enough_samples": f"WITH {SIZES} SELECT Time_Lag, Indicator, ns AS n_spikers, ng AS n_grinders FROM sizes",
    "welch_test": f"WITH {SIZES}, t AS (SELECT Time_Lag, Indicator, (s - g) / nullif(sqrt(vs + vg), 0) AS t, (vs + vg) * (vs + vg) / nullif(vs * vs / (ns - 1) + vg * vg / (ng - 1), 0) AS f FROM sizes) SELECT Time_Lag, Indicator, {fix('t')} AS t, {fix('f')} AS freedom, {fix(CRITICAL)} AS critical, abs(t) > {CRITICAL} AS significant FROM t",
    "welch_discoveries": f"""WITH {SIZES}, t AS (SELECT Time_Lag, Indicator, (s - g) / nullif(sqrt(vs + vg), 0) AS t, (vs + vg) * (vs + vg) / nullif(vs * vs / (ns - 1) + vg * vg / (ng - 1), 0) AS f FROM sizes),
      p AS (SELECT *, CASE WHEN f IS NULL OR t IS NULL THEN NULL ELSE greatest(0, 1 - {simpson('atan(abs(t) / sqrt(f))')} / {simpson('pi() / 2')}) END AS p FROM t),
      b AS (SELECT *, p * count(p) OVER (PARTITION BY Time_Lag) / CASE WHEN p IS NOT NULL THEN (SELECT count(*) FROM p o WHERE o.Time_Lag = p.Time_Lag AND o.p <= p.p) END AS rate FROM p),
      q AS (SELECT b.*, CASE WHEN b.p IS NOT NULL THEN (SELECT least(1, min(o.rate)) FROM b o WHERE o.Time_Lag = b.Time_Lag AND o.p >= b.p) END AS q FROM b)
      SELECT Time_Lag, Indicator, {fix('t')} AS t, {fix('f')} AS freedom, {fix('p')} AS p_value, {fix('q')} AS fdr, q <= 0.05 AS discovery FROM q""",
    "asof_bars": f"""WITH {EVENTS.replace(BARS, NATION_BARS)}, k AS (SELECT DISTINCT Symbol AS symbol, Date AS event_date, Date - 365 AS year_before FROM events)
      SELECT k.symbol, k.event_date, k.year_before, b.bar_date, {fix('b.close')} AS close, b.volume AS bar_volume FROM k ASOF LEFT JOIN bars b ON k.symbol = b.symbol AND k.year_before >= b.bar_date""",
    "asof_purchases": """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id, arg_max(value, event_id) AS click_value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
      SELECT e.event_id, e.user_id, e.ts, e.value, c.ts AS click_ts, c.click_id, c.click_value FROM (FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "asof_orders": """WITH l AS (SELECT l_linestatus, l_shipdate::DATE AS shipped, arg_max((l_orderkey, l_extendedprice), (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS r FROM lineitem GROUP BY ALL)
      SELECT o_orderkey, o_orderstatus, o_orderdate::DATE AS day, shipped, r[1] AS l_orderkey, r[2] AS l_extendedprice FROM orders ASOF LEFT JOIN l ON o_orderstatus = l_linestatus AND o_orderdate::DATE >= shipped""",
    "indicator_correlations": f"WITH {EVERY_RAW} " + " UNION ALL ".join(f"""SELECT Time_Lag, '{a}' AS Indicator_A, '{b}' AS Indicator_B, {fix(f'corr("{a}", "{b}")')} AS Correlation FROM raw GROUP BY Time_Lag""" for a, b in PAIRS),
    "retained_raw": f"WITH {RAW} SELECT Symbol, Event_Date, Event_Type, Exchange, Time_Lag, {fix('close')} AS close FROM raw WHERE Event_Date >= DATE '1998-06-01' - 90",
    "stage_round_trip": f"WITH {RAW} SELECT Time_Lag, Event_Type, count(*) AS rows, sum(volume) AS volume FROM raw WHERE Time_Lag IN ('T-1', 'T-30') GROUP BY Time_Lag, Event_Type",
    "stage_candidates": f"WITH {EVENTS} {EVENT_OUT}",
    "stage_append": f"WITH {EVENTS} {EVENT_OUT}",
    "stage_raw_all": f"WITH {RAW} SELECT Time_Lag, Event_Type, count(*) AS rows, {fix('avg(close)')} AS close FROM raw WHERE Time_Lag <> 'T-3' OR Event_Type = 'Spiker' GROUP BY Time_Lag, Event_Type",
    "stage_backup": f"WITH {EVERY_RAW} SELECT Symbol, Event_Date, Event_Type, Exchange, Time_Lag, {fix('close')} AS close, volume, {fix('RSI')} AS RSI, gap_up FROM raw",
    "stage_analysis": ANALYSIS,
    "stage_by_stage": f"""SELECT a.*, computed FROM ({ANALYSIS}) a, (WITH {EVENTS} SELECT count(DISTINCT (Symbol, Date)) AS computed FROM events e
      WHERE Date >= DATE '1997-01-01' AND EXISTS (FROM bars b WHERE b.symbol = e.Symbol AND b.bar_date >= e.Date - 90 AND b.bar_date < e.Date))""",
    "stage_report": f"SELECT Time_Lag, Indicator, Difference AS Value FROM ({ANALYSIS}) UNION ALL SELECT NULL, Metric, Value FROM ({stats()})",
    "detect_odd": f"""WITH {SNAP}, o AS (SELECT bar_date, bare, close, volume, change_abs, dayofyear(bar_date) % 6 AS k, exchange, CASE WHEN k = 3 THEN NULL ELSE change END AS change, CASE WHEN k = 4 THEN 0.1 WHEN k = 5 OR rel IS NULL THEN 0.9 ELSE rel END AS rel FROM snap),
      l AS (SELECT o.*, x.e AS listed FROM o, (VALUES ('NASDAQ'), ('NYSE')) x(e) WHERE k = 0 OR (k <> 2 AND upper(exchange) = x.e)),
      t AS (SELECT bar_date AS Date, CASE WHEN k = 1 THEN lower(bare) ELSE bare END AS Symbol, listed AS Exchange, close AS Price, coalesce(change, change_abs, 0) AS c, volume AS Volume, rel FROM l WHERE close > 0.5 AND volume > 35 AND change_abs IS NOT NULL)
      SELECT Date, Symbol, Exchange, CASE WHEN c >= 15 THEN 'Spiker' ELSE 'Grinder' END AS Event_Type, {fix('Price')} AS Price, {fix('c')} AS "Change_%", Volume FROM t WHERE c >= 15 OR (c >= 0.5 AND rel >= 0.8)""",
    "repeated_candidates": f"""WITH {SAMPLED}, twice AS (SELECT Symbol, Date, Exchange FROM events UNION ALL SELECT Symbol, Date, 'NASDAQ' FROM events WHERE day(Date) % 3 = 0)
      SELECT e.Symbol, e.Date AS Event_Date, e.Exchange, 'T-' || s.lag AS Time_Lag, count(*) AS rows, {fix('max(s.close)')} AS close FROM twice e JOIN sampled s ON s.symbol = e.Symbol AND s.event_date = e.Date GROUP BY ALL""",
}
