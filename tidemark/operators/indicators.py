"""Indicators over bars (W1-W26). A value that a window can't give is null. Windows look back only, but for those that
say so: bodies of candles are measured against the mean of the whole series, and w20 has means of what comes.

Windows run by (symbol, ts). Recursive indicators (averages of Wilder and exponential kind) are a grouped function over
one symbol's series, whose length is the number of its bars.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources.bars import DAILY_SQL, HOURLY_SQL, MARKET_SQL, daily, hourly, market

def series():
    """A symbol's bars in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def last_n(n: int):
    return series().rowsBetween(-(n - 1), 0)


def sma(x: Column, n: int) -> Column:
    """Mean of the last n values; null where fewer bars are there or one of them is null."""
    return F.when(F.count(x).over(last_n(n)) == n, F.avg(x).over(last_n(n)))


def rolling(fold: Callable[[Column], Column], x: Column, n: int) -> Column:
    """A maximum or minimum of the last n bars: null before n bars are there, skips nulls between."""
    return F.when(F.row_number().over(series()) >= n, fold(x).over(last_n(n)))


def session_vwap(day: Column) -> Column:
    """Volume-weighted typical price since the start of ``day``; null while no volume is there."""
    w = Window.partitionBy("symbol", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w))


def rolling_vwap(n: int) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    worth = typical * F.col("volume")
    return F.when(F.count(worth).over(last_n(n)) == n, F.try_divide(F.sum(worth).over(last_n(n)), F.sum("volume").over(last_n(n))))


def true_range() -> Column:
    """Null on a symbol's first bar."""
    before = F.lag("close").over(series())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


# Recursive averages, over one series with NaN for null.


def smoothed(x: np.ndarray, n: int, keep: float) -> np.ndarray:
    """Starts as the mean of the first n values and then keeps the share ``keep`` of itself. A gap among the first n leaves
    nothing; a later one gives NaN there and the state stays."""
    out = np.full(len(x), np.nan)
    if n < 1 or len(x) < n or np.isnan(x[:n]).any():
        return out
    state = out[n - 1] = x[:n].mean()
    for i in range(n, len(x)):
        if not np.isnan(x[i]):
            state = out[i] = keep * state + (1 - keep) * x[i]
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 1 - 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, (n - 1) / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """100 if nothing was lost, 50 if nothing moved."""
    step = np.diff(close)
    up, down = wilder(np.maximum(step, 0), n), wilder(np.maximum(-step, 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = 100 - 100 / (1 + up / down)
    x = np.where(down == 0, np.where(up == 0, 50.0, 100.0), x)
    return np.concatenate([[np.nan], np.where(np.isnan(up), np.nan, x)]) if len(close) else x


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signal, histogram); the signal runs over the defined values of the line."""
    line = ema(close, fast) - ema(close, slow) if fast < slow else np.full(len(close), np.nan)
    there = ~np.isnan(line)
    sig = np.full(len(close), np.nan)
    sig[there] = ema(line[there], signal)
    return line, sig, line - sig


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    tr = np.maximum.reduce([high[1:] - low[1:], np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])])
    return np.concatenate([[np.nan], wilder(tr, n)])


def by_series(bars: DataFrame, new: dict[str, Callable[[pd.DataFrame], np.ndarray]]) -> DataFrame:
    """``bars`` with new columns, each a function of a symbol's bars in order of time."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        return pdf.assign(**{c: np.asarray(f(pdf), float) for c, f in new.items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {c} double" for c in new)
    out = bars.groupBy("symbol").applyInPandas(work, schema)
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in new})


def column(name: str) -> Callable[[pd.DataFrame], np.ndarray]:
    return lambda p: p[name].to_numpy(float)


def r6(name: str, x: Column) -> Column:
    return F.round(x, 6).alias(name)


_W = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, round(CASE WHEN count(close) {_W.format(19)} = 20 THEN avg(close) {_W.format(19)} END, 6) AS sma20 FROM bars""")
def w1_sma20(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts", r6("sma20", sma(F.col("close"), 20)))


def _smooth_sql(n: int, keep: str, x: str = "close", first: int = 0) -> str:
    """A recursive average in SQL: seeded with the mean of the first n values from index ``first`` on."""
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM series),
seed AS (SELECT symbol, avg({x}) AS s FROM i WHERE k BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count({x}) = {n}),
walk AS (SELECT symbol, {first + n - 1} AS k, s FROM seed
  UNION ALL SELECT w.symbol, w.k + 1, w.s * {keep} + (1 - {keep}) * i.{x} FROM walk w JOIN i ON i.symbol = w.symbol AND i.k = w.k + 1)"""


@query(f"""WITH RECURSIVE {HOURLY_SQL}, series AS (SELECT * FROM bars), {_smooth_sql(20, '(1 - 2.0::DOUBLE / 21)')}
SELECT i.symbol, i.ts, round(w.s, 6) AS ema20 FROM i LEFT JOIN walk w USING (symbol, k)""")
def w2_ema20(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "ts", "close")
    return by_series(b, {"ema20": lambda p: ema(column("close")(p), 20)}).select("symbol", "ts", r6("ema20", F.col("ema20")))


@query(f"""WITH RECURSIVE {HOURLY_SQL}, series AS (SELECT * FROM bars), {_smooth_sql(14, '(13.0::DOUBLE / 14)')}
SELECT i.symbol, i.ts, round(w.s, 6) AS wilder14 FROM i LEFT JOIN walk w USING (symbol, k)""")
def w3_wilder14(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "ts", "close")
    return by_series(b, {"x": lambda p: wilder(column("close")(p), 14)}).select("symbol", "ts", r6("wilder14", F.col("x")))


@query(f"""WITH RECURSIVE {HOURLY_SQL}, d AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM d),
seed AS (SELECT symbol, avg(up) AS u, avg(down) AS v FROM i WHERE k BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14),
walk AS (SELECT symbol, 14 AS k, u, v FROM seed UNION ALL
  SELECT w.symbol, w.k + 1, (w.u * 13 + i.up) / 14, (w.v * 13 + i.down) / 14 FROM walk w JOIN i ON i.symbol = w.symbol AND i.k = w.k + 1)
SELECT i.symbol, i.ts, round(CASE WHEN w.u IS NULL THEN NULL WHEN v = 0 AND u = 0 THEN 50 WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END, 6) AS rsi14
FROM i LEFT JOIN walk w USING (symbol, k)""")
def w4_rsi14(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "ts", "close")
    return by_series(b, {"x": lambda p: rsi(column("close")(p))}).select("symbol", "ts", r6("rsi14", F.col("x")))


def _ema_walk(name: str, src: str, x: str, n: int, start: str) -> str:
    keep = f"(1 - 2.0::DOUBLE / {n + 1})"
    return f"""{name}_seed AS (SELECT symbol, {start} + {n - 1} AS k, avg({x}) AS s FROM {src} WHERE k BETWEEN {start} AND {start} + {n - 1} GROUP BY symbol HAVING count({x}) = {n}),
{name} AS (SELECT symbol, k, s FROM {name}_seed UNION ALL
  SELECT w.symbol, w.k + 1, w.s * {keep} + (1 - {keep}) * i.{x} FROM {name} w JOIN {src} i ON i.symbol = w.symbol AND i.k = w.k + 1)"""


@query(f"""WITH RECURSIVE {HOURLY_SQL}, i AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM bars),
{_ema_walk('fast', 'i', 'close', 12, '0')}, {_ema_walk('slow', 'i', 'close', 26, '0')},
line AS (SELECT i.symbol, i.ts, i.k, f.s - s.s AS line FROM i JOIN fast f USING (symbol, k) JOIN slow s USING (symbol, k)),
{_ema_walk('sig', 'line', 'line', 9, '25')}
SELECT i.symbol, i.ts, round(l.line, 6) AS line, round(g.s, 6) AS signal, round(l.line - g.s, 6) AS hist
FROM i LEFT JOIN line l USING (symbol, k) LEFT JOIN sig g USING (symbol, k)""")
def w5_macd(spark, sf_dir):
    b = hourly(spark, sf_dir).select("symbol", "ts", "close")
    x = by_series(b, {c: lambda p, k=k: macd(column("close")(p))[k] for k, c in enumerate(("l", "s", "h"))})
    return x.select("symbol", "ts", r6("line", F.col("l")), r6("signal", F.col("s")), r6("hist", F.col("h")))


@query(f"""WITH RECURSIVE {HOURLY_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars),
series AS (SELECT symbol, ts, CASE WHEN before IS NOT NULL THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr FROM p),
{_smooth_sql(14, '(13.0::DOUBLE / 14)', 'tr', 1)}
SELECT i.symbol, i.ts, round(i.tr, 6) AS tr, round(w.s, 6) AS atr14 FROM i LEFT JOIN walk w USING (symbol, k)""")
def w6_atr14(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("tr", true_range())
    x = by_series(b, {"x": lambda p: atr(*(column(c)(p) for c in ("high", "low", "close")))})
    return x.select("symbol", "ts", r6("tr", F.col("tr")), r6("atr14", F.col("x")))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, round(CASE WHEN count(volume) {_W.format(19)} = 20 THEN avg(volume) {_W.format(19)} END, 6) AS vol_avg20 FROM bars""")
def w7_vol_avg20(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts", r6("vol_avg20", sma(F.col("volume"), 20)))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap FROM bars
WINDOW w AS (PARTITION BY symbol, CAST(ts - INTERVAL 5 HOUR AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def w8_session_vwap(spark, sf_dir):
    """Days are New York's, five hours behind in January."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))
    return hourly(spark, sf_dir).select("symbol", "ts", r6("vwap", session_vwap(day)))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, round(CASE WHEN count(close) {_W.format(19)} = 20 THEN
  sum((high + low + close) / 3 * volume) {_W.format(19)} / nullif(sum(volume) {_W.format(19)}, 0) END, 6) AS vwap20 FROM bars""")
def w9_rolling_vwap20(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts", r6("vwap20", rolling_vwap(20)))


@query(f"""WITH {HOURLY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, nullif(low, round(low)) AS holed FROM bars)
SELECT symbol, ts, CASE WHEN k >= 50 THEN max(high) {_W.format(49)} END AS high50, CASE WHEN k >= 50 THEN min(holed) {_W.format(49)} END AS low50 FROM n""")
def w10_extremes50(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("holed", F.nullif("low", F.round("low")))
    return b.select("symbol", "ts", rolling(F.max, F.col("high"), 50).alias("high50"), rolling(F.min, F.col("holed"), 50).alias("low50"))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, open, high, low, close, volume, lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS close_3 FROM bars""")
def w11_fields_and_shift(spark, sf_dir):
    return hourly(spark, sf_dir).withColumn("close_3", F.lag("close", 3).over(series()))


def with_market(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Log returns of a symbol (r) and of the benchmark (m) at the symbol's bars."""
    x = bars.join(bench, "ts")
    return x.withColumn("r", F.ln(F.col("close") / F.lag("close").over(series()))).withColumn("m", F.ln(F.col("mclose") / F.lag("mclose").over(series())))


def rolling_beta(n: int = 252, least: int = 60) -> Column:
    """Slope of r on m over n bars, drawn to 1 by a third; 1 where no more than ``least`` are there."""
    w = last_n(n)
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    count = F.count(F.when(both, 1)).over(w)
    mean = lambda x: F.avg(F.when(both, x)).over(w)
    cov = mean(F.col("r") * F.col("m")) - mean(F.col("r")) * mean(F.col("m"))
    var = mean(F.col("m") * F.col("m")) - mean(F.col("m")) * mean(F.col("m"))
    return F.when((count > least) & (var > 0), 0.67 * F.try_divide(cov, var) + 0.33).otherwise(1.0)


_RETURNS_SQL = f"""{HOURLY_SQL}, {MARKET_SQL}, x AS (SELECT b.*, mclose, ln(close / lag(close) OVER w) AS r, ln(mclose / lag(mclose) OVER w) AS m
  FROM bars b JOIN market USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p AS (SELECT *, count(r) OVER v AS n, avg(r * m) OVER v - avg(r) OVER v * avg(m) OVER v AS cov, avg(m * m) OVER v - avg(m) OVER v * avg(m) OVER v AS var
  FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING)),
beta AS (SELECT *, CASE WHEN n > 60 AND var > 0 THEN 0.67 * cov / var + 0.33 ELSE 1.0 END AS beta FROM p)"""


@query(f"WITH {_RETURNS_SQL} SELECT symbol, ts, round(beta, 6) AS beta FROM beta")
def w16_rolling_beta(spark, sf_dir):
    return with_market(hourly(spark, sf_dir), market(spark, sf_dir)).select("symbol", "ts", r6("beta", rolling_beta()))


@query(f"""WITH {_RETURNS_SQL} SELECT symbol, ts, round(greatest(-0.223, least(0.223, r - lag(beta) OVER (PARTITION BY symbol ORDER BY ts) * m)), 6) AS idio
FROM beta WHERE true QUALIFY lag(beta) OVER (PARTITION BY symbol ORDER BY ts) IS NOT NULL""")
def w17_idiosyncratic(spark, sf_dir):
    x = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).withColumn("beta", rolling_beta()).withColumn("b", F.lag("beta").over(series()))
    return x.where("b IS NOT NULL").select("symbol", "ts", r6("idio", F.greatest(F.lit(-0.223), F.least(F.lit(0.223), F.col("r") - F.col("b") * F.col("m")))))


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars)
SELECT symbol, ts, round(greatest(0, pow(ln(open / before), 2) + 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2)), 6) AS gk FROM p WHERE before IS NOT NULL""")
def w18_garman_klass(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("before", F.lag("close").over(series())).where("before IS NOT NULL")
    night, span, body = F.ln(F.col("open") / F.col("before")), F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    return b.select("symbol", "ts", r6("gk", F.greatest(F.lit(0.0), night * night + 0.5 * span * span - (2 * np.log(2) - 1) * body * body)))


def cleaned_variance(v: np.ndarray, event: np.ndarray, cap: float = 0.0498) -> np.ndarray:
    """Variances capped; on event bars the mean of up to five cleaned values before."""
    out = np.minimum(v, cap)
    for i in np.flatnonzero(event):
        if i:
            out[i] = out[max(0, i - 5) : i].mean()
    return out


@query()
def w19_clean_variance(spark, sf_dir):
    """Events are bars of an hour divisible by seven. Path-dependent: tested against a plain loop."""
    b = hourly(spark, sf_dir).withColumn("v", F.pow(F.ln(F.col("high") / F.col("low")), 2)).withColumn("event", (F.hour("ts") % 7 == 0).cast("double"))
    x = by_series(b, {"clean": lambda p: cleaned_variance(column("v")(p), column("event")(p) > 0)})
    return x.select("symbol", "ts", r6("clean", F.col("clean")))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts,
 round(CASE WHEN count(*) OVER a = 10 THEN avg(close) OVER a END, 6) AS past10, round(CASE WHEN count(*) OVER b = 5 THEN avg(close) OVER b END, 6) AS next5 FROM bars
WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def w20_past_and_future_means(spark, sf_dir):
    a, b = last_n(10), series().rowsBetween(1, 5)
    guard = lambda w, n: F.when(F.count("*").over(w) == n, F.avg("close").over(w))
    return hourly(spark, sf_dir).select("symbol", "ts", r6("past10", guard(a, 10)), r6("next5", guard(b, 5)))


@query(f"""WITH {HOURLY_SQL}, r AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars)
SELECT symbol, ts, count(*) FILTER (WHERE d = 0 AND volume = 0) OVER w > 3 OR count(*) FILTER (WHERE abs(d) < 1) OVER w > 15 AS stale FROM r
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)""")
def w21_stale_prices(spark, sf_dir):
    """Too many dead bars (nothing moved or traded) or flat ones among the last 60; here a move under 1 is flat."""
    b = hourly(spark, sf_dir).withColumn("d", F.col("close") - F.lag("close").over(series()))
    dead, flat = (F.col("d") == 0) & (F.col("volume") == 0), F.abs("d") < 1
    return b.select("symbol", "ts", ((F.count_if(dead).over(last_n(60)) > 3) | (F.count_if(flat).over(last_n(60)) > 15)).alias("stale"))


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM bars)
SELECT symbol, round(min(close / peak - 1), 6) AS max_drawdown FROM p GROUP BY symbol""")
def w22_max_drawdown(spark, sf_dir):
    peak = F.max("close").over(series().rowsBetween(Window.unboundedPreceding, 0))
    return hourly(spark, sf_dir).withColumn("peak", peak).groupBy("symbol").agg(r6("max_drawdown", F.min(F.col("close") / F.col("peak") - 1)))


@query(f"""WITH {HOURLY_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS mark, arg_min(close, ts) AS first_mark FROM bars GROUP BY 1, 2),
w AS (SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS week, arg_max(mark, day) AS mark, arg_min(first_mark, day) AS first_mark FROM d GROUP BY 1, 2)
SELECT symbol, week, mark, round(mark / coalesce(lag(mark) OVER (PARTITION BY symbol ORDER BY week), first_mark) - 1, 6) AS weekly FROM w""")
def w23_weekly_marks(spark, sf_dir):
    d = hourly(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("mark"), F.min_by("close", "ts").alias("first_mark"))
    w = d.groupBy("symbol", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.max_by("mark", "day").alias("mark"), F.min_by("first_mark", "day").alias("first_mark"))
    before = F.coalesce(F.lag("mark").over(Window.partitionBy("symbol").orderBy("week")), F.col("first_mark"))
    return w.select("symbol", "week", "mark", r6("weekly", F.col("mark") / before - 1))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT *, lag(close) OVER w / lag(close, 5) OVER w - 1 AS run FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN run > 0.015 THEN 'up' WHEN run < -0.015 THEN 'down' WHEN run IS NOT NULL THEN 'flat' END AS trend FROM l""")
def w24_trend_before(spark, sf_dir):
    run = F.lag("close").over(series()) / F.lag("close", 5).over(series()) - 1
    return hourly(spark, sf_dir).withColumn("run", run).select("symbol", "ts", F.when(F.col("run") > 0.015, "up").when(F.col("run") < -0.015, "down").when(F.col("run").isNotNull(), "flat").alias("trend"))


def candles(bars: DataFrame) -> DataFrame:
    """Names of one-, two- and three-bar patterns at each bar, from bodies, shadows and the series' mean body."""
    c, o, h, low = (F.col(x) for x in ("close", "open", "high", "low"))
    x = bars.withColumn("mean_body", F.avg(F.abs(c - o)).over(Window.partitionBy("symbol")))
    x = x.withColumn("run", F.lag("close").over(series()) / F.lag("close", 5).over(series()) - 1)
    for k in (1, 2):
        x = x.withColumns({f"{a}{k}": F.lag(b, k).over(series()) for a, b in zip("ohlc", ("open", "high", "low", "close"))})
    o1, h1, l1, c1, o2, c2 = (F.col(y) for y in ("o1", "h1", "l1", "c1", "o2", "c2"))
    body, span, top, bottom = F.abs(c - o), h - low, h - F.greatest(c, o), F.least(c, o) - low
    mean, body1, body2 = F.col("mean_body"), F.abs(c1 - o1), F.abs(c2 - o2)
    up, down = F.col("run") > 0.015, F.col("run") < -0.015
    doji = (span > 0) & (body <= 0.1 * span)
    small_top = (span > 0) & (bottom >= 2 * body) & (top <= 0.3 * body) & ~doji
    small_bottom = (span > 0) & (top >= 2 * body) & (bottom <= 0.3 * body) & ~doji
    rules = {
        "dragonfly_doji": doji & (top <= 0.1 * span) & (bottom >= 0.6 * span),
        "gravestone_doji": doji & (bottom <= 0.1 * span) & (top >= 0.6 * span),
        "long_legged_doji": doji & (top >= 0.3 * span) & (bottom >= 0.3 * span),
        "doji": doji,
        "bullish_marubozu": (span > 0) & (c > o) & (body >= 0.95 * span) & (body > mean),
        "bearish_marubozu": (span > 0) & (c < o) & (body >= 0.95 * span) & (body > mean),
        "hammer": small_top & down,
        "hanging_man": small_top & up,
        "inverted_hammer": small_bottom & down,
        "shooting_star": small_bottom & up,
        "bullish_engulfing": (c1 < o1) & (c > o) & (o <= c1) & (c >= o1) & (body > body1),
        "bearish_engulfing": (c1 > o1) & (c < o) & (o >= c1) & (c <= o1) & (body > body1),
        "bullish_harami": (c1 < o1) & (c > o) & (body1 > mean) & (o > c1) & (c < o1),
        "bearish_harami": (c1 > o1) & (c < o) & (body1 > mean) & (o < c1) & (c > o1),
        "piercing": (c1 < o1) & (c > o) & (o < c1) & (c > (o1 + c1) / 2) & (c < o1),
        "dark_cloud": (c1 > o1) & (c < o) & (o > c1) & (c < (o1 + c1) / 2) & (c > o1),
        "tweezer_top": up & (F.abs(h - h1) <= 0.001 * h) & (c1 > o1) & (c < o),
        "tweezer_bottom": down & (F.abs(low - l1) <= 0.001 * low) & (c1 < o1) & (c > o),
        "morning_star": (c2 < o2) & (body2 > mean) & (body1 < 0.5 * mean) & (c > o) & (c > (o2 + c2) / 2),
        "evening_star": (c2 > o2) & (body2 > mean) & (body1 < 0.5 * mean) & (c < o) & (c < (o2 + c2) / 2),
        "three_soldiers": (c2 > o2) & (c1 > o1) & (c > o) & (c > c1) & (c1 > c2),
        "three_crows": (c2 < o2) & (c1 < o1) & (c < o) & (c < c1) & (c1 < c2),
    }
    return x.select("symbol", "ts", F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()])).alias("patterns"))


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT *, open AS o, high AS h, low AS l, close AS c, abs(close - open) AS body, high - low AS span,
  high - greatest(close, open) AS top, least(close, open) - low AS bottom, avg(abs(close - open)) OVER (PARTITION BY symbol) AS mean,
  lag(close) OVER w / lag(close, 5) OVER w - 1 AS run, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS c1,
  lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT *, span > 0 AND body <= 0.1 * span AS doji FROM x),
z AS (SELECT *, span > 0 AND bottom >= 2 * body AND top <= 0.3 * body AND NOT doji AS small_top, span > 0 AND top >= 2 * body AND bottom <= 0.3 * body AND NOT doji AS small_bottom FROM y),
p AS (SELECT symbol, ts, 'dragonfly_doji' AS pattern FROM z WHERE doji AND top <= 0.1 * span AND bottom >= 0.6 * span
 UNION ALL SELECT symbol, ts, 'gravestone_doji' AS pattern FROM z WHERE doji AND bottom <= 0.1 * span AND top >= 0.6 * span
 UNION ALL SELECT symbol, ts, 'long_legged_doji' AS pattern FROM z WHERE doji AND top >= 0.3 * span AND bottom >= 0.3 * span
 UNION ALL SELECT symbol, ts, 'doji' AS pattern FROM z WHERE doji
 UNION ALL SELECT symbol, ts, 'bullish_marubozu' AS pattern FROM z WHERE span > 0 AND c > o AND body >= 0.95 * span AND body > mean
 UNION ALL SELECT symbol, ts, 'bearish_marubozu' AS pattern FROM z WHERE span > 0 AND c < o AND body >= 0.95 * span AND body > mean
 UNION ALL SELECT symbol, ts, 'hammer' AS pattern FROM z WHERE small_top AND run < -0.015
 UNION ALL SELECT symbol, ts, 'hanging_man' AS pattern FROM z WHERE small_top AND run > 0.015
 UNION ALL SELECT symbol, ts, 'inverted_hammer' AS pattern FROM z WHERE small_bottom AND run < -0.015
 UNION ALL SELECT symbol, ts, 'shooting_star' AS pattern FROM z WHERE small_bottom AND run > 0.015
 UNION ALL SELECT symbol, ts, 'bullish_engulfing' AS pattern FROM z WHERE c1 < o1 AND c > o AND o <= c1 AND c >= o1 AND body > abs(c1 - o1)
 UNION ALL SELECT symbol, ts, 'bearish_engulfing' AS pattern FROM z WHERE c1 > o1 AND c < o AND o >= c1 AND c <= o1 AND body > abs(c1 - o1)
 UNION ALL SELECT symbol, ts, 'bullish_harami' AS pattern FROM z WHERE c1 < o1 AND c > o AND abs(c1 - o1) > mean AND o > c1 AND c < o1
 UNION ALL SELECT symbol, ts, 'bearish_harami' AS pattern FROM z WHERE c1 > o1 AND c < o AND abs(c1 - o1) > mean AND o < c1 AND c > o1
 UNION ALL SELECT symbol, ts, 'piercing' AS pattern FROM z WHERE c1 < o1 AND c > o AND o < c1 AND c > (o1 + c1) / 2 AND c < o1
 UNION ALL SELECT symbol, ts, 'dark_cloud' AS pattern FROM z WHERE c1 > o1 AND c < o AND o > c1 AND c < (o1 + c1) / 2 AND c > o1
 UNION ALL SELECT symbol, ts, 'tweezer_top' AS pattern FROM z WHERE run > 0.015 AND abs(h - h1) <= 0.001 * h AND c1 > o1 AND c < o
 UNION ALL SELECT symbol, ts, 'tweezer_bottom' AS pattern FROM z WHERE run < -0.015 AND abs(l - l1) <= 0.001 * l AND c1 < o1 AND c > o
 UNION ALL SELECT symbol, ts, 'morning_star' AS pattern FROM z WHERE c2 < o2 AND abs(c2 - o2) > mean AND abs(c1 - o1) < 0.5 * mean AND c > o AND c > (o2 + c2) / 2
 UNION ALL SELECT symbol, ts, 'evening_star' AS pattern FROM z WHERE c2 > o2 AND abs(c2 - o2) > mean AND abs(c1 - o1) < 0.5 * mean AND c < o AND c < (o2 + c2) / 2
 UNION ALL SELECT symbol, ts, 'three_soldiers' AS pattern FROM z WHERE c2 > o2 AND c1 > o1 AND c > o AND c > c1 AND c1 > c2
 UNION ALL SELECT symbol, ts, 'three_crows' AS pattern FROM z WHERE c2 < o2 AND c1 < o1 AND c < o AND c < c1 AND c1 < c2)
SELECT * FROM p""")
def w25_candle_patterns(spark, sf_dir):
    return candles(hourly(spark, sf_dir)).select("symbol", "ts", F.explode("patterns").alias("pattern"))


@query(f"""WITH {HOURLY_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
s AS (SELECT symbol, regr_slope(close, k) / avg(close) * 100 AS slope, regr_r2(close, k) AS r2, (max(high) - min(low)) / avg(close) * 100 AS width,
  (arg_max(close, ts) - min(low)) / (max(high) - min(low)) AS place FROM i GROUP BY symbol)
SELECT symbol, round(slope, 6) AS slope, round(r2, 6) AS r2, round(place, 6) AS place,
  CASE WHEN r2 >= 0.6 AND slope >= 0.05 THEN 'uptrend' WHEN r2 >= 0.6 AND slope <= -0.05 THEN 'downtrend' WHEN width <= 15 AND r2 < 0.3 THEN 'range' ELSE 'mixed' END AS structure FROM s""")
def w26_structure(spark, sf_dir):
    x = hourly(spark, sf_dir).withColumn("k", F.row_number().over(series()))
    s = x.groupBy("symbol").agg(
        (F.regr_slope("close", "k") / F.avg("close") * 100).alias("slope"), F.regr_r2("close", "k").alias("r2"), ((F.max("high") - F.min("low")) / F.avg("close") * 100).alias("width"),
        ((F.max_by("close", "ts") - F.min("low")) / (F.max("high") - F.min("low"))).alias("place"))
    kind = F.when((F.col("r2") >= 0.6) & (F.col("slope") >= 0.05), "uptrend").when((F.col("r2") >= 0.6) & (F.col("slope") <= -0.05), "downtrend").when((F.col("width") <= 15) & (F.col("r2") < 0.3), "range").otherwise("mixed")
    return s.select("symbol", r6("slope", F.col("slope")), r6("r2", F.col("r2")), r6("place", F.col("place")), kind.alias("structure"))


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT symbol, ts, high, max(high) OVER w AS top, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
q AS (SELECT symbol, ts, high, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM p WHERE n = 5 AND high = top)
SELECT symbol, ts, high FROM q WHERE nth <= 3""")
def w26_pivot_highs(spark, sf_dir):
    around = series().rowsBetween(-2, 2)
    p = hourly(spark, sf_dir).withColumn("top", F.max("high").over(around)).withColumn("n", F.count("*").over(around)).where((F.col("n") == 5) & (F.col("high") == F.col("top")))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return p.withColumn("nth", nth).where("nth <= 3").select("symbol", "ts", "high")


@query(f"""WITH {DAILY_SQL} SELECT symbol, ts, round(CASE WHEN count(close) {_W.format(9)} = 10 THEN avg(close) {_W.format(9)} + 2 * stddev_samp(close) {_W.format(9)} END, 6) AS upper FROM bars""")
def w27_bollinger(spark, sf_dir):
    """An extension: the reference leaves this study to a chart library."""
    full = F.count("close").over(last_n(10)) == 10
    return daily(spark, sf_dir).select("symbol", "ts", r6("upper", F.when(full, F.avg("close").over(last_n(10)) + 2 * F.stddev_samp("close").over(last_n(10)))))
