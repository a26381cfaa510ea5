"""The forecasting stack (F1-F32): panels, factors, linear models, boosted trees, volatility, regimes, simulation, scores.

What a model learns from is summed by Spark (cross products, histograms, correlations); the driver solves systems whose
size is the number of features. Series models are grouped functions over one symbol's bars. Random draws come from seeds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import skewness, unit_rank
from tidemark.operators.indicators import last_n, r6, rolling_beta, series, with_market
from tidemark.registry import query, table
from tidemark.operators.indicators import _RETURNS_SQL
from tidemark.sources.bars import HOURLY_SQL, MARKET_SQL, USERS_SQL, filled, hourly, market, users_daily

# Panels and factors


def panel(spark, sf_dir) -> DataFrame:
    """Daily bars of users on the market's sessions, gaps filled, with session numbers."""
    b = users_daily(spark, sf_dir)
    days = b.select("ts").distinct()
    t = days.withColumn("t", F.row_number().over(Window.orderBy("ts")) - 1)  # one row a session
    return filled(b, days).join(F.broadcast(t), "ts")


_PANEL_SQL = f"""{USERS_SQL}, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM bars)), span AS (SELECT symbol, min(ts) AS f FROM bars GROUP BY 1),
g AS (SELECT s.symbol, c.ts, c.t, b.open, b.high, b.low, b.close, b.volume, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.ts ROWS UNBOUNDED PRECEDING) AS carried
 FROM span s JOIN cal c ON c.ts >= s.f LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts),
panel AS (SELECT symbol, ts, t, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low, coalesce(close, carried) AS close, coalesce(volume, 0.0) AS volume FROM g)"""


@query(f"WITH {_PANEL_SQL} SELECT t, count(*) AS stocks, count(*) FILTER (WHERE volume = 0) AS carried, round(sum(close), 4) AS total FROM panel GROUP BY 1")
def f1_panel(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("t").agg(F.count("*").alias("stocks"), F.count_if(F.col("volume") == 0).alias("carried"), F.round(F.sum("close"), 4).alias("total"))


def _sound(y: Column) -> Column:
    """0 for what is null or not finite."""
    return F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), 0.0).otherwise(y)


def factors(bars: DataFrame) -> DataFrame:
    """Columns of a symbol's own history at each bar: momentum, reversals, dispersion, volume, distance to extremes. What
    the history is too short for is 0, and so is what isn't finite."""
    c, back = F.col("close"), lambda n: F.lag("close", n).over(series())
    r = F.ln(c / back(1))
    b = bars.withColumn("r", r).withColumn("dv", c * F.col("volume")).withColumn("d", c - back(1))
    full = lambda n, x: F.when(F.count("*").over(last_n(n)) == n, x)
    gain, loss = F.sum(F.greatest(F.col("d"), F.lit(0.0))).over(last_n(14)), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).over(last_n(14))
    x = {
        "mom_12_1": back(21) / back(252) - 1, "mom_6_1": back(21) / back(126) - 1, "rev_21": c / back(21) - 1, "rev_5": c / back(5) - 1, "rev_1": c / back(1) - 1,
        "vol_20": full(20, F.stddev_samp("r").over(last_n(20))), "max_21": full(21, F.max("r").over(last_n(21))), "skew_60": full(60, skewness(F.col("r"), last_n(60))),
        "illiquid": F.ln(1 + F.avg(F.try_divide(F.abs("r"), F.when(F.col("dv") > 0, F.col("dv")))).over(last_n(21)) * 1e9), "vol_ratio": F.ln((F.sum("volume").over(last_n(5)) / 5 + 1) / (F.sum("volume").over(last_n(60)) / 60 + 1)),
        "dollar": F.ln(1 + F.sum("dv").over(last_n(60)) / 60), "high_252": c / F.max("high").over(last_n(252)) - 1, "ma_50": c / F.avg("close").over(last_n(50)) - 1, "ma_200": c / F.avg("close").over(last_n(200)) - 1,
        "rsi_simple": F.when(gain + loss > 0, 100 * gain / (gain + loss)).otherwise(50.0), "night_5": F.sum(F.ln(F.col("open") / back(1))).over(last_n(5)),
    }
    return b.select("symbol", "ts", *[_sound(v).alias(k) for k, v in x.items()])


_OWN = ["mom_12_1", "mom_6_1", "rev_21", "rev_5", "rev_1", "vol_20", "max_21", "skew_60", "illiquid", "vol_ratio", "dollar", "high_252", "ma_50", "ma_200", "rsi_simple", "night_5"]


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT *, ln(close / lag(close) OVER w) AS r, close - lag(close) OVER w AS d, close * volume AS dv, lag(close) OVER w AS c1, lag(close, 21) OVER w AS c21, lag(close, 126) OVER w AS c126, lag(close, 252) OVER w AS c252, lag(close, 5) OVER w AS c5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(coalesce(c21 / c252 - 1, 0), 6) AS mom_12_1, round(coalesce(c21 / c126 - 1, 0), 6) AS mom_6_1, round(coalesce(close / c21 - 1, 0), 6) AS rev_21, round(coalesce(close / c5 - 1, 0), 6) AS rev_5, round(coalesce(close / c1 - 1, 0), 6) AS rev_1,
 round(CASE WHEN count(*) OVER a = 20 THEN coalesce(stddev_samp(r) OVER a, 0) ELSE 0 END, 6) AS vol_20, round(CASE WHEN count(*) OVER m = 21 THEN coalesce(max(r) OVER m, 0) ELSE 0 END, 6) AS max_21,
 round(CASE WHEN count(*) OVER c = 60 AND stddev_samp(r) OVER c > 0 THEN (avg(r * r * r) OVER c - 3 * avg(r) OVER c * avg(r * r) OVER c + 2 * pow(avg(r) OVER c, 3)) / pow(stddev_samp(r) OVER c, 3) ELSE 0 END, 6) AS skew_60,
 round(coalesce(ln(1 + avg(CASE WHEN dv > 0 THEN abs(r) / dv END) OVER m * 1e9), 0), 6) AS illiquid, round(ln((sum(volume) OVER b / 5 + 1) / (sum(volume) OVER c / 60 + 1)), 6) AS vol_ratio, round(ln(1 + sum(dv) OVER c / 60), 6) AS dollar,
 round(close / max(high) OVER y - 1, 6) AS high_252, round(close / avg(close) OVER d - 1, 6) AS ma_50, round(close / avg(close) OVER e - 1, 6) AS ma_200,
 round(CASE WHEN sum(abs(coalesce(d, 0))) OVER f > 0 THEN 100 * sum(greatest(coalesce(d, 0), 0)) OVER f / sum(abs(coalesce(d, 0))) OVER f ELSE 50 END, 6) AS rsi_simple, round(coalesce(sum(ln(open / c1)) OVER b, 0), 6) AS night_5 FROM x
WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), c AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), d AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING),
 e AS (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING), m AS (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING), y AS (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING)""")
def f2_factors(spark, sf_dir):
    x = factors(hourly(spark, sf_dir))
    return x.select("symbol", "ts", *[r6(c, F.col(c)) for c in _OWN])


def context_factors(bars: DataFrame, index: DataFrame, far: int = 63, days: int = 90) -> DataFrame:
    """Factors beside a symbol's own prices: beta and dispersion of what the market leaves, reports (surprise, bars since the
    last and to the next, ``far`` where there is none as near), insiders' purchases and sales known before, recent against
    usual variance; and the market's volatility and momentum. ``bars`` has report (a surprise in percent, null where none
    comes out), bought and sold."""
    w, all_before = series(), series().rowsBetween(Window.unboundedPreceding, 0)
    x = with_market(bars, index).withColumn("beta", rolling_beta()).withColumn("k", F.row_number().over(w))
    left = F.col("r") - F.lag("beta").over(w) * F.col("m")
    idio = F.greatest(F.lit(-0.223), F.least(F.lit(0.223), left))
    x = x.withColumn("idio", F.when(F.col("report").isNull() & left.isNotNull(), idio)).withColumn("at", F.when(F.col("report").isNotNull(), F.col("k")))
    since = F.col("k") - F.last("at", True).over(all_before)
    to = F.first("at", True).over(w.rowsBetween(1, Window.unboundedFollowing)) - F.col("k")
    x = x.withColumn("since", F.when(since < far, since).otherwise(far)).withColumn("to", F.least(F.coalesce(to, F.lit(far)), F.lit(far))).withColumn("surprise", F.last("report", True).over(all_before))
    x = x.withColumn("seconds", F.unix_timestamp(F.col("ts").cast("timestamp")))
    known = Window.partitionBy("symbol").orderBy("seconds").rangeBetween(-days * 86400, -1)
    usual = lambda c, n: F.avg(F.col(c) * F.col(c)).over(last_n(n))
    market_vol = F.sqrt(usual("m", 22) * 252)
    out = {
        "idio_60": F.stddev_samp("idio").over(last_n(60)), "beta": F.col("beta"), "surprise": F.when(F.col("since") < far, F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("surprise")))), "since_report": F.col("since").cast("double"),
        "to_report": F.col("to").cast("double"), "bought": F.ln(1 + F.coalesce(F.sum("bought").over(known), F.lit(0.0))), "sold": F.ln(1 + F.coalesce(F.sum("sold").over(known), F.lit(0.0))),
        "var_ratio": F.sqrt(usual("r", 20) / F.greatest(usual("r", 252), F.lit(1e-8))), "market_vol": market_vol, "implied_vol": market_vol * 100, "market_21": F.sum("m").over(last_n(21)),
    }
    return x.select("symbol", "ts", *[_sound(v).alias(k) for k, v in out.items()])


_CONTEXT = ["idio_60", "beta", "surprise", "since_report", "to_report", "bought", "sold", "var_ratio", "market_vol", "implied_vol", "market_21"]


@query(f"""WITH {_RETURNS_SQL}, flow AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, sum(value) FILTER (WHERE user_id % 2 = 0) AS bought, sum(value) FILTER (WHERE user_id % 2 = 1) AS sold FROM events WHERE value > 200 GROUP BY 1, 2),
k AS (SELECT b.*, row_number() OVER w AS k, greatest(-0.223, least(0.223, CASE WHEN lag(beta) OVER w IS NULL THEN NULL ELSE r - lag(beta) OVER w * m END)) AS idio, CASE WHEN lag(beta) OVER w IS NULL THEN true ELSE false END AS new FROM beta b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
j AS (SELECT k.*, CASE WHEN k % 40 = 7 THEN volume % 120 - 60 END AS report, bought, sold FROM k LEFT JOIN flow USING (symbol, ts)),
q AS (SELECT *, CASE WHEN report IS NULL AND NOT new THEN idio END AS clean, CASE WHEN report IS NOT NULL THEN k END AS at_k FROM j),
g AS (SELECT *, last_value(at_k IGNORE NULLS) OVER b AS last_k, last_value(report IGNORE NULLS) OVER b AS last_report, first_value(at_k IGNORE NULLS) OVER n AS next_k FROM q
 WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, round(coalesce(stddev_samp(clean) OVER a, 0), 6) AS idio_60, round(beta, 6) AS beta, round(CASE WHEN k - last_k < 63 THEN greatest(-50, least(50, last_report)) ELSE 0 END, 6) AS surprise,
 CAST(CASE WHEN k - last_k < 63 THEN k - last_k ELSE 63 END AS DOUBLE) AS since_report, CAST(least(coalesce(next_k - k, 63), 63) AS DOUBLE) AS to_report,
 round(ln(1 + coalesce(sum(bought) OVER f, 0)), 6) AS bought, round(ln(1 + coalesce(sum(sold) OVER f, 0)), 6) AS sold, round(coalesce(sqrt(avg(r * r) OVER c / greatest(avg(r * r) OVER y, 1e-8)), 0), 6) AS var_ratio,
 round(coalesce(sqrt(avg(m * m) OVER d * 252), 0), 6) AS market_vol, round(coalesce(sqrt(avg(m * m) OVER d * 252) * 100, 0), 6) AS implied_vol, round(coalesce(sum(m) OVER e, 0), 6) AS market_21 FROM g
WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING), c AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), d AS (PARTITION BY symbol ORDER BY ts ROWS 21 PRECEDING), e AS (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING),
 y AS (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)""")
def f2_context_factors(spark, sf_dir):
    """Every fortieth bar stands for a report, large events for insiders' trades."""
    side = lambda k: F.sum(F.when(F.col("user_id") % 2 == k, F.col("value")))
    flow = table(spark, sf_dir, "events").where("value > 200").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(side(0).alias("bought"), side(1).alias("sold"))
    index = market(spark, sf_dir)
    b = hourly(spark, sf_dir).join(index.select("ts"), "ts", "left_semi").withColumn("report", F.when(F.row_number().over(series()) % 40 == 7, F.col("volume") % 120 - 60)).join(flow, ["symbol", "ts"], "left")
    return context_factors(b, index).select("symbol", "ts", *[r6(c, F.col(c)) for c in _CONTEXT])


@query(f"""WITH {HOURLY_SQL}, d AS (SELECT symbol, extract(dow FROM ts) AS season, CAST(date_trunc('week', ts) AS DATE) AS year, ln(arg_max(close, ts) / arg_min(close, ts)) AS r FROM bars GROUP BY 1, 2, 3)
SELECT a.symbol, a.season, a.year, round(avg(b.r), 6) AS seasonal FROM d a JOIN d b ON b.symbol = a.symbol AND b.season = a.season AND b.year < a.year AND b.year >= a.year - 28 GROUP BY 1, 2, 3""")
def f3_seasonality(spark, sf_dir):
    """The mean of up to four earlier seasons of the same kind; here days of the week stand for months and weeks for years."""
    d = hourly(spark, sf_dir).groupBy("symbol", (F.dayofweek("ts") - 1).cast("long").alias("season"), F.to_date(F.date_trunc("week", "ts")).alias("year")).agg(F.ln(F.max_by("close", "ts") / F.min_by("close", "ts")).alias("r"))
    w = Window.partitionBy("symbol", "season").orderBy(F.unix_date("year")).rangeBetween(-28, -1)
    return d.withColumn("s", F.avg("r").over(w)).where("s IS NOT NULL").select("symbol", "season", "year", r6("seasonal", F.col("s")))


@query(f"""WITH {_PANEL_SQL}, m AS (SELECT symbol, t, close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY t) - 1 AS mom FROM panel), s AS (SELECT *, symbol % 4 AS sector FROM m WHERE mom IS NOT NULL)
SELECT symbol, t, round(CASE WHEN sector > 0 AND count(*) OVER w >= 5 THEN avg(mom) OVER w ELSE 0 END, 6) AS sector_mom FROM s WINDOW w AS (PARTITION BY t, sector)""")
def f4_sector_fill(spark, sf_dir):
    """The sector's mean momentum where five stocks have one; none for the nameless sector 0."""
    m = panel(spark, sf_dir).withColumn("mom", F.col("close") / F.lag("close", 5).over(series()) - 1).where("mom IS NOT NULL").withColumn("sector", F.col("symbol") % 4)
    w = Window.partitionBy("t", "sector")
    return m.select("symbol", "t", r6("sector_mom", F.when((F.col("sector") > 0) & (F.count("*").over(w) >= 5), F.avg("mom").over(w)).otherwise(0.0)))


_LABEL_SQL = f"""{HOURLY_SQL}, {MARKET_SQL}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER w) AS r, ln(mclose / lag(mclose) OVER w) AS m FROM bars JOIN market USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query(f"""WITH {_LABEL_SQL} SELECT symbol, ts, round(CASE WHEN count(*) OVER w = 5 THEN sum(r) OVER w - 0.8 * sum(m) OVER w END, 6) AS y5 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def f6_abnormal_label(spark, sf_dir):
    """The return over the next five bars less beta (0.8 here) times the market's; null until known."""
    ahead = series().rowsBetween(1, 5)
    y = F.when(F.count("*").over(ahead) == 5, F.sum("r").over(ahead) - 0.8 * F.sum("m").over(ahead))
    return with_market(hourly(spark, sf_dir), market(spark, sf_dir)).select("symbol", "ts", r6("y5", y))


@query(f"WITH {_PANEL_SQL}, n AS (SELECT t, count(*) FILTER (WHERE volume > 0) AS stocks, max(t) OVER () AS last FROM panel GROUP BY t) SELECT t, stocks FROM n WHERE (last - t) % 5 = 0 AND stocks >= 30")
def f7_date_plan(spark, sf_dir):
    n = panel(spark, sf_dir).groupBy("t").agg(F.count_if(F.col("volume") > 0).alias("stocks"))
    last = F.broadcast(n.agg(F.max("t").alias("last")))  # one row
    return n.join(last).where("(last - t) % 5 = 0 AND stocks >= 30").select("t", "stocks")


# Linear models


def gram(rows: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'X, X'y, n) with an intercept first, in one aggregation."""
    cols = [F.lit(1.0), *(F.col(c) for c in x)]
    pairs = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    got = rows.agg(*pairs, *[F.sum(c * F.col(y)) for c in cols]).first()
    k, xx, at = len(cols), np.zeros((len(cols), len(cols))), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[at] or 0.0
            at += 1
    return xx, np.array([v or 0.0 for v in got[at:]]), xx[0, 0]


def ridge(rows: DataFrame, x: list[str], y: str, penalty: float = 0.01) -> np.ndarray:
    """Weights, the unpenalised intercept first."""
    xx, xy, n = gram(rows, x, y)
    return np.linalg.solve(xx + np.diag([0.0] + [penalty * n] * len(x)) + 1e-12 * np.eye(len(xx)), xy)


def linear(weights: np.ndarray, x: list[str]) -> Column:
    out = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], x):
        out = out + float(w) * F.col(c)
    return out


def learning_rows(spark, sf_dir) -> DataFrame:
    """(symbol, t, f1..f4, y): ranked factors of the panel and the next session's return."""
    p = panel(spark, sf_dir)
    lag = lambda n: F.lag("close", n).over(series())
    x = p.select("symbol", "t", (F.col("close") / lag(1) - 1).alias("a"), (F.col("close") / lag(3) - 1).alias("b"), F.ln(1 + F.col("volume")).alias("c"), (F.col("high") / F.col("low") - 1).alias("d"), F.ln(F.lead("close").over(series()) / F.col("close")).alias("y"))
    x = x.where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
    return x.select("symbol", "t", *[unit_rank(F.col(c), ["t"]).alias(f"f{k}") for k, c in enumerate("abcd", 1)], "y")


_X = ["f1", "f2", "f3", "f4"]


@query()
def f8_ridge(spark, sf_dir):
    """Weights learnt from all sessions; tested against numpy on collected rows."""
    rows = learning_rows(spark, sf_dir).cache()
    w = ridge(rows, _X, "y")
    rows.unpersist()
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in zip(["intercept", *_X], w)], "name string, weight double")


@query(f"""WITH {_PANEL_SQL}, x AS (SELECT symbol, t, close / lag(close) OVER w - 1 AS a, close / lag(close, 3) OVER w - 1 AS b, ln(lead(close) OVER w / close) AS y FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t)),
v AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL), r AS (SELECT t, y, (rank() OVER (PARTITION BY t ORDER BY a) - 1 + (count(*) OVER (PARTITION BY t, a) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY t) - 1) * 2 - 1 AS f1 FROM v),
ic AS (SELECT t, corr(f1, y) AS ic FROM r GROUP BY t) SELECT round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t_stat, count(*) AS days FROM ic""")
def f9_information_coefficient(spark, sf_dir):
    ic = learning_rows(spark, sf_dir).groupBy("t").agg(F.corr("f1", "y").alias("ic"))
    return ic.agg(r6("mean_ic", F.avg("ic")), F.round(F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*")), 4).alias("t_stat"), F.count("*").alias("days"))


def newey_west(x: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """(mean, t, n) of a short series: the variance of the mean from autocovariances up to ``lags``, with Bartlett weights.
    ``x`` has one row a session."""
    w = Window.orderBy(order)
    d = x.withColumn("d", F.col(value) - F.avg(value).over(Window.partitionBy()))
    d = d.withColumns({f"d{k}": F.col("d") * F.lag("d", k).over(w) for k in range(1, lags + 1)})
    n = F.count(value)
    total = F.sum(F.col("d") * F.col("d")) / n
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"d{k}"), F.lit(0.0)) / n
    return d.agg(F.avg(value).alias("mean"), F.when(total > 0, F.avg(value) / F.sqrt(total / n)).alias("t"), n.alias("n"))


_IC_SQL = f"""{_PANEL_SQL}, x AS (SELECT symbol, t, close / lag(close) OVER w - 1 AS a, close / lag(close, 3) OVER w - 1 AS b, ln(lead(close) OVER w / close) AS y FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t)),
v AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL), r AS (SELECT t, y, (rank() OVER (PARTITION BY t ORDER BY a) - 1 + (count(*) OVER (PARTITION BY t, a) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY t) - 1) * 2 - 1 AS f1 FROM v),
ic AS (SELECT t, corr(f1, y) AS ic FROM r GROUP BY t)"""


@query(f"""WITH {_IC_SQL}, d AS (SELECT t, ic, ic - avg(ic) OVER () AS d FROM ic), l AS (SELECT ic, d, d * lag(d) OVER w AS d1, d * lag(d, 2) OVER w AS d2, d * lag(d, 3) OVER w AS d3, d * lag(d, 4) OVER w AS d4 FROM d WINDOW w AS (ORDER BY t)),
s AS (SELECT avg(ic) AS m, count(ic) AS n, (sum(d * d) + 2 * (0.8::DOUBLE * sum(d1) + 0.6::DOUBLE * sum(d2) + 0.4::DOUBLE * sum(d3) + 0.2::DOUBLE * sum(d4))) / count(ic) AS v FROM l)
SELECT round(m, 6) AS mean_ic, round(CASE WHEN v > 0 THEN m / sqrt(v / n) END, 4) AS t_stat, round(CASE WHEN v > 0 THEN m * least(1, pow(m / sqrt(v / n) / 2, 2)) END, 6) AS weight, n AS days FROM s""")
def f9_newey_west_weight(spark, sf_dir):
    """The weight of a factor: its mean information coefficient, shrunk where its t, robust to overlap, is under 2."""
    ic = learning_rows(spark, sf_dir).groupBy("t").agg(F.corr("f1", "y").alias("ic"))
    x = newey_west(ic, "ic", "t", 4)
    weight = F.when(F.col("t").isNotNull(), F.col("mean") * F.least(F.lit(1.0), F.pow(F.col("t") / 2, 2)))
    return x.select(r6("mean_ic", F.col("mean")), F.round("t", 4).alias("t_stat"), r6("weight", weight), F.col("n").alias("days"))


@query(f"""WITH {_IC_SQL.split(", ic AS")[0]}, q AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM r), c AS (SELECT f1, least(greatest(y, lo), hi) AS y FROM r, q)
SELECT round(regr_slope(y, f1), 6) AS slope, round(regr_intercept(y, f1), 6) AS intercept, count(*) AS n FROM c""")
def f_winsorised_slope(spark, sf_dir):
    """The slope of returns on a factor, returns drawn in to their first and last percentile."""
    rows = learning_rows(spark, sf_dir).select("f1", "y")
    q = F.broadcast(rows.agg(F.percentile("y", 0.01).alias("lo"), F.percentile("y", 0.99).alias("hi")))  # one row
    c = rows.join(q).withColumn("y", F.least(F.greatest("y", "lo"), "hi"))
    return c.agg(r6("slope", F.regr_slope("y", "f1")), r6("intercept", F.regr_intercept("y", "f1")), F.count("*").alias("n"))


@query(f"""WITH {HOURLY_SQL}, v AS (SELECT symbol, ts, greatest(pow(ln(high / low), 2) / (4 * ln(2::DOUBLE)), 1e-6) AS v FROM bars), h AS (SELECT symbol, v, count(*) OVER w AS n, avg(v) OVER w AS h FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, round(avg(v / h - ln(v / h) - 1), 6) AS qlike, count(*) AS n FROM h WHERE n = 20 GROUP BY 1""")
def f21_qlike(spark, sf_dir):
    """The loss of the mean variance of 20 bars as a forecast of the next one's."""
    v = F.greatest(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0))), F.lit(1e-6))
    w = series().rowsBetween(-20, -1)
    x = hourly(spark, sf_dir).withColumn("v", v).withColumn("n", F.count("*").over(w)).withColumn("h", F.avg("v").over(w)).where("n = 20")
    ratio = F.col("v") / F.col("h")
    return x.groupBy("symbol").agg(r6("qlike", F.avg(ratio - F.ln(ratio) - 1)), F.count("*").alias("n"))


# Boosted trees: histograms by Spark, splits on the driver


def boosted(rows: DataFrame, x: list[str], y: str, trees: int = 5, depth: int = 2, bins: int = 32, rate: float = 0.1, penalty: float = 50.0, least: int = 20):
    """(base, trees): each tree a list of (node, feature, threshold) splits and leaf values. A level of a tree is one
    aggregation of gradients by node, feature and bin; features are in [-1, 1]."""
    base = rows.agg(F.avg(y)).first()[0] or 0.0
    score, model = F.lit(float(base)), []
    bin_of = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) + 1) / 2 * bins)).cast("int")
    for _ in range(trees):
        splits: dict[int, tuple[str, float]] = {}
        leaves: dict[int, float] = {}
        for level in range(depth):
            node = _node(splits, depth)
            grid = rows.select(node.alias("node"), (F.col(y) - score).alias("g"), F.posexplode(F.array(*[bin_of(c) for c in x])).alias("feature", "bin"))
            hist = grid.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.count("*").alias("n")).toPandas()
            for k in range(2**level, 2 ** (level + 1)):
                part = hist[hist.node == k]
                if not len(part):
                    continue
                one = part[part.feature == 0]
                total, count = one.g.sum(), one.n.sum()
                leaves[k] = rate * total / (count + penalty)
                best = (0.0, None)
                for f, h in part.groupby("feature"):
                    h = h.sort_values("bin")
                    gl, nl = h.g.cumsum().to_numpy()[:-1], h.n.cumsum().to_numpy()[:-1]
                    gain = gl**2 / (nl + penalty) + (total - gl) ** 2 / (count - nl + penalty) - total**2 / (count + penalty)
                    gain[(nl < least) | (count - nl < least)] = 0
                    if len(gain) and gain.max() > best[0] + 1e-15:
                        best = (gain.max(), (x[int(f)], (h.bin.to_numpy()[gain.argmax()] + 1) / bins * 2 - 1))
                if best[1]:
                    splits[k] = best[1]
        node = _node(splits, depth)
        sums = rows.select(node.alias("node"), (F.col(y) - score).alias("g")).groupBy("node").agg(F.sum("g"), F.count("*")).collect()
        leaves |= {r[0]: rate * r[1] / (r[2] + penalty) for r in sums}
        model.append((splits, leaves))
        score = score + _leaf(splits, leaves, depth)
    return base, model


def _node(splits: dict, depth: int, k: int = 1) -> Column:
    """The number of the node that a row falls into: 1 for the root, 2k and 2k + 1 below k."""
    if k not in splits:
        return F.lit(k)
    f, cut = splits[k]
    return F.when(F.col(f) < cut, _node(splits, depth, 2 * k)).otherwise(_node(splits, depth, 2 * k + 1))


def _leaf(splits: dict, leaves: dict, depth: int, k: int = 1) -> Column:
    if k not in splits:
        return F.lit(float(leaves.get(k, 0.0)))
    f, cut = splits[k]
    return F.when(F.col(f) < cut, _leaf(splits, leaves, depth, 2 * k)).otherwise(_leaf(splits, leaves, depth, 2 * k + 1))


def boosted_score(base: float, model: list, depth: int = 2) -> Column:
    out = F.lit(float(base))
    for splits, leaves in model:
        out = out + _leaf(splits, leaves, depth)
    return out


@query()
def f10_boosted_trees(spark, sf_dir):
    """Predictions of held-out sessions; tested on a planted interaction."""
    rows = learning_rows(spark, sf_dir).cache()
    base, model = boosted(rows.where("t < 20"), _X, "y", trees=3)
    return rows.where("t >= 20").select("symbol", "t", r6("predicted", boosted_score(base, model)))


# Volatility and regimes


HAR = ["day", "week", "month", "year", "market_month", "market_week"]


def har_rows(bars: DataFrame, index: DataFrame, h: int = 5, year: int = 252) -> DataFrame:
    """(symbol, ts, ``HAR``, y): logs of the mean variance over 1, 5, 22 and ``year`` bars, of the market's over 22 and 5 (which
    stands for the variance that options imply), and of the next ``h`` bars' mean. ``index``: (ts, mclose)."""
    floor = F.lit(1e-8)
    square = lambda c: F.pow(F.ln(F.col(c) / F.lag(c).over(series())), 2)
    market_w = lambda n: Window.orderBy("ts").rowsBetween(1 - n, 0)  # noqa: E731  one row a bar of the market
    m = index.withColumn("m2", F.pow(F.ln(F.col("mclose") / F.lag("mclose").over(Window.orderBy("ts"))), 2))
    m = m.select("ts", *[F.avg("m2").over(market_w(n)).alias(f"m{n}") for n in (22, 5)])
    b = bars.withColumn("v", F.greatest(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * math.log(2)), floor)).withColumn("r2", square("close")).join(m, "ts")
    log = lambda x: F.ln(F.greatest(x, floor))
    ahead = series().rowsBetween(1, h)
    x = b.select(
        "symbol", "ts", log(F.col("v")).alias("day"), log(F.avg("v").over(last_n(5))).alias("week"), log(F.avg("v").over(last_n(22))).alias("month"), log(F.avg("r2").over(last_n(year))).alias("year"),
        log(F.col("m22")).alias("market_month"), log(F.col("m5")).alias("market_week"), F.when(F.count("*").over(ahead) == h, log(F.avg("v").over(ahead))).alias("y"), F.row_number().over(series()).alias("k"))
    return x.where(F.col("k") > year).where("y IS NOT NULL AND market_week IS NOT NULL").drop("k")


def har(rows: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights of the log-variance regression, the intercept first, and the smearing factor: the mean ratio of variance to
    forecast, ratios over their 99th percentile drawn in to it. None of under 200 rows."""
    if rows.count() < 200:
        return None
    w = ridge(rows, HAR, "y", 1e-6)
    ratio = rows.select(F.exp(F.col("y") - linear(w, HAR)).alias("r"))
    most = ratio.agg(F.percentile_approx("r", 0.99, 10_000)).first()[0]
    return w, ratio.agg(F.avg(F.least("r", F.lit(most)))).first()[0]


@query()
def f11_har(spark, sf_dir):
    """Weights of the regression over all bars, with 60 for a year of them, and its smearing factor; none of under 200 rows.
    Tested against numpy in tests/test_series.py."""
    rows = har_rows(hourly(spark, sf_dir), market(spark, sf_dir), year=60).cache()
    model = har(rows)
    rows.unpersist()
    named = zip(["intercept", *HAR, "smearing"], [*model[0], model[1]]) if model else []
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in named], "name string, weight double")


def nelder_mead(f, start: np.ndarray, step: float = 0.6, rounds: int = 300) -> np.ndarray:
    """The best corner of a simplex that reflects, expands, contracts and shrinks."""
    n = len(start)
    x = np.vstack([start, start + step * np.eye(n)])
    y = np.array([f(p) for p in x])
    for _ in range(rounds):
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        mid = x[:-1].mean(0)
        far = mid + (mid - x[-1])
        fy = f(far)
        if fy < y[0]:
            out = mid + 2 * (mid - x[-1])
            oy = f(out)
            x[-1], y[-1] = (out, oy) if oy < fy else (far, fy)
        elif fy < y[-2]:
            x[-1], y[-1] = far, fy
        else:
            near = mid + 0.5 * ((far if fy < y[-1] else x[-1]) - mid)
            ny = f(near)
            if ny < min(fy, y[-1]):
                x[-1], y[-1] = near, ny
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = [f(p) for p in x[1:]]
    return x[y.argmin()]


def garch_parameters(z: np.ndarray) -> tuple[float, float, float, float]:
    """(alpha, gamma, beta, degrees) from unbounded numbers; persistence alpha + gamma / 2 + beta under 1."""
    s = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    total, lever, new = 0.999 * s(z[0]), s(z[2] - 1.0), s(z[1] - 4.0)
    return total * new * (1 - lever), 2 * total * new * lever, total * (1 - new), 2.1 + math.exp(min(5.0, z[3]))


def garch_fit(r: np.ndarray) -> tuple[float, float, float, float, np.ndarray]:
    """A variance that reacts more to falls, with heavy-tailed shocks, its long-run level fixed at the sample's; and the
    variance of each bar."""
    level, sq, down = float(r.var()) or 1e-12, r * r, r * r * (r < 0)

    def variances(p):
        a, g, b, _ = p
        out, h = np.empty(len(r)), level
        rest = level * (1 - a - g / 2 - b)
        for i in range(len(r)):
            out[i] = h
            h = rest + a * sq[i] + g * down[i] + b * h
        return np.maximum(out, 1e-12)

    def loss(z):
        p = garch_parameters(z)
        h, v = variances(p), p[3]
        k = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2))
        return -float((k - 0.5 * np.log(h) - (v + 1) / 2 * np.log1p(sq / (h * (v - 2)))).sum())

    p = garch_parameters(nelder_mead(loss, np.array([3.5, 2.2, 0.0, 1.6]), 0.6, 60))
    return (*p, variances(p))


@query()
def f12_garch(spark, sf_dir):
    """Parameters of each symbol's series; tested by recovery from simulated draws."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.diff(np.log(pdf.sort_values("ts")["close"].to_numpy(float)))
        a, g, b, v, h = garch_fit(r)
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "persistence": [a + g / 2 + b], "leverage": [g], "degrees": [v], "last_variance": [h[-1]]})

    return hourly(spark, sf_dir).groupBy("symbol").applyInPandas(fit, "symbol string, persistence double, leverage double, degrees double, last_variance double")


def regimes(x: np.ndarray, rounds: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, transitions, filtered chances) of two states, the calmer first, by expectation maximisation."""
    s = x.std() or 1e-9
    mu, sd, move, start, last = np.zeros(2) + x.mean(), np.array([0.6, 1.6]) * s, np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([0.5, 0.5]), -np.inf
    for _ in range(rounds):
        dens = np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) + 1e-300
        fwd, scale, p = np.empty((len(x), 2)), np.empty(len(x)), start
        for i in range(len(x)):
            p = (p if i == 0 else p @ move) * dens[i]
            scale[i] = p.sum()
            fwd[i] = p = p / scale[i]
        back, pair = np.ones((len(x), 2)), np.zeros((2, 2))
        for i in range(len(x) - 2, -1, -1):
            nxt = dens[i + 1] * back[i + 1] / scale[i + 1]
            pair += np.outer(fwd[i], nxt) * move
            back[i] = move @ nxt
        post = fwd * back
        post /= post.sum(1, keepdims=True)
        start, move = post[0], pair / pair.sum(1, keepdims=True)
        mu = (post * x[:, None]).sum(0) / post.sum(0)
        sd = np.maximum(np.sqrt((post * (x[:, None] - mu) ** 2).sum(0) / post.sum(0)), 1e-9)
        like = np.log(scale).sum()
        if abs(like - last) < tol * abs(like):
            break
        last = like
    order = np.argsort(sd)
    return mu[order], sd[order], move[np.ix_(order, order)], fwd[:, order]


@query()
def f13_regimes(spark, sf_dir):
    """The market's two states; tested by recovery from simulated draws."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.diff(np.log(pdf.sort_values("ts")["mclose"].to_numpy(float)))
        mu, sd, move, p = regimes(r)
        return pd.DataFrame({"state": [0, 1], "mean": mu, "deviation": sd, "stays": np.diag(move), "now": p[-1]})

    return market(spark, sf_dir).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "state int, mean double, deviation double, stays double, now double")


@query(f"""WITH {_LABEL_SQL}, i AS (SELECT symbol, r - 0.8 * m AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM x WHERE r IS NOT NULL)
SELECT symbol, count(*) AS shocks, round(stddev_samp(z), 6) AS spread, round(quantile_cont(z, 0.05), 6) AS low FROM i WHERE nth <= 504 GROUP BY 1 HAVING count(*) >= 100""")
def f15_shock_pools(spark, sf_dir):
    x = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).where("r IS NOT NULL")
    i = x.withColumn("z", F.col("r") - 0.8 * F.col("m")).withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("nth <= 504")
    return i.groupBy("symbol").agg(F.count("*").alias("shocks"), r6("spread", F.stddev_samp("z")), r6("low", F.percentile("z", 0.05))).where("shocks >= 100")


def simulated(pool: DataFrame, n: int = 2000, horizons: tuple[int, ...] = (5, 10, 20), seed: int = 5) -> DataFrame:
    """(symbol, h, p_up, mean, q05..q95): paths of draws from a symbol's own shocks, with replacement."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf["z"].to_numpy(float)
        rng = np.random.default_rng([seed, int.from_bytes(str(pdf["symbol"].iloc[0]).encode()[:7], "little")])
        paths = np.cumsum(rng.choice(np.sort(z), (n, max(horizons))), axis=1)
        rows = [(pdf["symbol"].iloc[0], h, float((paths[:, h - 1] > 0).mean()), float(paths[:, h - 1].mean()), *np.quantile(paths[:, h - 1], [0.05, 0.5, 0.95])) for h in horizons]
        return pd.DataFrame(rows, columns=["symbol", "h", "p_up", "mean", "q05", "q50", "q95"])

    return pool.groupBy("symbol").applyInPandas(work, "symbol string, h int, p_up double, mean double, q05 double, q50 double, q95 double")


@query()
def f17_f18_simulation(spark, sf_dir):
    """Seeded; tested by its distribution."""
    x = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).where("r IS NOT NULL")
    return simulated(x.select(F.col("symbol").cast("string").alias("symbol"), (F.col("r") - 0.8 * F.col("m")).alias("z")))


# Scores


def crps(draws: Column, y: Column) -> Column:
    """The score of an ensemble: mean distance to the outcome less half the mean distance between draws."""
    s, n = F.array_sort(draws), F.size(draws)
    near = F.aggregate(F.transform(s, lambda v: F.abs(v - y)), F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(F.transform(s, lambda v, k: v * (2 * (k + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v) / (n * n)
    return near - spread


def pit(draws: Column, y: Column) -> Column:
    """The share of draws below the outcome, ties half."""
    below, equal = F.size(F.filter(draws, lambda v: v < y)), F.size(F.filter(draws, lambda v: v == y))
    return (below + 0.5 * equal) / F.size(draws)


_ENS_SQL = f"""{HOURLY_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, list(close) AS x, arg_max(close, ts) AS y FROM bars GROUP BY 1, 2), e AS (SELECT symbol, day, x, lead(y) OVER (PARTITION BY symbol ORDER BY day) AS y FROM d)"""


def _ensembles(spark, sf_dir) -> DataFrame:
    d = hourly(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list("close").alias("x"), F.max_by("close", "ts").alias("last"))
    return d.withColumn("y", F.lead("last").over(Window.partitionBy("symbol").orderBy("day"))).where("y IS NOT NULL")


@query(f"""WITH {_ENS_SQL} SELECT symbol, day, round(list_avg(list_transform(x, lambda v: abs(v - y))) - list_avg(flatten(list_transform(x, lambda v: list_transform(x, lambda u: abs(u - v))))) / 2, 10) AS crps,
 round((len(list_filter(x, lambda v: v < y)) + 0.5::DOUBLE * len(list_filter(x, lambda v: v = y))) / len(x), 6) AS pit FROM e WHERE y IS NOT NULL""")
def f21_proper_scores(spark, sf_dir):
    return _ensembles(spark, sf_dir).select("symbol", "day", F.round(crps(F.col("x"), F.col("y")), 10).alias("crps"), r6("pit", pit(F.col("x"), F.col("y"))))


def pooled_adjacent(p: list[float], w: list[float]) -> list[float]:
    """The nearest rising sequence to p with weights w."""
    out: list[list[float]] = []
    for v, n in zip(p, w):
        out.append([v, n, 1])
        while len(out) > 1 and out[-2][0] > out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, k in out for _ in range(int(k))]


@query()
def f20_isotonic_calibration(spark, sf_dir):
    """Chances by twenty bins, counted by Spark and made to rise; tested against a plain version."""
    from tidemark.operators.relational import _forecasts

    bins = _forecasts(spark, sf_dir).groupBy(F.least(F.lit(19), F.floor(F.col("p") * 20)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("hit").alias("rate")).orderBy("bin").collect()
    p = pooled_adjacent([b["rate"] for b in bins], [b["n"] for b in bins])
    return spark.createDataFrame([(b["bin"], b["n"], round(min(0.99, max(0.01, v)), 6)) for b, v in zip(bins, p)], "bin int, n long, calibrated double")


@query(f"WITH {_ENS_SQL}, q AS (SELECT symbol, y, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM (SELECT symbol, day, y, unnest(x) AS v FROM e WHERE y IS NOT NULL) GROUP BY symbol, day, y) SELECT symbol, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage80 FROM q GROUP BY 1")
def f25_live_scores(spark, sf_dir):
    """How often an outcome lies in the inner four fifths of its forecast."""
    q = _ensembles(spark, sf_dir).select("symbol", "day", "y", F.explode("x").alias("v")).groupBy("symbol", "day", "y").agg(F.percentile("v", 0.1).alias("lo"), F.percentile("v", 0.9).alias("hi"))
    return q.groupBy("symbol").agg(F.count("*").alias("n"), r6("coverage80", F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))))


def walk_forward(rows: DataFrame, x: list[str], y: str, step: int = 5, train: int = 15, gap: int = 1) -> DataFrame:
    """(t, ic, spread, n) of each tested session: a model of the ``train`` sessions that end ``gap`` before a block of
    ``step`` sessions. One aggregation a block learns, one scores; the driver holds weights only."""
    first, last = rows.agg(F.min("t"), F.max("t")).first()
    out = None
    for start in range((first or 0) + train + gap, (last if last is not None else -1) + 1, step):
        w = ridge(rows.where((F.col("t") < start - gap) & (F.col("t") >= start - gap - train)), x, y)
        test = rows.where((F.col("t") >= start) & (F.col("t") < start + step)).withColumn("s", linear(w, x)).withColumn("r", F.percent_rank().over(Window.partitionBy("t").orderBy("s")))
        got = test.groupBy("t").agg(F.corr("s", y).alias("ic"), (F.avg(F.when(F.col("r") >= 0.9, F.col(y))) - F.avg(F.when(F.col("r") <= 0.1, F.col(y)))).alias("spread"), F.count("*").alias("n"))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.select("t", F.lit(0.0).alias("ic"), F.lit(0.0).alias("spread"), F.lit(0).cast("long").alias("n")).limit(0)


@query()
def f22_walk_forward(spark, sf_dir):
    """Tested on a planted effect."""
    x = walk_forward(learning_rows(spark, sf_dir).cache(), _X, "y")
    return x.select("t", r6("ic", F.col("ic")), r6("spread", F.col("spread")), "n")


@query(f"""WITH {HOURLY_SQL}, r AS (SELECT symbol, ln(close / lag(close) OVER w) AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(r) AS n, round(quantile_cont(r, 0.1), 6) AS q10, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.9), 6) AS q90 FROM r WHERE nth <= 504 GROUP BY 1 HAVING count(r) >= 100""")
def f27_history_prior(spark, sf_dir):
    r = hourly(spark, sf_dir).withColumn("r", F.ln(F.col("close") / F.lag("close").over(series()))).withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("nth <= 504")
    return r.groupBy("symbol").agg(F.count("r").alias("n"), *[r6(f"q{int(q * 100)}", F.percentile("r", q)) for q in (0.1, 0.5, 0.9)]).where("n >= 100")


@query(f"""WITH {HOURLY_SQL}, o AS (SELECT event_id, event_type AS symbol, ts AS made FROM events), a AS (SELECT o.event_id, b.ts, b.close, row_number() OVER (PARTITION BY o.event_id ORDER BY b.ts) AS nth FROM o JOIN bars b ON b.symbol = o.symbol AND b.ts > o.made)
SELECT event_id, ts AS resolved_at, close FROM a WHERE nth = 5""")
def f28_outlook_resolution(spark, sf_dir):
    """The close of the fifth bar after an outlook was made; the bars' order numbers replace a range join."""
    b = hourly(spark, sf_dir).select("symbol", "ts", "close")
    o = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("made"))
    both = b.withColumn("event_id", F.lit(None).cast("long")).unionByName(o.select("symbol", F.col("made").alias("ts"), "event_id"), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", F.col("event_id").asc_nulls_first())
    k = both.withColumn("k", F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    target = k.where("event_id IS NOT NULL").select("event_id", "symbol", (F.col("k") + 5).alias("k"))
    return target.join(k.where("event_id IS NULL").select("symbol", "k", F.col("ts").alias("resolved_at"), "close"), ["symbol", "k"]).select("event_id", "resolved_at", "close")


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS filed, o_orderstatus AS code, count(DISTINCT o_orderkey) AS filings, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2, 3""")
def f29_insider_flows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'")
    return o.groupBy("o_custkey", F.to_date("o_orderdate").alias("filed"), F.col("o_orderstatus").alias("code")).agg(F.countDistinct("o_orderkey").alias("filings"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("""WITH h AS (SELECT user_id, count(*) FILTER (WHERE extract(hour FROM ts) >= 16) * 2 > count(*) AS late FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT c.user_id, coalesce(late, true) AS after_close FROM (SELECT DISTINCT user_id FROM events) c LEFT JOIN h USING (user_id)""")
def f32_report_timing(spark, sf_dir):
    """Whether most reports come after the close; unknown counts as yes."""
    e = table(spark, sf_dir, "events")
    h = e.where("event_type = 'purchase'").groupBy("user_id").agg((F.count_if(F.hour("ts") >= 16) * 2 > F.count("*")).alias("late"))
    return e.select("user_id").distinct().join(h, "user_id", "left").select("user_id", F.coalesce("late", F.lit(True)).alias("after_close"))


# Blends, jumps, ensembles, scenarios


@query(f"""WITH {HOURLY_SQL}, v AS (SELECT symbol, ts, greatest(pow(ln(high / low), 2) / (4 * ln(2.0::DOUBLE)), 1e-6) AS v FROM bars),
w AS (SELECT symbol, ts, avg(v) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS short, avg(v) OVER (PARTITION BY symbol ORDER BY ts ROWS 65 PRECEDING) AS long FROM v)
SELECT symbol, ts, round(0.75 * short + 0.25 * long, 6) AS h5, round(long + (0.75 * short + 0.25 * long - long) * pow(0.9::DOUBLE, 15), 6) AS h20 FROM w""")
def f14_term_structure(spark, sf_dir):
    """A blend of a fast and a slow variance, and its way back to the slow one over a longer horizon."""
    v = F.greatest(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0))), F.lit(1e-6))
    w = hourly(spark, sf_dir).withColumn("v", v).select("symbol", "ts", F.avg("v").over(last_n(5)).alias("short"), F.avg("v").over(last_n(66)).alias("long"))
    blend = 0.75 * F.col("short") + 0.25 * F.col("long")
    return w.select("symbol", "ts", r6("h5", blend), r6("h20", F.col("long") + (blend - F.col("long")) * F.pow(F.lit(0.9), 15)))


@query(f"""WITH {HOURLY_SQL}, j AS (SELECT symbol, ts, ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS jump, extract(hour FROM ts) IN (9, 16) AS report FROM bars),
own AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM j WHERE report AND jump IS NOT NULL), pool AS (SELECT stddev_samp(jump) AS sd FROM own WHERE nth <= 24)
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN stddev_samp(jump) ELSE (SELECT sd FROM pool) END, 6) AS spread, round(max(jump) - avg(jump), 6) AS largest FROM own WHERE nth <= 24 GROUP BY 1""")
def f16_report_jumps(spark, sf_dir):
    """Jumps at reports: a symbol's own last 24 if eight are there, else the pool's spread; demeaned."""
    j = hourly(spark, sf_dir).withColumn("jump", F.ln(F.col("open") / F.lag("close").over(series()))).where(F.hour("ts").isin(9, 16) & F.col("jump").isNotNull())
    own = j.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("nth <= 24")
    pool = F.broadcast(own.agg(F.stddev_samp("jump").alias("sd")))  # one row
    g = own.groupBy("symbol").agg(F.count("*").alias("n"), F.stddev_samp("jump").alias("s"), r6("largest", F.max("jump") - F.avg("jump"))).join(pool)
    return g.select("symbol", "n", r6("spread", F.when(F.col("n") >= 8, F.col("s")).otherwise(F.col("sd"))), "largest")


@query(f"""WITH {_PANEL_SQL}, x AS (SELECT symbol, t, close / lag(close) OVER w - 1 AS a, close / lag(close, 3) OVER w - 1 AS b FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t)), v AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT symbol, t, 0.5 * (a - avg(a) OVER d) / nullif(stddev_samp(a) OVER d, 0) + 0.5 * (b - avg(b) OVER d) / nullif(stddev_samp(b) OVER d, 0) AS s FROM v WINDOW d AS (PARTITION BY t))
SELECT symbol, t, round(s, 6) AS ensemble FROM z WHERE s IS NOT NULL""")
def f19_ensemble_score(spark, sf_dir):
    """Two scores, each in units of its session's spread, in equal parts."""
    lag = lambda n: F.lag("close", n).over(series())
    v = panel(spark, sf_dir).select("symbol", "t", (F.col("close") / lag(1) - 1).alias("a"), (F.col("close") / lag(3) - 1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    d = Window.partitionBy("t")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(d), F.stddev_samp(c).over(d))
    return v.select("symbol", "t", r6("ensemble", 0.5 * z("a") + 0.5 * z("b"))).where("ensemble IS NOT NULL")


@query(f"""WITH {_ENS_SQL}, q AS (SELECT symbol, day, y, quantile_cont(v, 0.5) AS m FROM (SELECT symbol, day, y, unnest(x) AS v FROM e WHERE y IS NOT NULL) GROUP BY 1, 2, 3)
SELECT date_trunc('week', day)::DATE AS period, count(*) AS n, round(avg(CASE WHEN y > m THEN 1.0 ELSE 0 END), 6) AS above FROM q GROUP BY GROUPING SETS ((date_trunc('week', day)::DATE), ())""")
def f24_pooled_summary(spark, sf_dir):
    """Each period's record and all of them together (period null)."""
    q = _ensembles(spark, sf_dir).select("symbol", "day", "y", F.explode("x").alias("v")).groupBy("symbol", "day", "y").agg(F.percentile("v", 0.5).alias("m"))
    return q.rollup(F.to_date(F.date_trunc("week", "day")).alias("period")).agg(F.count("*").alias("n"), r6("above", F.avg((F.col("y") > F.col("m")).cast("double"))))


def scenario(draws: Column, low: float, high: float) -> Column:
    """Chances of under ``low``, between, and over ``high``."""
    n = F.size(draws)
    down, up = F.size(F.filter(draws, lambda v: v < low)) / n, F.size(F.filter(draws, lambda v: v > high)) / n
    return F.struct(down.alias("down"), (1 - down - up).alias("middle"), up.alias("up"))


@query(f"WITH {_ENS_SQL} SELECT symbol, day, round(len(list_filter(x, lambda v: v < 20))::DOUBLE / len(x), 6) AS down, round(len(list_filter(x, lambda v: v > 60))::DOUBLE / len(x), 6) AS up FROM e WHERE y IS NOT NULL")
def f26_scenarios(spark, sf_dir):
    s = _ensembles(spark, sf_dir).select("symbol", "day", scenario(F.col("x"), 20.0, 60.0).alias("s"))
    return s.select("symbol", "day", r6("down", F.col("s.down")), r6("up", F.col("s.up")))


@query(f"""WITH {_RETURNS_SQL}, l AS (SELECT symbol, arg_max(beta, ts) AS beta, var_samp(r) AS total, var_samp(m) AS mv FROM beta GROUP BY 1) SELECT symbol, round(greatest(total - beta * beta * mv, 0.15 * total), 6) AS idio_variance FROM l""")
def f31_simulation_inputs(spark, sf_dir):
    """A symbol's own variance: what the market doesn't explain, at least 15 percent."""
    from tidemark.operators.indicators import rolling_beta

    x = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).withColumn("beta", rolling_beta())
    l = x.groupBy("symbol").agg(F.max_by("beta", "ts").alias("beta"), F.var_samp("r").alias("total"), F.var_samp("m").alias("mv"))
    return l.select("symbol", r6("idio_variance", F.greatest(F.col("total") - F.col("beta") * F.col("beta") * F.col("mv"), 0.15 * F.col("total"))))
