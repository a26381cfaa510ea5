"""Outlooks: a prior distribution from a symbol's own history, its grid, scenarios and bounded adjustments, closed-form
scores of normal forecasts, and what past sessions say about the weight of a score.

A distribution travels as an array of 19 quantiles, so everything after the windows is an expression on a row a symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import _ENS_SQL, _IC_SQL, _ensembles, learning_rows, newey_west
from tidemark.operators.indicators import r6, series
from tidemark.registry import query
from tidemark.sources.bars import HOURLY_SQL, hourly

LEVELS = [k / 20 for k in range(1, 20)]
POINTS = 199

# Normal distribution


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def series_terms(z: Column, terms: int = 120) -> Column:
    """How many terms of the series change the total: those left out are below a half of its last binary place."""
    upto = F.when(F.abs(z) <= 1, 16).when(F.abs(z) <= 2, 25).when(F.abs(z) <= 4, 44).otherwise(terms)
    return F.least(upto, F.lit(terms))


def normal_cdf(z: Column, terms: int = 120) -> Column:
    """Marsaglia's series; beyond eight deviations the value there."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    start = F.struct(z.alias("term"), z.alias("total"))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return 0.5 + normal_pdf(z) * F.aggregate(F.sequence(F.lit(1), series_terms(z, terms)), start, more, lambda s: s["total"])


def normal_crps(mean: Column, sd: Column, y: Column, cdf: Column | None = None) -> Column:
    """The continuous ranked probability score of a normal forecast; the absolute error where its spread is 0. ``cdf``:
    ``normal_cdf`` of the outcome in deviations, where it is known."""
    z = F.try_divide(y - mean, sd)
    score = sd * (z * (2 * (normal_cdf(z) if cdf is None else cdf) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    return F.when(sd > 0, score).otherwise(F.abs(y - mean))


_CDF_SQL = """(0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2::DOUBLE) - lgamma(k + 1.5::DOUBLE) + ln(pi()) / 2))))"""


@query(f"""WITH {_ENS_SQL}, m AS (SELECT symbol, day, y, list_avg(x) AS mean, list_stddev_samp(x) AS sd FROM e WHERE y IS NOT NULL AND len(x) > 1), z AS (SELECT *, least(greatest((y - mean) / sd, -8), 8) AS z FROM m WHERE sd > 0)
SELECT symbol, day, round({_CDF_SQL}, 6) AS pit, round(sd * ((y - mean) / sd * (2 * {_CDF_SQL} - 1) + 2 * exp(-pow((y - mean) / sd, 2) / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())), 6) AS crps FROM z""")
def f21_normal_scores(spark, sf_dir):
    """Next day's last close under a normal forecast with the mean and spread of today's closes."""
    v = F.explode("x").alias("v")
    m = _ensembles(spark, sf_dir).select("symbol", "day", "y", v).groupBy("symbol", "day", "y").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).where("sd > 0")
    z = (F.col("y") - F.col("mean")) / F.col("sd")
    return m.select("symbol", "day", r6("pit", normal_cdf(z)), r6("crps", normal_crps(F.col("mean"), F.col("sd"), F.col("y"))))


# Prior from history


def history_prior(bars: DataFrame, horizon: int = 5, span: int = 504) -> DataFrame:
    """A symbol's returns over ``horizon`` bars within its newest ``span``, rescaled to the spread of its last 20 bars
    (0.6 to 2.5 times): quantiles, chance of a rise, volatilities and the threshold of a large move, in percent.
    Symbols with under 260 bars or under 100 such returns have no row."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    b = bars.select("symbol", "ts", "close").withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= span + 1)
    b = b.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where("n >= 260")
    b = b.withColumn("r", F.ln(F.col("close") / F.lead("close").over(newest)))
    far = F.when(F.col("nth") <= F.col("n") - 1 - horizon, F.ln(F.col("close") / F.lead("close", horizon).over(newest)))
    spread = lambda n: F.stddev_samp(F.when(F.col("nth") <= n, F.col("r")))
    s = b.withColumn("far", far).groupBy("symbol").agg(
        F.count("far").alias("n"), F.avg((F.col("far") > 0).cast("double")).alias("p_up"), F.percentile("far", LEVELS).alias("q"),
        spread(span).alias("long"), spread(20).alias("recent"), spread(252).alias("year"),
    ).where("n >= 100")
    ratio = F.least(F.greatest(F.col("recent") / F.col("long"), F.lit(0.6)), F.lit(2.5))
    scale = F.when((F.col("long") > 0) & (F.col("recent") > 0), ratio).otherwise(1.0)
    return s.withColumn("scale", scale).select(
        "symbol", "n", "p_up", F.transform("q", lambda v: F.expm1(v * F.col("scale"))).alias("quantiles"),
        (F.col("recent") * math.sqrt(252) * 100).alias("vol_pct"), (F.col("year") * math.sqrt(252) * 100).alias("normal_vol_pct"),
        (F.col("year") * math.sqrt(horizon) * 100).alias("threshold_pct"),
    )


def grid(quantiles: Column) -> Column:
    """Log returns at 1/200 to 199/200: straight lines between the 19 quantiles, 1.5 times the outermost slope beyond."""
    lq = F.transform(quantiles, lambda v: F.log1p(F.greatest(v, F.lit(-0.99))))
    at = lambda i: F.get(lq, i)

    def point(k: Column) -> Column:
        j, f = F.floor(k / 10).cast("int"), (k % 10) / 10
        low = at(F.lit(0)) - (at(F.lit(1)) - at(F.lit(0))) * (10 - k) * 0.15
        high = at(F.lit(18)) + (at(F.lit(18)) - at(F.lit(17))) * (k - 190) * 0.15
        return F.when(k <= 10, low).when(k >= 190, high).otherwise(at(j - 1) * (1 - f) + at(j) * f)

    return F.transform(F.sequence(F.lit(1), F.lit(POINTS)), point)


def scenarios(g: Column, threshold_pct: Column) -> Column:
    """Chances of a rise over the threshold, a fall below it, and neither, with the mean move in each, in percent."""
    t = F.log1p(threshold_pct / 100)
    bull, bear = F.filter(g, lambda v: v > t), F.filter(g, lambda v: v < -t)
    base = F.filter(g, lambda v: (v <= t) & (v >= -t))
    share = lambda a: F.round(F.size(a) / POINTS, 4)

    def move(a: Column, otherwise: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, v: s + F.expm1(v) * 100)
        return F.when(F.size(a) > 0, F.round(F.try_divide(total, F.size(a)), 2)).otherwise(otherwise)

    return F.struct(
        share(bull).alias("bull"), share(base).alias("base"), share(bear).alias("bear"),
        move(bull, threshold_pct * 1.5).alias("bull_move"), move(base, F.lit(0.0)).alias("base_move"), move(bear, threshold_pct * -1.5).alias("bear_move"),
    )


def moved(g: Column, shift: Column, scale: Column) -> Column:
    """The grid shifted by at most half its spread and widened 0.7 to 1.6 times about its median; a scale of 0 is 1."""
    shift = F.least(F.greatest(shift, F.lit(-0.5)), F.lit(0.5))
    scale = F.least(F.greatest(F.when(scale == 0, 1.0).otherwise(scale), F.lit(0.7)), F.lit(1.6))
    mean = F.aggregate(g, F.lit(0.0), lambda s, v: s + v) / POINTS
    sd = F.sqrt(F.aggregate(g, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (POINTS - 1))
    middle = F.get(g, F.lit(99))
    return F.transform(g, lambda v: middle + scale * (v - middle) + shift * sd)


_PRIOR_SQL = f"""{HOURLY_SQL}, k AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM bars),
c AS (SELECT symbol, nth, count(*) OVER (PARTITION BY symbol) AS n, ln(close / lead(close) OVER w) AS r, ln(close / lead(close, 5) OVER w) AS far FROM k WHERE nth <= 505 WINDOW w AS (PARTITION BY symbol ORDER BY nth)),
s AS (SELECT symbol, count(far) FILTER (nth <= n - 6) AS n, avg(CASE WHEN far > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (nth <= n - 6) AS p_up, quantile_cont(far, [{", ".join(map(str, LEVELS))}]) FILTER (nth <= n - 6) AS q,
stddev_samp(r) AS long, stddev_samp(r) FILTER (nth <= 20) AS recent, stddev_samp(r) FILTER (nth <= 252) AS year FROM c WHERE n >= 260 GROUP BY symbol),
p AS (SELECT symbol, n, p_up, list_transform(q, lambda v: exp(v * CASE WHEN long > 0 AND recent > 0 THEN least(greatest(recent / long, 0.6), 2.5) ELSE 1 END) - 1) AS quantiles, recent * sqrt(252) * 100 AS vol_pct, year * sqrt(252) * 100 AS normal_vol_pct, year * sqrt(5) * 100 AS threshold_pct FROM s WHERE n >= 100)"""


def _grid_sql(q: str) -> str:
    at = lambda i: f"ln(1 + greatest({q}[{i}], -0.99))"
    return f"""list_transform(range(1, 200), lambda k: CASE WHEN k <= 10 THEN {at(1)} - ({at(2)} - {at(1)}) * (10 - k) * 0.15::DOUBLE WHEN k >= 190 THEN {at(19)} + ({at(19)} - {at(18)}) * (k - 190) * 0.15::DOUBLE
 ELSE {at("k // 10")} * (1 - (k % 10) / 10.0::DOUBLE) + {at("k // 10 + 1")} * (k % 10) / 10.0::DOUBLE END)"""


def _moves_sql(name: str, inside: str, otherwise: str) -> str:
    return f"round(len(list_filter(g, lambda v: {inside})) / 199.0::DOUBLE, 4) AS {name}, coalesce(round(list_avg(list_transform(list_filter(g, lambda v: {inside}), lambda v: (exp(v) - 1) * 100)), 2), {otherwise}) AS {name}_move"


_T = "ln(1 + threshold_pct / 100)"
_SCENARIO_SQL = ", ".join([
    _moves_sql("bull", f"v > {_T}", "threshold_pct * 1.5"), _moves_sql("base", f"v <= {_T} AND v >= -{_T}", "0"), _moves_sql("bear", f"v < -{_T}", "threshold_pct * -1.5"),
])


@query(f"WITH {_PRIOR_SQL} SELECT symbol, n, round(p_up, 6) AS p_up, round(vol_pct, 6) AS vol_pct, round(normal_vol_pct, 6) AS normal_vol_pct, round(threshold_pct, 6) AS threshold_pct, list_transform(quantiles, lambda v: round(v, 8)) AS quantiles FROM p")
def f27_prior_distribution(spark, sf_dir):
    p = history_prior(hourly(spark, sf_dir))
    return p.select("symbol", "n", *[r6(c, F.col(c)) for c in ("p_up", "vol_pct", "normal_vol_pct", "threshold_pct")], F.transform("quantiles", lambda v: F.round(v, 8)).alias("quantiles"))


@query(f"WITH {_PRIOR_SQL}, g AS (SELECT symbol, threshold_pct, {_grid_sql('quantiles')} AS g FROM p) SELECT symbol, {_SCENARIO_SQL} FROM g")
def f26_prior_scenarios(spark, sf_dir):
    p = history_prior(hourly(spark, sf_dir))
    return p.select("symbol", scenarios(grid(F.col("quantiles")), F.col("threshold_pct")).alias("s")).select("symbol", "s.*")


@query(f"""WITH {_PRIOR_SQL}, g AS (SELECT symbol, threshold_pct, {_grid_sql('quantiles')} AS g FROM p), a(shift, scale) AS (VALUES (0.3::DOUBLE, 1.2::DOUBLE), (0.9, 2.0), (-0.2, 0.0)),
m AS (SELECT symbol, threshold_pct, shift, scale, list_transform(g, lambda v: g[100] + least(greatest(CASE WHEN scale = 0 THEN 1 ELSE scale END, 0.7), 1.6) * (v - g[100]) + least(greatest(shift, -0.5), 0.5) * list_stddev_samp(g)) AS m FROM g, a),
q AS (SELECT *, list_transform(range(1, 20), lambda k: exp(m[10 * k]) - 1) AS quantiles FROM m), h AS (SELECT *, {_grid_sql('quantiles')} AS g FROM q)
SELECT symbol, shift, scale, round(len(list_filter(m, lambda v: v > 0)) / 199.0::DOUBLE, 4) AS p_up, list_transform(quantiles, lambda v: round(v, 8)) AS quantiles, {_SCENARIO_SQL} FROM h""")
def f26_adjusted_prior(spark, sf_dir):
    """Three adjustments of each symbol's prior: within the bounds, beyond them, and with no scale."""
    asked = F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(c).alias("scale")) for s, c in ((0.3, 1.2), (0.9, 2.0), (-0.2, 0.0))])
    p = history_prior(hourly(spark, sf_dir)).select("symbol", "threshold_pct", grid(F.col("quantiles")).alias("g"), F.inline(asked))
    p = p.withColumn("m", moved(F.col("g"), F.col("shift"), F.col("scale")))
    p = p.withColumn("quantiles", F.transform(F.sequence(F.lit(9), F.lit(189), F.lit(10)), lambda i: F.expm1(F.get("m", i))))
    p = p.withColumn("s", scenarios(grid(F.col("quantiles")), F.col("threshold_pct")))
    up = F.round(F.size(F.filter("m", lambda v: v > 0)) / POINTS, 4)
    return p.select("symbol", "shift", "scale", up.alias("p_up"), F.transform("quantiles", lambda v: F.round(v, 8)).alias("quantiles"), "s.*")


# What past sessions say


def shrunk(mean: Column, t: Column) -> Column:
    """In full at a t of 3, nothing at or under 0."""
    return mean * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t / 3))


_ROWS_SQL = _IC_SQL.split(", ic AS")[0].rsplit("\nic AS", 1)[0].rstrip(",")


@query(f"""WITH {_ROWS_SQL}, s AS (SELECT t, regr_slope(y, f1) AS slope FROM r GROUP BY t), d AS (SELECT t, slope, slope - avg(slope) OVER () AS d FROM s WHERE isfinite(slope)), l AS (SELECT *, d * lag(d) OVER (ORDER BY t) AS d1 FROM d),
m AS (SELECT avg(slope) AS mean, avg(slope) / sqrt((sum(d * d) + coalesce(sum(d1), 0)) / count(*) / count(*)) AS t, count(*) AS n FROM l)
SELECT round(mean, 8) AS mean, round(t, 6) AS t, n, CASE WHEN n >= 20 THEN round(mean * greatest(0, least(1, t / 3)), 8) END AS slope FROM m""")
def f20_shrunk_slope(spark, sf_dir):
    """Each session's slope of the return on the rank of a score, averaged over at least 20, shrunk by its robust t."""
    s = learning_rows(spark, sf_dir).groupBy("t").agg(F.regr_slope("y", "f1").alias("slope")).where("slope IS NOT NULL AND NOT isnan(slope)")
    m = newey_west(s, "slope", "t", 1)
    slope = F.when(F.col("n") >= 20, F.round(shrunk(F.col("mean"), F.col("t")), 8))
    return m.select(F.round("mean", 8).alias("mean"), r6("t", F.col("t")), "n", slope.alias("slope"))


BLENDS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(f"""WITH {HOURLY_SQL}, v AS (SELECT symbol, ts, greatest(pow(ln(high / low), 2) / (4 * ln(2::DOUBLE)), 1e-6) AS v FROM bars),
h AS (SELECT v, count(*) OVER w AS n, avg(v) OVER w AS slow, avg(v) OVER f AS fast FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
x AS (SELECT w.w, v / (w.w * slow + (1 - w.w) * fast) AS q FROM h, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) AS w(w) WHERE n = 20), l AS (SELECT w, avg(q - ln(q) - 1) AS loss, count(*) AS n FROM x GROUP BY w)
SELECT CASE WHEN max(n) > 2000 THEN arg_min(w, loss) ELSE 0.5 END::DOUBLE AS weight, round(min(loss), 6) AS loss, max(n) AS n FROM l""")
def f20_blend_weight(spark, sf_dir):
    """The weight of a slow against a fast variance forecast with the least loss; a half with 2,000 forecasts or fewer."""
    v = F.greatest(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0))), F.lit(1e-6))
    w = lambda n: series().rowsBetween(-n, -1)
    x = hourly(spark, sf_dir).withColumn("v", v).select("v", F.count("*").over(w(20)).alias("n"), F.avg("v").over(w(20)).alias("slow"), F.avg("v").over(w(5)).alias("fast")).where("n = 20")
    loss = lambda a: (lambda q: q - F.ln(q) - 1)(F.col("v") / (a * F.col("slow") + (1 - a) * F.col("fast")))
    one = x.agg(F.array(*[F.struct(F.avg(loss(a)).alias("loss"), F.lit(a).alias("weight")) for a in BLENDS]).alias("all"), F.count("*").alias("n"))
    best = F.array_min("all")
    return one.select(F.when(F.col("n") > 2000, best["weight"]).otherwise(0.5).alias("weight"), r6("loss", best["loss"]), "n")


_LOSS_SQL = f"""{HOURLY_SQL}, v AS (SELECT symbol, ts, greatest(pow(ln(high / low), 2) / (4 * ln(2::DOUBLE)), 1e-6) AS v FROM bars),
h AS (SELECT ts, count(*) OVER w AS n, v / avg(v) OVER w AS slow, v / avg(v) OVER f AS fast FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {_LOSS_SQL}, s AS (SELECT CAST(ts AS DATE) AS day, avg(slow - ln(slow) - fast + ln(fast)) AS x FROM h WHERE n = 20 GROUP BY 1), d AS (SELECT day, x, x - avg(x) OVER () AS d FROM s), l AS (SELECT *, d * lag(d) OVER (ORDER BY day) AS d1 FROM d)
SELECT round(avg(x), 6) AS mean, round(avg(x) / sqrt((sum(d * d) + coalesce(sum(d1), 0)) / count(*) / count(*)), 6) AS t, count(*) AS n FROM l""")
def f22_diebold_mariano(spark, sf_dir):
    """Whether a slow variance forecast loses more than a fast one: the robust t of each day's mean difference of losses."""
    v = F.greatest(F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * F.ln(F.lit(2.0))), F.lit(1e-6))
    past = lambda n: F.col("v") / F.avg("v").over(series().rowsBetween(-n, -1))
    x = hourly(spark, sf_dir).withColumn("v", v).select("ts", F.count("*").over(series().rowsBetween(-20, -1)).alias("n"), past(20).alias("slow"), past(5).alias("fast")).where("n = 20")
    loss = F.col("slow") - F.ln("slow") - F.col("fast") + F.ln("fast")
    m = newey_west(x.groupBy(F.to_date("ts").alias("day")).agg(F.avg(loss).alias("x")), "x", "day", 1)
    return m.select(r6("mean", F.col("mean")), r6("t", F.col("t")), "n")


_BANDS = {50: (0.25, 0.75), 80: (0.1, 0.9), 90: (0.05, 0.95)}


@query(f"""WITH {_ENS_SQL}, q AS (SELECT symbol, day, y, {", ".join(f"quantile_cont(v, {a}) AS lo{k}, quantile_cont(v, {b}) AS hi{k}" for k, (a, b) in _BANDS.items())}, avg(CASE WHEN v > 50 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM (SELECT symbol, day, y, unnest(x) AS v FROM e WHERE y IS NOT NULL) GROUP BY 1, 2, 3)
SELECT symbol, {", ".join(f"round(avg(CASE WHEN y BETWEEN lo{k} AND hi{k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_{k}" for k in _BANDS)}, round(avg(pow(p - CASE WHEN y > 50 THEN 1 ELSE 0 END, 2)), 6) AS brier, count(*) AS n FROM q GROUP BY symbol""")
def f22_interval_scores(spark, sf_dir):
    """How often the next day's last close lies in today's 50, 80 and 90 percent bands, and the Brier score of its being over 50."""
    v = _ensembles(spark, sf_dir).select("symbol", "day", "y", F.explode("x").alias("v"))
    levels = [p for band in _BANDS.values() for p in band]
    q = v.groupBy("symbol", "day", "y").agg(F.percentile("v", levels).alias("q"), F.avg((F.col("v") > 50).cast("double")).alias("p"))
    inside = [r6(f"coverage_{k}", F.avg(F.col("y").between(F.get("q", F.lit(2 * i)), F.get("q", F.lit(2 * i + 1))).cast("double"))) for i, k in enumerate(_BANDS)]
    brier = F.avg(F.pow(F.col("p") - (F.col("y") > 50).cast("double"), 2))
    return q.groupBy("symbol").agg(*inside, r6("brier", brier), F.count("*").alias("n"))
