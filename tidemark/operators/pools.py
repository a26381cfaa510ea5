"""What forecasts draw from and how they are set right: residuals, standardised shocks (F15), report jumps that fall back to a
sector (F16), and a map from forecast percentiles to those that held (F20).

Rows are (symbol, t, r, m, report): log returns of a symbol and of the market at a session, and whether the symbol reported.
Everything runs in windows of one symbol; what sectors share is their newest jumps, of which a bounded number is kept in each
partition before they meet. A session without return has no shock; a symbol with too few has no pool; nulls in ``report``
count as no report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forecast import _PANEL_SQL, crps, panel
from tidemark.operators.indicators import r6
from tidemark.registry import query, table

CLAMP = 0.223


def _by(rows: tuple[int, int] | None = None):
    w = Window.partitionBy("symbol").orderBy("t")
    return w.rowsBetween(*rows) if rows else w


def residuals(rows: DataFrame, window: int = 252, least: int = 60) -> DataFrame:
    """``rows`` with age (sessions since the symbol's first), beta and idio. Beta is the slope of r on m over ``window``
    sessions without reports, drawn to 1 by a third, and 1 where no more than ``least`` are there; idio is r less the beta of
    the session before times m, cut at 0.223 either way but for reports."""
    x = rows.withColumn("report", F.coalesce("report", F.lit(False)))
    used = F.col("r").isNotNull() & F.col("m").isNotNull() & ~F.col("report")
    mean = lambda c: F.avg(F.when(used, c)).over(_by((1 - window, 0)))
    r, m = F.col("r"), F.col("m")
    x = x.withColumns({
        "age": F.row_number().over(_by()) - 1, "n": F.count(F.when(used, 1)).over(_by((1 - window, 0))),
        "cov": mean(r * m) - mean(r) * mean(m), "var": mean(m * m) - mean(m) * mean(m),
    })
    x = x.withColumn("beta", F.when((F.col("n") > least) & (F.col("var") > 0), 0.67 * F.try_divide("cov", "var") + 0.33).otherwise(1.0))
    raw = r - F.coalesce(F.lag("beta").over(_by()), F.lit(1.0)) * m
    idio = F.when(F.col("report") | raw.isNull(), raw).otherwise(F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), raw)))
    return x.withColumn("idio", idio).drop("n", "cov", "var")


def spread_before(value: str, n: int, skip: Column | None = None) -> Column:
    """Root of the mean square of the ``n`` sessions before."""
    sq = F.col(value) * F.col(value)
    return F.sqrt(F.avg(sq if skip is None else F.when(~skip, sq)).over(_by((-n, -1))))


def standardised_pool(rows: DataFrame, value: str, span: int, back: int = 22, least: int = 1, skip: Column | None = None) -> DataFrame:
    """(symbol, t, raw, z): each value of a symbol's newest ``span`` sessions over its spread of the ``back`` sessions before,
    then centred and scaled to 1; sessions of ``skip`` are left out of both, symbols with under ``least`` of all."""
    whole = Window.partitionBy("symbol")
    x = rows.withColumns({"raw": F.try_divide(F.col(value), spread_before(value, back, skip)), "last": F.max("t").over(whole), "nth": F.row_number().over(_by()) - 1})
    x = x.where((F.col("nth") > back) & (F.col("t") > F.col("last") - span) & F.col("raw").isNotNull())
    x = x if skip is None else x.where(~skip)
    x = x.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= least)
    return x.select("symbol", "t", "raw", F.coalesce(F.try_divide(F.col("raw") - F.avg("raw").over(whole), F.stddev_samp("raw").over(whole)), F.lit(0.0)).alias("z"))


def report_jumps(rows: DataFrame, year: int = 252, settled: int = 61, own: int = 8, newest: int = 24, shared: int = 200, least: int = 4) -> DataFrame:
    """(symbol, origin, jumps): a symbol's residuals at its newest ``newest`` reports if it had ``own`` of them; else those of
    its sector's newest ``shared`` reports, each over the reporting symbol's spread of the ``year`` before (reports within
    ``settled`` sessions of a symbol's first are left out), times this symbol's spread now. Centred; under ``least``: none.
    Takes residuals with a column sector; a symbol without sector has only its own."""
    calm = ~F.col("report")
    latest = Window.partitionBy("symbol").orderBy(F.desc("t"))
    x = rows.withColumns({"before": spread_before("idio", year, ~calm), "now": F.sqrt(F.avg(F.when(calm, F.col("idio") * F.col("idio"))).over(_by((1 - year, 0))))})
    reports = x.where(F.col("report") & (F.col("age") > 1) & F.col("idio").isNotNull())
    mine = reports.select("symbol", "t", "idio").withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= newest)
    mine = mine.groupBy("symbol").agg(F.count("*").alias("n"), F.collect_list("idio").alias("own"))
    pool = x.where(F.col("report") & (F.col("age") > settled) & (F.col("before") > 0) & F.col("idio").isNotNull() & F.col("sector").isNotNull())
    pool = pool.select("sector", (F.col("idio") / F.col("before")).alias("z"), F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("t"), "symbol")).alias("nth"))
    pool = pool.where(F.col("nth") <= shared).groupBy("sector").agg(F.collect_list("z").alias("shared"))
    ends = x.groupBy("symbol").agg(F.max_by(F.struct("sector", "now"), "t").alias("e")).select("symbol", "e.sector", "e.now")
    j = ends.join(mine, "symbol", "left").join(F.broadcast(pool), "sector", "left")  # one row a sector
    enough = F.coalesce(F.col("n") >= own, F.lit(False))
    j = j.select("symbol", F.when(enough, "own").otherwise("sector").alias("origin"), F.when(enough, F.col("own")).when(F.col("now") > 0, F.transform("shared", lambda z: z * F.col("now"))).alias("raw"))
    mean = F.aggregate("raw", F.lit(0.0), lambda s, v: s + v) / F.size("raw")  # once a symbol, not for each of its jumps
    return j.where(F.size("raw") >= least).select("symbol", "origin", F.zip_with("raw", F.array_repeat(mean, F.size("raw")), lambda v, m: v - m).alias("jumps"))


# Percentiles


def split_pit(draws: Column, y: Column) -> Column:
    """Where an outcome fell among the draws, ties half, never 0 or 1."""
    low, same = F.size(F.filter(draws, lambda v: v < y)), F.size(F.filter(draws, lambda v: v == y))
    return (low + same / 2 + 0.5) / (F.size(draws) + 1)


def level_map(pits: DataFrame, keys: list[str], taus: list[float], least: int = 200) -> DataFrame:
    """(keys, n, levels): for each tau the percentile to read from a forecast, half-way to the one that held tau of the
    outcomes of ``pit``, from 0.001 to 0.999; tau itself where fewer than ``least`` are on record. A null key takes all."""
    g = pits.rollup(*keys).agg(F.count("pit").alias("n"), F.percentile("pit", F.array(*map(F.lit, taus))).alias("q"))
    one = lambda k, t: F.when(F.col("n") < least, F.lit(t)).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.lit(t) + 0.5 * (F.col("q")[k] - t))))
    return g.select(*keys, "n", F.array(*[one(k, t) for k, t in enumerate(taus)]).alias("levels"))


def read_at(ordered: Column, level: Column) -> Column:
    """The value at a level of an ordered array, interpolated."""
    at = level * (F.size(ordered) - 1)
    k = F.least(F.floor(at).cast("int"), F.size(ordered) - 1)
    after = F.get(ordered, F.least(k + 1, F.size(ordered) - 1))
    return F.get(ordered, k) * (1 - (at - k)) + after * (at - k)


# Queries: thirty sessions of users; a report is a day with a purchase over 30, a sector the users of a remainder

_ROWS_SQL = f"""{_PANEL_SQL}, rep AS (SELECT DISTINCT user_id AS symbol, date_trunc('day', ts) AS ts FROM events WHERE event_type = 'purchase' AND value > 30),
a AS (SELECT p.symbol, p.symbol % 8 AS sector, p.t, ln(close / lag(close) OVER (PARTITION BY p.symbol ORDER BY t)) AS r, row_number() OVER (PARTITION BY p.symbol ORDER BY t) - 1 AS age, rep.symbol IS NOT NULL AS report FROM panel p LEFT JOIN rep ON rep.symbol = p.symbol AND rep.ts = p.ts),
mk AS (SELECT t, avg(r) AS m FROM a WHERE r IS NOT NULL GROUP BY 1), x AS (SELECT a.*, m, r IS NOT NULL AND m IS NOT NULL AND NOT report AS used FROM a LEFT JOIN mk USING (t)),
c AS (SELECT *, count(*) FILTER (WHERE used) OVER w AS n, avg(r * m) FILTER (WHERE used) OVER w - avg(r) FILTER (WHERE used) OVER w * avg(m) FILTER (WHERE used) OVER w AS cov,
 avg(m * m) FILTER (WHERE used) OVER w - pow(avg(m) FILTER (WHERE used) OVER w, 2) AS var FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING)),
b AS (SELECT *, CASE WHEN n > 5 AND var > 0 THEN 0.67 * cov / var + 0.33 ELSE 1.0 END AS beta FROM c),
e AS (SELECT *, r - coalesce(lag(beta) OVER (PARTITION BY symbol ORDER BY t), 1) * m AS raw FROM b),
res AS (SELECT symbol, sector, t, age, r, m, report, beta, CASE WHEN report OR raw IS NULL THEN raw ELSE greatest(-0.223, least(0.223, raw)) END AS idio FROM e)"""


def session_rows(spark, sf_dir) -> DataFrame:
    """(symbol, sector, t, r, m, report); the market's return is the mean of a session's."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 30")
    rep = e.select(F.col("user_id").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.lit(True).alias("report")).distinct()
    x = panel(spark, sf_dir).join(rep, ["symbol", "ts"], "left")
    x = x.select("symbol", (F.col("symbol") % 8).alias("sector"), "t", F.ln(F.col("close") / F.lag("close").over(_by())).alias("r"), F.coalesce("report", F.lit(False)).alias("report"))
    return x.join(x.where("r IS NOT NULL").groupBy("t").agg(F.avg("r").alias("m")), "t", "left")


@query(f"WITH {_ROWS_SQL} SELECT symbol, t, report, round(beta, 6) AS beta, round(idio, 6) AS idio FROM res WHERE idio IS NOT NULL")
def w16_w17_off_report(spark, sf_dir):
    """Betas without report days, and residuals that are cut but on report days."""
    return residuals(session_rows(spark, sf_dir), 10, 5).where("idio IS NOT NULL").select("symbol", "t", "report", r6("beta", F.col("beta")), r6("idio", F.col("idio")))


@query(f"""WITH {_ROWS_SQL}, s AS (SELECT symbol, t, age, report, idio / nullif(sqrt(avg(idio * idio) FILTER (WHERE NOT report) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), 0) AS raw FROM res
 UNION ALL SELECT NULL, t, row_number() OVER (ORDER BY t) - 1, false, m / nullif(sqrt(avg(m * m) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), 0) FROM mk),
k AS (SELECT symbol, raw FROM s WHERE age > 5 AND NOT report AND raw IS NOT NULL), st AS (SELECT *, count(*) OVER w AS n, (raw - avg(raw) OVER w) / stddev_samp(raw) OVER w AS z FROM k WINDOW w AS (PARTITION BY symbol))
SELECT symbol, count(*) AS shocks, round(stddev_samp(raw), 6) AS spread, round(quantile_cont(z, 0.05), 6) AS low, round(quantile_cont(z, 0.95), 6) AS high FROM st WHERE n >= CASE WHEN symbol IS NULL THEN 1 ELSE 10 END GROUP BY symbol""")
def f15_standardised_pools(spark, sf_dir):
    """Each symbol's pool of shocks without reports, and the market's (symbol null), which has one row a session."""
    x = session_rows(spark, sf_dir)
    stock = standardised_pool(residuals(x, 10, 5), "idio", 504, 5, 10, F.col("report"))
    bench = standardised_pool(x.where("m IS NOT NULL").groupBy("t").agg(F.first("m").alias("m")).withColumn("symbol", F.lit(None).cast("long")), "m", 756, 5)
    return stock.unionByName(bench).groupBy("symbol").agg(F.count("*").alias("shocks"), r6("spread", F.stddev_samp("raw")), r6("low", F.percentile("z", 0.05)), r6("high", F.percentile("z", 0.95)))


@query(f"""WITH {_ROWS_SQL}, v AS (SELECT *, sqrt(avg(idio * idio) FILTER (WHERE NOT report) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS before,
 sqrt(avg(idio * idio) FILTER (WHERE NOT report) OVER (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING)) AS now FROM res),
o AS (SELECT symbol, idio, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS nth, count(*) OVER (PARTITION BY symbol) AS n FROM v WHERE report AND age > 1 AND idio IS NOT NULL),
p AS (SELECT sector, idio / before AS z, row_number() OVER (PARTITION BY sector ORDER BY t DESC, symbol) AS nth FROM v WHERE report AND age > 5 AND before > 0 AND idio IS NOT NULL),
f AS (SELECT symbol, arg_max(sector, t) AS sector, max(t) AS t FROM v GROUP BY 1), l AS (SELECT f.symbol, f.sector, v.now FROM f JOIN v ON v.symbol = f.symbol AND v.t = f.t),
j AS (SELECT symbol, 'own' AS origin, idio AS jump FROM o WHERE n >= 8 AND nth <= 24 UNION ALL
 SELECT l.symbol, 'sector', p.z * l.now FROM l JOIN p ON p.sector = l.sector AND p.nth <= 200 WHERE l.now > 0 AND l.symbol NOT IN (SELECT symbol FROM o WHERE n >= 8))
SELECT symbol, origin, count(*) AS n, round(stddev_samp(jump), 6) AS spread, round(max(jump) - avg(jump), 6) AS largest, round(min(jump) - avg(jump), 6) AS least FROM j GROUP BY 1, 2 HAVING count(*) >= 4""")
def f16_jump_pools(spark, sf_dir):
    """Jumps at reports: own ones, or the sector's in units of this symbol's spread."""
    j = report_jumps(residuals(session_rows(spark, sf_dir), 10, 5), 10, 5).select("symbol", "origin", F.explode("jumps").alias("jump"))
    return j.groupBy("symbol", "origin").agg(F.count("*").alias("n"), r6("spread", F.stddev_samp("jump")), r6("largest", F.max("jump")), r6("least", F.min("jump")))


_BANDS = [0.05, 0.1, 0.25, 0.75, 0.9, 0.95]
_SERVED = [(k + 0.5) / 10 for k in range(10)]
_LEVEL_SQL = lambda k, t: f"CASE WHEN n < 200 THEN {t} ELSE greatest(0.001, least(0.999, {t} + 0.5 * (q[{k + 1}] - {t}))) END"
_CRPS_SQL = lambda x: f"(list_avg(list_transform({x}, lambda v: abs(v - y))) - list_avg(flatten(list_transform({x}, lambda v: list_transform({x}, lambda u: abs(u - v))))) / 2)"


@query(f"""WITH {_PANEL_SQL}, d AS (SELECT symbol, symbol % 8 AS sector, t, list_sort(list(close) OVER w) AS x, lead(close) OVER (PARTITION BY symbol ORDER BY t) AS y, (SELECT max(t) * 2 // 3 FROM panel) AS cut FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING)),
e AS (SELECT *, (len(list_filter(x, lambda v: v < y)) + len(list_filter(x, lambda v: v = y)) / 2 + 0.5::DOUBLE) / (len(x) + 1) AS pit FROM d WHERE len(x) = 10 AND y IS NOT NULL),
qs AS (SELECT sector, count(*) AS n, quantile_cont(pit, {_BANDS + _SERVED}) AS q FROM e WHERE t + 1 < cut GROUP BY ROLLUP (sector)),
m AS (SELECT sector, n, [{", ".join(_LEVEL_SQL(k, t) for k, t in enumerate(_BANDS + _SERVED))}] AS l FROM qs),
z AS (SELECT m.sector, n, l, pit, x, y, list_transform(l[7:], lambda u: x[least(floor(u * 9)::INT, 9) + 1] * (1 - (u * 9 - least(floor(u * 9)::INT, 9))) + x[least(floor(u * 9)::INT + 1, 9) + 1] * (u * 9 - least(floor(u * 9)::INT, 9))) AS s FROM e JOIN m ON m.sector = e.sector OR m.sector IS NULL WHERE t >= cut)
SELECT sector, any_value(n) AS fitted, count(*) AS tested, round(any_value(l[1]), 6) AS low, round(any_value(l[6]), 6) AS high, {", ".join(f"round(avg(CASE WHEN pit BETWEEN {a} AND {b} THEN 1.0 ELSE 0.0 END), 6) AS raw{n}, round(avg(CASE WHEN pit BETWEEN l[{i}] AND l[{j}] THEN 1.0 ELSE 0.0 END), 6) AS mapped{n}" for n, a, b, i, j in [(50, 0.25, 0.75, 3, 4), (80, 0.1, 0.9, 2, 5), (90, 0.05, 0.95, 1, 6)])},
 round(avg({_CRPS_SQL("x")}), 9) AS crps_raw, round(avg({_CRPS_SQL("s")}), 9) AS crps_mapped FROM z GROUP BY sector""")
def f20_percentile_map(spark, sf_dir):
    """Forecasts are a symbol's last ten closes. Percentiles of the first two thirds of the sessions map those of the rest, by
    sector where it has 200 on record, and for all (sector null): coverage and score before and after."""
    w, p = _by((-9, 0)), panel(spark, sf_dir)
    d = p.select("symbol", (F.col("symbol") % 8).alias("sector"), "t", F.array_sort(F.collect_list("close").over(w)).alias("x"), F.lead("close").over(_by()).alias("y"))
    cut = p.agg(F.floor(F.max("t") * 2 / 3).alias("cut"))  # one row
    e = d.where((F.size("x") == 10) & F.col("y").isNotNull()).withColumn("pit", split_pit(F.col("x"), F.col("y"))).join(F.broadcast(cut))
    maps = level_map(e.where("t + 1 < cut"), ["sector"], _BANDS + _SERVED)
    late = e.where("t >= cut").select(F.explode(F.array("sector", F.lit(None).cast("long"))).alias("sector"), "pit", "x", "y")
    z = late.join(maps, late["sector"].eqNullSafe(maps["sector"])).drop(maps["sector"])
    z = z.withColumn("s", F.transform(F.slice("levels", 7, 10), lambda u: read_at(F.col("x"), u)))
    held = lambda a, b: F.avg(F.col("pit").between(a, b).cast("double"))
    level = lambda k: F.col("levels")[k]
    bands = [(50, 2, 3), (80, 1, 4), (90, 0, 5)]
    return z.groupBy("sector").agg(
        F.any_value("n").alias("fitted"), F.count("*").alias("tested"), r6("low", F.any_value(level(0))), r6("high", F.any_value(level(5))),
        *[r6(f"raw{n}", held(_BANDS[i], _BANDS[j])) for n, i, j in bands], *[r6(f"mapped{n}", held(level(i), level(j))) for n, i, j in bands],
        F.round(F.avg(crps(F.col("x"), F.col("y"))), 9).alias("crps_raw"), F.round(F.avg(crps(F.col("s"), F.col("y"))), 9).alias("crps_mapped"),
    )
