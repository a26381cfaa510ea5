"""Scans, screens, event studies and performance over bars."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import all_of
from tidemark.operators.indicators import r6, series
from tidemark.registry import query, table
from tidemark.sources.bars import DAILY_SQL, HOURLY_SQL, MARKET_SQL, USERS_SQL, daily, hourly, market, users_daily


def _newest_first():
    return Window.partitionBy("symbol").orderBy(F.desc("ts"))


def robust_z(rows: DataFrame, name: str, x: str, today: str) -> DataFrame:
    """(symbol, name): the distance of ``today`` from the median of ``x``, in units of 1.4826 times the median distance
    from it. Two aggregations, as the second needs the first."""
    mid = rows.groupBy("symbol").agg(F.median(x).alias("mid"))
    spread = rows.join(mid, "symbol").groupBy("symbol", "mid").agg((F.median(F.abs(F.col(x) - F.col("mid"))) * 1.4826).alias("mad"), F.max(today).alias("now"))
    return spread.select("symbol", F.when(F.col("mad") > 0, (F.col("now") - F.col("mid")) / F.col("mad")).alias(name))


def scan(bars: DataFrame, least: int = 25) -> DataFrame:
    """One row of metrics for each symbol with enough bars: returns, gap, robust scores of return and volume, and place in
    the range of the last 252 closes."""
    b = bars.withColumn("nth", F.row_number().over(_newest_first())).withColumn("before", F.lag("close").over(series())).withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("n") >= least)
    b = b.withColumn("ret", (F.col("close") / F.col("before") - 1) * 100).withColumn("lv", F.when(F.col("volume") > 0, F.ln("volume")))
    at = lambda k, c: F.max(F.when(F.col("nth") == k, F.col(c)))
    year = F.when(F.col("nth") <= 252, F.col("close"))
    base = b.groupBy("symbol").agg(
        at(1, "close").alias("close_price"), at(1, "ret").alias("return_1d"), ((at(1, "close") / at(6, "close") - 1) * 100).alias("return_5d"), at(1, "volume").alias("volume"),
        ((at(1, "open") / at(1, "before") - 1) * 100).alias("gap_percent"), ((at(1, "close") / F.max(year) - 1) * 100).alias("pct_from_52w_high"), ((at(1, "close") / F.min(year) - 1) * 100).alias("pct_from_52w_low"), F.max("n").alias("bars"),
        F.median(F.when(F.col("nth").between(2, 61), F.col("volume"))).alias("usual"))
    now = b.withColumn("ret_now", F.when(F.col("nth") == 1, F.col("ret"))).withColumn("lv_now", F.max(F.when(F.col("nth") == 1, F.col("lv"))).over(Window.partitionBy("symbol")))
    rz = robust_z(now.where("nth <= 60 AND ret IS NOT NULL"), "return_z", "ret", "ret_now")
    vz = robust_z(now.where("nth BETWEEN 2 AND 61 AND lv IS NOT NULL"), "volume_z", "lv", "lv_now")
    out = base.join(rz, "symbol", "left").join(vz, "symbol", "left").withColumn("volume_ratio", F.try_divide("volume", "usual"))
    return out.drop("usual")


def signals() -> Column:
    """Names of what is unusual about a row of metrics."""
    c = F.col
    rules = [("volume_spike", (c("volume_z") >= 3) & (c("volume_ratio") >= 2)), ("big_move", F.abs("return_z") >= 3), ("gap_up", c("gap_percent") >= 3), ("gap_down", c("gap_percent") <= -3), ("year_high", c("pct_from_52w_high") >= -0.5), ("year_low", c("pct_from_52w_low") <= 0.5)]
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))


def score() -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    bonus = F.when(F.array_contains("signals", "year_high") | F.array_contains("signals", "year_low"), 0.5).otherwise(0.0)
    return 1.5 * F.greatest(zero(F.col("volume_z")), F.lit(0.0)) + F.abs(zero(F.col("return_z"))) + F.abs(zero(F.col("gap_percent"))) / 3 + bonus


_SCAN_SQL = f"""{USERS_SQL}, b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
b AS (SELECT *, (close / before - 1) * 100 AS ret, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM b0 WHERE n >= 15),
base AS (SELECT symbol, max(close) FILTER (WHERE nth = 1) AS close_price, max(ret) FILTER (WHERE nth = 1) AS return_1d, max(volume) FILTER (WHERE nth = 1) AS volume, (max(open) FILTER (WHERE nth = 1) / max(before) FILTER (WHERE nth = 1) - 1) * 100 AS gap_percent,
  (max(close) FILTER (WHERE nth = 1) / max(close) - 1) * 100 AS pct_from_52w_high, (max(close) FILTER (WHERE nth = 1) / min(close) - 1) * 100 AS pct_from_52w_low, median(volume) FILTER (WHERE nth BETWEEN 2 AND 61) AS usual FROM b GROUP BY symbol),
rm AS (SELECT symbol, median(ret) AS mid FROM b WHERE nth <= 60 AND ret IS NOT NULL GROUP BY 1), rs AS (SELECT b.symbol, mid, median(abs(ret - mid)) * 1.4826 AS mad, max(ret) FILTER (WHERE nth = 1) AS now FROM b JOIN rm USING (symbol) WHERE nth <= 60 AND ret IS NOT NULL GROUP BY 1, 2),
vm AS (SELECT symbol, median(lv) AS mid FROM b WHERE nth BETWEEN 2 AND 61 AND lv IS NOT NULL GROUP BY 1), vn AS (SELECT symbol, max(lv) AS now FROM b WHERE nth = 1 GROUP BY 1),
vs AS (SELECT b.symbol, mid, median(abs(lv - mid)) * 1.4826 AS mad FROM b JOIN vm USING (symbol) WHERE nth BETWEEN 2 AND 61 AND lv IS NOT NULL GROUP BY 1, 2),
m AS (SELECT base.*, CASE WHEN rs.mad > 0 THEN (rs.now - rs.mid) / rs.mad END AS return_z, CASE WHEN vs.mad > 0 THEN (vn.now - vs.mid) / vs.mad END AS volume_z, volume / nullif(usual, 0) AS volume_ratio
  FROM base LEFT JOIN rs USING (symbol) LEFT JOIN vs USING (symbol) LEFT JOIN vn USING (symbol)),
sig AS (SELECT *, list_filter([CASE WHEN volume_z >= 3 AND volume_ratio >= 2 THEN 'volume_spike' END, CASE WHEN abs(return_z) >= 3 THEN 'big_move' END, CASE WHEN gap_percent >= 3 THEN 'gap_up' END, CASE WHEN gap_percent <= -3 THEN 'gap_down' END,
  CASE WHEN pct_from_52w_high >= -0.5 THEN 'year_high' END, CASE WHEN pct_from_52w_low <= 0.5 THEN 'year_low' END], lambda s: s IS NOT NULL) AS signals FROM m),
scored AS (SELECT *, 1.5 * greatest(coalesce(volume_z, 0), 0) + abs(coalesce(return_z, 0)) + abs(coalesce(gap_percent, 0)) / 3 + CASE WHEN list_contains(signals, 'year_high') OR list_contains(signals, 'year_low') THEN 0.5 ELSE 0 END AS score FROM sig)"""


def _scored(spark, sf_dir) -> DataFrame:
    return scan(users_daily(spark, sf_dir), 15).withColumn("signals", signals()).withColumn("score", score())


_SWEEPS: dict[tuple, str] = {}


def sweep(spark, sf_dir: str, anew: bool = False) -> DataFrame:
    """The session's stored scan of ``sf_dir``: swept once for each state of its files (or ``anew``), written to the shared
    folder, and read by every screen and list after."""
    from tidemark.streaming.stream import place

    files = table(spark, sf_dir, "events").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = (spark.sparkContext.applicationId, sf_dir, *files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time")).first())
    if anew or key not in _SWEEPS:
        path = place(spark, None).replace("stream-", "sweep-")
        _scored(spark, sf_dir).write.parquet(path)
        _SWEEPS[key] = path
    return spark.read.parquet(_SWEEPS[key])


@query(f"WITH {_SCAN_SQL} SELECT symbol, close_price, round(return_1d, 4) AS return_1d, round(return_z, 4) AS return_z, round(volume_z, 4) AS volume_z, round(volume_ratio, 4) AS volume_ratio, round(gap_percent, 4) AS gap_percent FROM scored")
def a11_scan_metrics(spark, sf_dir):
    four = lambda c: F.round(c, 4).alias(c)
    return _scored(spark, sf_dir).select("symbol", "close_price", *map(four, ("return_1d", "return_z", "volume_z", "volume_ratio", "gap_percent")))


@query(f"WITH {_SCAN_SQL} SELECT symbol, signals, round(score, 4) AS score FROM scored WHERE len(signals) > 0")
def a12_signals(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.size("signals") > 0).select("symbol", "signals", F.round("score", 4).alias("score"))


@query(f"WITH {_SCAN_SQL}, f AS (SELECT symbol, score, signals, EXISTS (SELECT 1 FROM events e WHERE e.user_id = scored.symbol AND e.event_type = 'error' AND e.ts >= TIMESTAMP '2024-01-29') AS explained FROM scored WHERE len(signals) > 0) SELECT symbol, explained, CASE WHEN explained THEN 2.5 ELSE 0.8 + least(score * 0.25, 3.5) END > 2 AS warm FROM f ORDER BY score DESC, symbol LIMIT 40")
def a30_a31_findings(spark, sf_dir):
    """Findings by score; a note of the last hours explains one."""
    note = table(spark, sf_dir, "events").where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-29'").select(F.col("user_id").alias("symbol")).distinct().withColumn("explained", F.lit(True))
    f = sweep(spark, sf_dir).where(F.size("signals") > 0).join(note, "symbol", "left").withColumn("explained", F.coalesce("explained", F.lit(False)))
    heat = F.when(F.col("explained"), 2.5).otherwise(0.8 + F.least(F.col("score") * 0.25, F.lit(3.5)))
    return f.orderBy(F.desc("score"), "symbol").limit(40).select("symbol", "explained", (heat > 2).alias("warm"))


FIELDS = ("close_price", "return_1d", "return_5d", "return_z", "volume", "volume_ratio", "volume_z", "gap_percent", "pct_from_52w_high", "pct_from_52w_low", "bars")
_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass
class Screen:
    """A screen over the newest scan: conditions joined by all or any, a member list on top, order and limit."""

    match: str = "all"
    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    members: list | None = None
    sort_by: str = "volume_z"
    sort_desc: bool = True
    limit: int = 50

    @staticmethod
    def parse(text: str) -> Screen:
        x = json.loads(text)
        bad = [k for k in x if k not in ("match", "conditions", "members", "sort_by", "sort_desc", "limit")]
        conditions = [(c["field"], c["op"], float(c["value"])) for c in x.get("conditions", [])]
        bad += [f for f, op, _ in conditions if f not in FIELDS or op not in _OPS]
        s = Screen(x.get("match", "all"), conditions, x.get("members"), x.get("sort_by") or "volume_z", x.get("sort_desc", True), min(int(x.get("limit") or 50), 750))
        if bad or s.match not in ("all", "any") or s.sort_by not in FIELDS or len(conditions) > 12 or s.limit < 1:
            raise ValueError(f"not a screen: {bad or x}")
        return s

    def predicate(self) -> Column:
        parts = [_OPS[op](F.col(f), F.lit(v)) for f, op, v in self.conditions]
        cond = F.lit(True) if not parts else all_of(parts)
        if parts and self.match == "any":
            cond = parts[0]
            for p in parts[1:]:
                cond = cond | p
        return cond & F.col("symbol").isin(self.members) if self.members is not None else cond

    def run(self, metrics: DataFrame) -> DataFrame:
        order = F.desc_nulls_last(self.sort_by) if self.sort_desc else F.asc_nulls_last(self.sort_by)
        return metrics.where(self.predicate()).orderBy(order, "symbol").limit(self.limit)


@query(f"WITH {_SCAN_SQL} SELECT symbol, round(return_1d, 4) AS return_1d, round(volume_ratio, 4) AS volume_ratio FROM scored WHERE return_1d > 10 OR volume_ratio >= 1.5 ORDER BY close_price DESC NULLS LAST, symbol LIMIT 30")
def k2_screen(spark, sf_dir):
    s = Screen.parse('{"match": "any", "conditions": [{"field": "return_1d", "op": ">", "value": 10}, {"field": "volume_ratio", "op": ">=", "value": 1.5}], "sort_by": "close_price", "limit": 30}')
    return s.run(sweep(spark, sf_dir)).select("symbol", F.round("return_1d", 4).alias("return_1d"), F.round("volume_ratio", 4).alias("volume_ratio"))


@query(f"""WITH {HOURLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth, ln(close / lag(close) OVER w) AS lr, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS peak FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, count(*) AS bars, max(close) FILTER (WHERE nth = 1) AS c, max(close) FILTER (WHERE nth = 6) AS w, max(close) FILTER (WHERE nth = 22) AS m, max(close) FILTER (WHERE nth = 64) AS q, max(close) FILTER (WHERE nth = 127) AS h, max(close) FILTER (WHERE nth = 253) AS y,
 stddev_samp(lr) FILTER (WHERE nth <= 252) AS sd, min(close / peak - 1) FILTER (WHERE nth <= 252) AS dd, avg(volume) AS v FROM r GROUP BY 1)
SELECT symbol, bars, round(c / w - 1, 6) AS return_1w, round(c / m - 1, 6) AS return_1m, round(c / q - 1, 6) AS return_3m, round(c / h - 1, 6) AS return_6m, round(c / y - 1, 6) AS return_1y, round(sd * sqrt(252), 6) AS volatility, round(dd, 6) AS drawdown, round(v, 6) AS avg_volume FROM g WHERE bars >= 30""")
def a13_market_profile(spark, sf_dir):
    """Returns over a week, a month, a quarter, half a year and a year of bars; the year's volatility and drawdown."""
    peak = F.max("close").over(series().rowsBetween(-251, 0))
    r = hourly(spark, sf_dir).withColumn("nth", F.row_number().over(_newest_first())).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(series()))).withColumn("below", F.col("close") / peak - 1)
    at = lambda k: F.max(F.when(F.col("nth") == k, F.col("close")))
    year = lambda c: F.when(F.col("nth") <= 252, F.col(c))
    returns = [r6(f"return_{n}", at(1) / at(k) - 1) for n, k in (("1w", 6), ("1m", 22), ("3m", 64), ("6m", 127), ("1y", 253))]
    g = r.groupBy("symbol").agg(F.count("*").alias("bars"), *returns, r6("volatility", F.stddev_samp(year("lr")) * F.sqrt(F.lit(252.0))), r6("drawdown", F.min(year("below"))), r6("avg_volume", F.avg("volume")))
    return g.where("bars >= 30")


@query(f"""WITH {HOURLY_SQL}, {MARKET_SQL}, x AS (SELECT symbol, ln(close / lag(close) OVER w) AS r, ln(mclose / lag(mclose) OVER w) AS m FROM bars JOIN market USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, round(covar_pop(r, m) / var_pop(m), 6) AS beta, round(corr(r, m), 6) AS correlation, count(*) FILTER (WHERE r > m) AS ahead, count(*) FILTER (WHERE r < m) AS behind FROM x WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY 1""")
def a14_j12_beta(spark, sf_dir):
    from tidemark.operators.indicators import with_market

    x = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).where("r IS NOT NULL AND m IS NOT NULL")
    return x.groupBy("symbol").agg(r6("beta", F.covar_pop("r", "m") / F.var_pop("m")), r6("correlation", F.corr("r", "m")), F.count_if(F.col("r") > F.col("m")).alias("ahead"), F.count_if(F.col("r") < F.col("m")).alias("behind"))


@query(f"""WITH {HOURLY_SQL}, {MARKET_SQL}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER w) AS r, ln(mclose / lag(mclose) OVER w) AS m FROM bars JOIN market USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT * FROM x WHERE r IS NOT NULL AND m IS NOT NULL), f AS (SELECT symbol, regr_slope(r, m) AS b, regr_intercept(r, m) AS a FROM v GROUP BY 1), n AS (SELECT v.*, r - a - b * m AS abnormal, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM v JOIN f USING (symbol))
SELECT symbol, round(sum(abnormal) FILTER (WHERE nth <= 5), 6) AS abnormal_5, round(sum(abnormal) FILTER (WHERE nth <= 20), 6) AS abnormal_20, round(sum(r - m) FILTER (WHERE nth <= 5), 6) AS excess_5, round(sum(r - m) FILTER (WHERE nth <= 20), 6) AS excess_20, round(sum(r - m) FILTER (WHERE nth <= 60), 6) AS excess_60 FROM n GROUP BY 1""")
def a14_abnormal_returns(spark, sf_dir):
    """What the market model leaves of the newest bars, and excess over the market by horizon."""
    from tidemark.operators.indicators import with_market

    v = with_market(hourly(spark, sf_dir), market(spark, sf_dir)).where("r IS NOT NULL AND m IS NOT NULL").select("symbol", "ts", "r", "m")
    f = v.groupBy("symbol").agg(F.regr_slope("r", "m").alias("b"), F.regr_intercept("r", "m").alias("a"))
    n = v.join(f, "symbol").withColumn("abnormal", F.col("r") - F.col("a") - F.col("b") * F.col("m")).withColumn("nth", F.row_number().over(_newest_first()))
    newest = lambda x, k: F.sum(F.when(F.col("nth") <= k, x))
    excess = F.col("r") - F.col("m")
    return n.groupBy("symbol").agg(*[r6(f"abnormal_{k}", newest(F.col("abnormal"), k)) for k in (5, 20)], *[r6(f"excess_{k}", newest(excess, k)) for k in (5, 20, 60)])


def event_bars(events: DataFrame, bars: DataFrame, h: int) -> DataFrame:
    """Each event (event_id, symbol, at) with the bar that first closes after it: the close before, the entry, and the exit
    ``h`` bars on. Bars are hours and close at their end; a join on the day of the bar's span replaces the range join."""
    b = bars.select("symbol", "ts", "close", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("closes"), F.lag("close").over(series()).alias("pre"), F.lead("close", h).over(series()).alias("exit"))
    b = b.withColumn("opens", F.lag("closes").over(series())).where("opens IS NOT NULL")
    day = F.explode(F.sequence(F.to_date("opens"), F.to_date("closes")))
    hit = events.withColumn("day", F.to_date("at")).join(b.withColumn("day", day), ["symbol", "day"]).where("opens <= at AND at < closes")
    return hit.select("event_id", "symbol", "ts", "pre", F.col("close").alias("entry"), "exit")


_STUDY_SQL = f"""{HOURLY_SQL}, b0 AS (SELECT symbol, ts, close, ts + INTERVAL 1 HOUR AS closes, lag(close) OVER w AS pre, lead(close, 5) OVER w AS exit FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b AS (SELECT *, lag(closes) OVER (PARTITION BY symbol ORDER BY ts) AS opens FROM b0), e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'view' ELSE 'click' END AS symbol, event_type AS kind, ts AS happened FROM events WHERE event_type IN ('error', 'purchase')),
s AS (SELECT e.event_id, e.kind, e.symbol, b.ts, pre, close AS entry, exit FROM e JOIN b ON b.symbol = e.symbol AND opens <= happened AND happened < closes)"""


def _study(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    kind = e.select("event_id", F.col("event_type").alias("kind"))
    symbol = F.when(F.col("event_type") == "error", "view").otherwise("click")
    return event_bars(e.select("event_id", symbol.alias("symbol"), F.col("ts").alias("at")), hourly(spark, sf_dir), 5).join(kind, "event_id")


@query(f"WITH {_STUDY_SQL} SELECT event_id, symbol, ts, pre, entry, exit FROM s")
def j11_event_to_bar(spark, sf_dir):
    return _study(spark, sf_dir).select("event_id", "symbol", "ts", "pre", "entry", "exit")


@query(f"""WITH {_STUDY_SQL}, d AS (SELECT kind, (entry / pre - 1) * 100 AS reaction, (exit / entry - 1) * 100 AS drift FROM s WHERE exit IS NOT NULL)
SELECT coalesce(kind, 'all') AS grp, count(*) AS n, round(avg(reaction), 4) AS mean_reaction, round(median(drift), 4) AS median_drift, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_samp(drift) END, 4) AS sd, round(avg(CASE WHEN drift > 0 THEN 100.0 ELSE 0 END), 4) AS hit_rate,
 round(avg(drift) / (stddev_samp(drift) / sqrt(count(*))), 4) AS t FROM d GROUP BY GROUPING SETS ((kind), ())""")
def a10_event_study(spark, sf_dir):
    d = _study(spark, sf_dir).where("exit IS NOT NULL").select("kind", ((F.col("entry") / F.col("pre") - 1) * 100).alias("reaction"), ((F.col("exit") / F.col("entry") - 1) * 100).alias("drift"))
    four = lambda n, x: F.round(x, 4).alias(n)
    sd = F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_samp("drift"))
    g = d.rollup("kind").agg(F.count("*").alias("n"), four("mean_reaction", F.avg("reaction")), four("median_drift", F.median("drift")), four("sd", sd), four("hit_rate", F.avg(F.when(F.col("drift") > 0, 100.0).otherwise(0.0))), four("t", F.avg("drift") / (F.stddev_samp("drift") / F.sqrt(F.count("*")))))
    return g.withColumn("grp", F.coalesce("kind", F.lit("all"))).drop("kind")


@query(f"""WITH {_STUDY_SQL}, d AS (SELECT DISTINCT kind, symbol, ts, (entry / pre - 1) * 100 AS reaction FROM s)
SELECT kind, count(*) AS sessions, round(avg(reaction), 4) AS mean_reaction, round(avg(abs(reaction)), 4) AS abs_reaction FROM d GROUP BY 1 HAVING count(*) >= 3""")
def a15_reaction_table(spark, sf_dir):
    """Each session counts once for a kind."""
    d = _study(spark, sf_dir).select("kind", "symbol", "ts", ((F.col("entry") / F.col("pre") - 1) * 100).alias("reaction")).distinct()
    return d.groupBy("kind").agg(F.count("*").alias("sessions"), F.round(F.avg("reaction"), 4).alias("mean_reaction"), F.round(F.avg(F.abs("reaction")), 4).alias("abs_reaction")).where("sessions >= 3")


@query(f"""WITH {DAILY_SQL}, m AS (SELECT *, abs(close / lag(close) OVER w - 1) AS move, lag(ts) OVER w AS before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), b AS (SELECT * FROM m WHERE move > 0.5),
j AS (SELECT b.symbol, b.ts, e.event_id, e.value, row_number() OVER (PARTITION BY b.symbol, b.ts ORDER BY e.value DESC, e.event_id) AS nth FROM b JOIN events e ON e.event_type = b.symbol AND e.ts > b.before + INTERVAL 16 HOUR AND e.ts <= b.ts + INTERVAL 24 HOUR)
SELECT symbol, ts, event_id, nth FROM j WHERE nth <= 3""")
def j14_event_windows(spark, sf_dir):
    """The three largest events between the last close and eight hours after a big move's own."""
    b = daily(spark, sf_dir).withColumn("move", F.abs(F.col("close") / F.lag("close").over(series()) - 1)).withColumn("before", F.lag("ts").over(series())).where("move > 0.5")
    span = b.select("symbol", "ts", (F.col("before") + F.expr("INTERVAL 16 HOUR")).alias("lo"), (F.col("ts") + F.expr("INTERVAL 24 HOUR")).alias("hi"))
    span = span.withColumn("day", F.explode(F.sequence(F.to_date("lo"), F.to_date("hi"))))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), F.to_date("ts").alias("day"), "event_id", "value")
    j = span.join(e, ["symbol", "day"]).where("at > lo AND at <= hi").withColumn("nth", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("value"), "event_id")))
    return j.where("nth <= 3").select("symbol", "ts", "event_id", "nth")


@query(f"""WITH {DAILY_SQL}, f AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS filed, value FROM events WHERE value > 300)
SELECT b.symbol, b.ts, count(f.value) AS filings, round(coalesce(sum(f.value), 0), 4) AS bought FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.filed + INTERVAL 20 HOUR <= b.ts + INTERVAL 16 HOUR AND f.filed >= CAST(b.ts AS DATE) - 7 GROUP BY 1, 2""")
def j13_interval_sums(spark, sf_dir):
    """Filings known at 20:00 of their day within the week before a session's close, as a window over days."""
    f = table(spark, sf_dir, "events").where("value > 300").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    b = daily(spark, sf_dir).select("symbol", "ts", F.to_date("ts").alias("day"))
    days = b.join(f, ["symbol", "day"], "full").withColumn("k", F.unix_date("day"))
    week = Window.partitionBy("symbol").orderBy("k").rangeBetween(-7, -1)
    x = days.withColumn("filings", F.coalesce(F.sum("n").over(week), F.lit(0))).withColumn("bought", F.round(F.coalesce(F.sum("v").over(week), F.lit(0.0)), 4))
    return x.where("ts IS NOT NULL").select("symbol", "ts", "filings", "bought")


@query(f"""WITH {HOURLY_SQL}, p AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars), r AS (SELECT *, close / before - 1 AS r, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM p)
SELECT symbol, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS total_return, round(min(close / peak - 1), 6) AS drawdown, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe,
 CASE WHEN avg(r) / stddev_samp(r) * sqrt(252) > 2 THEN 'strong' WHEN avg(r) > 0 THEN 'positive' ELSE 'negative' END AS verdict FROM r GROUP BY 1""")
def a18_a32_performance(spark, sf_dir):
    r = hourly(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(series()) - 1).withColumn("peak", F.max("close").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    sharpe = F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0))
    return r.groupBy("symbol").agg(r6("total_return", F.max_by("close", "ts") / F.min_by("close", "ts") - 1), r6("drawdown", F.min(F.col("close") / F.col("peak") - 1)), r6("sharpe", sharpe), F.when(sharpe > 2, "strong").when(F.avg("r") > 0, "positive").otherwise("negative").alias("verdict"))


@query(f"""WITH {HOURLY_SQL}, {MARKET_SQL}, x AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r, mclose / lag(mclose) OVER w - 1 AS m FROM bars JOIN market USING (ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT * FROM x WHERE r IS NOT NULL AND m IS NOT NULL)
SELECT symbol, round(regr_slope(r, m), 6) AS beta, round(regr_intercept(r, m) * 252, 6) AS alpha, round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(exp(sum(ln(1 + r))) - exp(sum(ln(1 + m))), 6) AS excess,
 round(avg(r - m) / nullif(stddev_samp(r - m), 0) * sqrt(252), 6) AS information_ratio FROM v GROUP BY 1""")
def a18_against_benchmark(spark, sf_dir):
    """Alpha, beta, volatility and compounded excess against the market, whose returns are simple ones here."""
    m = market(spark, sf_dir)
    x = hourly(spark, sf_dir).join(m, "ts").withColumn("r", F.col("close") / F.lag("close").over(series()) - 1).withColumn("m", F.col("mclose") / F.lag("mclose").over(series()) - 1).where("r IS NOT NULL AND m IS NOT NULL")
    over = F.col("r") - F.col("m")
    total = lambda c: F.exp(F.sum(F.ln(1 + F.col(c))))
    year = F.sqrt(F.lit(252.0))
    return x.groupBy("symbol").agg(r6("beta", F.regr_slope("r", "m")), r6("alpha", F.regr_intercept("r", "m") * 252), r6("volatility", F.stddev_samp("r") * year), r6("excess", total("r") - total("m")), r6("information_ratio", F.try_divide(F.avg(over), F.stddev_samp(over)) * year))


def verdict(beat: Column, trades: Column, excess: Column) -> Column:
    """What a record says: by the percentage of random traders that it beat, else by how many trades there are, else by what
    it earned over the market."""
    return (
        F.when(beat >= 95, "skill").when(beat <= 50, "luck").when(beat.isNotNull(), "unclear").when(trades < 10, "too few trades")
        .when(excess > 0, "ahead").otherwise("behind")
    )


@query(f"""WITH {USERS_SQL}, {MARKET_SQL}, m AS (SELECT arg_max(mclose, ts) / arg_min(mclose, ts) - 1 AS m FROM market), t AS (SELECT user_id AS symbol, count(*) AS trades FROM events WHERE event_type = 'purchase' GROUP BY 1),
r AS (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) - 1 AS r FROM bars GROUP BY 1), x AS (SELECT symbol, coalesce(trades, 0) AS trades, r - m AS excess, r FROM r LEFT JOIN t USING (symbol), m),
b AS (SELECT *, CASE WHEN trades >= 10 AND symbol % 4 > 0 THEN percent_rank() OVER (PARTITION BY trades >= 10 AND symbol % 4 > 0 ORDER BY r) * 100 END AS beat FROM x)
SELECT symbol, trades, round(beat, 4) AS beat, CASE WHEN beat >= 95 THEN 'skill' WHEN beat <= 50 THEN 'luck' WHEN beat IS NOT NULL THEN 'unclear' WHEN trades < 10 THEN 'too few trades' WHEN excess > 0 THEN 'ahead' ELSE 'behind' END AS verdict FROM b""")
def a32_verdicts(spark, sf_dir):
    """Users as accounts and their purchases as trades; of those with ten, three quarters are ranked among each other."""
    m = market(spark, sf_dir).agg((F.max_by("mclose", "ts") / F.min_by("mclose", "ts") - 1).alias("m"))  # one row
    t = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("symbol")).agg(F.count("*").alias("trades"))
    r = users_daily(spark, sf_dir).groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("r"))
    x = r.join(t, "symbol", "left").join(F.broadcast(m)).select("symbol", "r", F.coalesce("trades", F.lit(0)).alias("trades"), (F.col("r") - F.col("m")).alias("excess"))
    tested = (F.col("trades") >= 10) & (F.col("symbol") % 4 > 0)
    ranked = x.where(tested).select("symbol", (F.percent_rank().over(Window.partitionBy(F.lit(1)).orderBy("r")) * 100).alias("beat"))  # one row an account
    return x.join(ranked, "symbol", "left").select("symbol", "trades", F.round("beat", 4).alias("beat"), verdict(F.col("beat"), F.col("trades"), F.col("excess")).alias("verdict"))
