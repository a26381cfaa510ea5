"""Bars: how they are made, checked, stored and read.

A bar is (symbol, ts, open, high, low, close, volume); a missing value is null, never 0. The driver's tables hold no
market data: ``hourly`` derives bars from events, one symbol for each event type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.registry import query, table

PRICES = ("open", "high", "low", "close")

#: The same derivation in SQL, as the first part of a WITH clause.
HOURLY_SQL = """
bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
           min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
         FROM events WHERE value > 0 GROUP BY 1, 2)"""
DAILY_SQL = HOURLY_SQL.replace("'hour'", "'day'")
USERS_SQL = HOURLY_SQL.replace("'hour'", "'day'").replace("event_type AS symbol", "user_id AS symbol")
MARKET_SQL = """
market AS (SELECT date_trunc('hour', ts) AS ts, arg_max(value, ts) AS mclose FROM events WHERE value > 0 GROUP BY 1)"""


def ohlcv(ticks: DataFrame, unit: str, symbol: Column, at: str = "ts", price: str = "value") -> DataFrame:
    """Bars of ticks: one for each symbol and time bucket that has a positive price."""
    return (
        ticks.where(F.col(price) > 0).groupBy(symbol.alias("symbol"), F.date_trunc(unit, at).cast("timestamp_ntz").alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume"))
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(table(spark, sf_dir, "events"), "hour", F.col("event_type"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(table(spark, sf_dir, "events"), "day", F.col("event_type"))


def users_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section: one symbol for each user."""
    return ohlcv(table(spark, sf_dir, "events"), "day", F.col("user_id"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: all events pooled by hour."""
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("value", "ts").alias("mclose"))


def valid() -> Column:
    """Whether a bar is sound: finite prices, high and low around the others, no negative volume. Never null."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*PRICES, "volume")]
    whole = finite[0] & finite[1] & finite[2] & finite[3] & finite[4]
    around = (F.col("high") >= F.greatest("low", "open", "close")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(whole & around & (F.col("volume") >= 0), F.lit(False))


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each symbol."""
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return bars.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def last_write_wins(bars: DataFrame, version: str) -> DataFrame:
    """One bar for each (symbol, ts): that of the largest ``version``."""
    row = F.struct(version, *[c for c in bars.columns if c not in ("symbol", "ts", version)])
    return bars.groupBy("symbol", "ts").agg(F.max(row).alias("r")).select("symbol", "ts", "r.*")


def upsert(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """``old`` with ``new`` bars put in; of one key the later ``version`` stays."""
    return last_write_wins(old.unionByName(new), version)


def joined_history(recent: DataFrame, older: DataFrame) -> DataFrame:
    """``recent`` and, before each symbol's first bar there, ``older``: no overlap."""
    first = recent.groupBy("symbol").agg(F.min("ts").alias("cut"))
    before = older.join(first, "symbol", "left").where(F.col("cut").isNull() | (F.col("ts") < F.col("cut"))).drop("cut")
    return before.unionByName(recent)


def filled(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars on every session of ``calendar`` (ts) from a symbol's first bar on: a missing session carries the close before,
    without volume. A join on months stands for the range join."""
    w = Window.partitionBy("symbol").orderBy("ts")
    last = F.broadcast(calendar.agg(F.max("ts").alias("last")))  # one row
    span = bars.groupBy("symbol").agg(F.min("ts").alias("from")).join(last).where("from <= last")
    span = span.select("symbol", "from", F.explode(F.sequence(F.trunc("from", "month"), F.trunc("last", "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    grid = calendar.withColumn("month", F.trunc("ts", "month")).join(span, "month").where("ts >= from").select("symbol", "ts")
    x = grid.join(bars, ["symbol", "ts"], "left").withColumn("carried", F.last("close", ignorenulls=True).over(w))
    price = {c: F.coalesce(c, "carried").alias(c) for c in PRICES}
    return x.select("symbol", "ts", *price.values(), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.col("close").isNull().alias("carried_over"))


def from_columns(wire: DataFrame) -> DataFrame:
    """Bars of parallel arrays (t as YYYYMMDD, o, h, l, c, v); arrays of unequal length give none, unsound bars go."""
    n = F.size("t")
    same = (F.size("o") == n) & (F.size("h") == n) & (F.size("l") == n) & (F.size("c") == n) & (F.size("v") == n)
    rows = wire.where(same).select("symbol", F.inline(F.arrays_zip("t", "o", "h", "l", "c", "v")))
    day = F.to_date(F.col("t").cast("string"), "yyyyMMdd")
    named = rows.select("symbol", day.alias("session"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").cast("double").alias("volume"))
    return named.where(valid() & F.col("session").isNotNull())


def random_walk(spark: SparkSession, symbols: list[str], bars: int, seed: int = 1) -> DataFrame:
    """Bars of a walk that depends on symbol, step and seed alone. For tests."""
    steps = spark.createDataFrame([(s,) for s in symbols], "symbol string").select("symbol", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("i"))
    draw = F.pmod(F.xxhash64("symbol", "i", F.lit(seed)), F.lit(10001)) / 10000.0 - 0.5
    close = 100 * F.exp(F.sum(draw * 0.02).over(Window.partitionBy("symbol").orderBy("i")))
    rows = steps.withColumn("close", close).withColumn("open", F.coalesce(F.lag("close").over(Window.partitionBy("symbol").orderBy("i")), F.col("close")))
    return rows.select("symbol", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 3600).cast("timestamp_ntz").alias("ts"), "open", (F.greatest("open", "close") * 1.002).alias("high"), (F.least("open", "close") * 0.998).alias("low"), "close", (1000 + F.pmod(F.xxhash64("symbol", "i"), F.lit(500))).cast("double").alias("volume"))


@query(f"""WITH {HOURLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM bars)
SELECT symbol, ts, open, high, low, close, volume FROM r WHERE nth <= 50""")
def s1_bar_scan(spark, sf_dir):
    return newest(hourly(spark, sf_dir), 50)


@query(f"""WITH {HOURLY_SQL}, n AS (SELECT *, 1 AS version FROM bars UNION ALL
  SELECT symbol, ts, open, high, low, close * 2, volume, 2 FROM bars WHERE extract(hour FROM ts) = 10),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY version DESC) AS nth FROM n)
SELECT symbol, ts, version, open, high, low, close, volume FROM r WHERE nth = 1""")
def s2_bar_upsert(spark, sf_dir):
    old = hourly(spark, sf_dir).withColumn("version", F.lit(1))
    new = old.where(F.hour("ts") == 10).withColumn("close", F.col("close") * 2).withColumn("version", F.lit(2))
    return upsert(old, new, "version")


@query(f"""WITH {HOURLY_SQL}, recent AS (SELECT * FROM bars WHERE ts >= TIMESTAMP '2024-01-15'),
cut AS (SELECT symbol, min(ts) AS cut FROM recent GROUP BY symbol),
older AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-20')
SELECT * FROM recent UNION ALL SELECT o.* FROM older o LEFT JOIN cut c USING (symbol) WHERE c.cut IS NULL OR o.ts < c.cut""")
def s3_joined_history(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return joined_history(b.where("ts >= TIMESTAMP_NTZ '2024-01-15'"), b.where("ts < TIMESTAMP_NTZ '2024-01-20'"))


@query(f"""WITH {HOURLY_SQL}, fresh AS (SELECT * FROM bars WHERE extract(day FROM ts) % 3 = 0),
other AS (SELECT * FROM bars WHERE extract(day FROM ts) % 3 <> 2)
SELECT b.symbol, b.ts, coalesce(f.close, o.close, b.close) AS close,
  CASE WHEN f.close IS NOT NULL THEN 'cache' WHEN o.close IS NOT NULL THEN 'provider' ELSE 'stale' END AS origin
FROM bars b LEFT JOIN fresh f USING (symbol, ts) LEFT JOIN other o USING (symbol, ts)""")
def s4_source_order(spark, sf_dir):
    """Fresh cache, then a provider, then the stale cache, which is marked."""
    b = hourly(spark, sf_dir)
    part = lambda where, name: b.where(where).select("symbol", "ts", F.col("close").alias(name))
    x = b.join(part(F.dayofmonth("ts") % 3 == 0, "f"), ["symbol", "ts"], "left").join(part(F.dayofmonth("ts") % 3 != 2, "o"), ["symbol", "ts"], "left")
    origin = F.when(F.col("f").isNotNull(), "cache").when(F.col("o").isNotNull(), "provider").otherwise("stale")
    return x.select("symbol", "ts", F.coalesce("f", "o", "close").alias("close"), origin.alias("origin"))


@query(f"""WITH {HOURLY_SQL}, dirty AS (SELECT symbol, ts, open, CASE WHEN volume > 3 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN extract(hour FROM ts) = 5 THEN NULL ELSE close END AS close, volume FROM bars)
SELECT symbol, count(*) FILTER (WHERE ok) AS kept, count(*) FILTER (WHERE NOT ok) AS dropped FROM
 (SELECT symbol, coalesce(high >= greatest(low, open, close) AND low <= least(open, close) AND volume >= 0 AND close IS NOT NULL, false) AS ok FROM dirty)
GROUP BY symbol""")
def s5_bar_validity(spark, sf_dir):
    dirty = hourly(spark, sf_dir).withColumn("high", F.when(F.col("volume") > 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.hour("ts") != 5, F.col("close")))
    return dirty.groupBy("symbol").agg(F.count_if(valid()).alias("kept"), F.count_if(~valid()).alias("dropped"))


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT *, 1 AS seq FROM bars UNION ALL SELECT symbol, ts, open, high, low, open, volume, 2 FROM bars WHERE volume > 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS nth FROM x)
SELECT symbol, ts, seq, open, high, low, close, volume FROM r WHERE nth = 1""")
def s6_dedupe_keep_last(spark, sf_dir):
    b = hourly(spark, sf_dir).withColumn("seq", F.lit(1))
    again = b.where("volume > 2").withColumn("close", F.col("open")).withColumn("seq", F.lit(2))
    return last_write_wins(b.unionByName(again), "seq")


@query(f"""WITH {DAILY_SQL} SELECT symbol, CAST(ts AS DATE) AS session, open, high, low, close, volume FROM bars
WHERE symbol <> (SELECT min(symbol) FROM bars)""")
def s8_columnar_wire(spark, sf_dir):
    """Bars turned to parallel arrays and back; one symbol's arrays are cut short and give no bars."""
    x = F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyyMMdd").cast("int").alias("t"), "open", "high", "low", "close", "volume")))
    wire = daily(spark, sf_dir).groupBy("symbol").agg(x.alias("x"))
    arrays = wire.select("symbol", *[F.col(f"x.{c}").alias(a) for c, a in zip(("t", "open", "high", "low", "close", "volume"), "tohlcv")])
    least = wire.agg(F.min("symbol").alias("least"))
    cut = arrays.join(F.broadcast(least)).withColumn("v", F.when(F.col("symbol") == F.col("least"), F.slice("v", 1, 1)).otherwise(F.col("v"))).drop("least")
    return from_columns(cut)


@query(f"""WITH {HOURLY_SQL}, cal AS (SELECT DISTINCT ts FROM bars), span AS (SELECT symbol, min(ts) AS f FROM bars GROUP BY symbol),
x AS (SELECT s.symbol, c.ts, b.open, b.high, b.low, b.close, b.volume,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY c.ts ROWS UNBOUNDED PRECEDING) AS carried
  FROM span s JOIN cal c ON c.ts >= s.f LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = c.ts)
SELECT symbol, ts, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low,
  coalesce(close, carried) AS close, coalesce(volume, 0.0) AS volume, close IS NULL AS carried_over FROM x""")
def w15_gap_fill(spark, sf_dir):
    b = hourly(spark, sf_dir)
    return filled(b, b.select("ts").distinct())
