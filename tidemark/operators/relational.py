"""Joins, aggregates, ordering, sets and predicates over orders, line items, parts and events (J, A, K, U, P).

Funds and their holdings: a fund is a supplier, a filing a quarter of shipping, a position a part. Insiders: an order's
priority is the role, its status the code. Peers: parts of one brand. Orders of a customer stand for dated notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import r6
from tidemark.registry import query, table


def top(df: DataFrame, by: list[str], order: list, n: int, name: str = "nth") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts partitions down before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, days: int, value: list[str], slack_days: int = 0) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of its key that was seen before ``at`` (plus ``slack_days``)
    and at most ``days`` earlier, or nulls. An equi-join on buckets of ``days`` replaces the range join."""
    bucket = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (86400 * (days + slack_days)))
    ident = left.withColumn("_row", F.monotonically_increasing_id())
    probe = ident.withColumn("_b", F.explode(F.array(bucket(F.col(at)) - 1, bucket(F.col(at)), bucket(F.col(at)) + 1)))
    found = right.select(F.col(key), F.col(seen).alias("_seen"), F.struct(F.col(seen).alias("_seen"), *value).alias("_v")).withColumn("_b", bucket(F.col("_seen")))
    day = F.expr("INTERVAL 1 DAY")
    hit = probe.join(found, [key, "_b"]).where((F.col("_seen") < F.col(at) + day * slack_days) & (F.col("_seen") >= F.col(at) - day * days))
    best = hit.groupBy("_row").agg(F.max("_v").alias("_v"))
    return ident.join(best, "_row", "left").select(*left.columns, F.col("_v._seen").alias(f"{seen}_found"), *[F.col(f"_v.{c}").alias(f"{c}_found") for c in value])


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def positions(spark, sf_dir) -> DataFrame:
    """Line items as (fund, period, cusip, shares, cents), dealt out by fund and cusip into tasks that aren't merged. Nearly
    each is a position of its own, so sums made before the shuffle, or in few tasks, would hold a large part of the table."""
    period = F.date_trunc("quarter", "l_shipdate").cast("date").alias("period")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    x = lines(spark, sf_dir).select(F.col("l_suppkey").alias("fund"), period, F.col("l_partkey").alias("cusip"), F.col("l_quantity").alias("shares"), cents)
    return x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fund", "cusip")


def holdings(spark, sf_dir) -> DataFrame:
    """(fund, period, cusip, shares, value), one row a position; value in whole cents."""
    return positions(spark, sf_dir).groupBy("fund", "period", "cusip").agg(F.sum("shares").cast("long").alias("shares"), F.sum("cents").alias("value"))


HOLD = """hold AS (SELECT l_suppkey AS fund, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, l_partkey AS cusip,
  CAST(sum(l_quantity) AS BIGINT) AS shares, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3)"""


@query("""SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j1_inner(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("""SELECT c_custkey, c_name, n_name, count(o_orderkey) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1, 2, 3""")
def j2_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").join(o, "c_custkey", "left").select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("orders"))


@query(f"""WITH {HOLD}, p AS (SELECT *, dense_rank() OVER (PARTITION BY fund ORDER BY period DESC) AS nth FROM hold),
a AS (SELECT * FROM p WHERE nth = 1), b AS (SELECT * FROM p WHERE nth = 2),
m AS (SELECT coalesce(a.fund, b.fund) AS fund, coalesce(a.cusip, b.cusip) AS cusip, a.shares AS now, b.shares AS before FROM a FULL JOIN b ON a.fund = b.fund AND a.cusip = b.cusip)
SELECT fund, cusip, now, before, CASE WHEN before IS NULL THEN 'new' WHEN now IS NULL THEN 'exited' WHEN now > before * 1.02 THEN 'added' WHEN now < before * 0.98 THEN 'trimmed' ELSE 'held' END AS move FROM m""")
def j3_a19_fund_moves(spark, sf_dir):
    p = holdings(spark, sf_dir).withColumn("nth", F.dense_rank().over(Window.partitionBy("fund").orderBy(F.desc("period"))))
    a, b = (p.where(F.col("nth") == k).select("fund", "cusip", F.col("shares").alias(c)) for k, c in ((1, "now"), (2, "before")))
    return a.join(b, ["fund", "cusip"], "full").select("fund", "cusip", "now", "before", move(F.col("now"), F.col("before")).alias("move"))


def move(now: Column, before: Column) -> Column:
    return F.when(before.isNull(), "new").when(now.isNull(), "exited").when(now > before * 1.02, "added").when(now < before * 0.98, "trimmed").otherwise("held")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) ON true""")
def j4_lateral_best(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return table(spark, sf_dir, "customer").join(best, "c_custkey", "left").select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), "b.o_totalprice")


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'), x AS (SELECT o_custkey, o_orderdate AS noted, o_orderpriority FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, m.noted AS noted_found, m.o_orderpriority AS o_orderpriority_found FROM b LEFT JOIN LATERAL
 (SELECT noted, o_orderpriority FROM x WHERE x.o_custkey = b.o_custkey AND noted < b.o_orderdate + INTERVAL 1 DAY AND noted >= b.o_orderdate - INTERVAL 90 DAY ORDER BY noted DESC, o_orderpriority DESC LIMIT 1) m ON true""")
def j5_as_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_orderdate")
    right = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("noted"), "o_orderpriority")
    return as_of(left, right, "o_custkey", "o_orderdate", "noted", 90, ["o_orderpriority"], 1).select("o_orderkey", "noted_found", "o_orderpriority_found")


@query(f"""WITH {HOLD}, t AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY value DESC, cusip, period) AS nth FROM hold) SELECT fund, cusip, period, value, nth FROM t WHERE nth <= 5""")
def j6_top5_per_fund(spark, sf_dir):
    return top(holdings(spark, sf_dir), ["fund"], [F.desc("value"), "cusip", "period"], 5).select("fund", "cusip", "period", "value", "nth")


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def j7_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def j8_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_max(value, ts) AS close FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT a.symbol, a.day, a.close AS entry, b.close AS exit, round(b.close / a.close - 1, 6) AS gain FROM d a JOIN d b ON a.symbol = b.symbol AND b.day = a.day + 5""")
def j9_self_join(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("close"))
    later = d.select("symbol", F.date_sub("day", 5).alias("day"), F.col("close").alias("exit"))
    return d.join(later, ["symbol", "day"]).select("symbol", "day", F.col("close").alias("entry"), "exit", r6("gain", F.col("exit") / F.col("close") - 1))


@query("""SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned FROM supplier""")
def j10_scalar_subquery(spark, sf_dir):
    n = lines(spark, sf_dir).where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("n"))
    return table(spark, sf_dir, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("returned"))


@query(f"""WITH {HOLD} SELECT h.fund, h.cusip, coalesce(p_name, 'cusip ' || h.cusip) AS symbol, sum(h.value)::BIGINT AS value FROM hold h LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = h.cusip GROUP BY 1, 2, 3""")
def j15_symbol_resolution(spark, sf_dir):
    """Names are counted by part and symbol first, so that the sums by fund and part need no second grouping."""
    symbol = F.coalesce("p_name", F.concat(F.lit("cusip "), F.col("cusip"))).alias("symbol")
    names = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cusip"), "p_name").groupBy("cusip", symbol).agg(F.count("*").alias("n"))
    x = positions(spark, sf_dir).groupBy("fund", "cusip").agg(F.sum("cents").alias("value")).join(names, "cusip", "left")
    bare = F.coalesce("symbol", F.concat(F.lit("cusip "), F.col("cusip")))
    return x.select("fund", "cusip", bare.alias("symbol"), (F.col("value") * F.coalesce("n", F.lit(1))).alias("value"))


@query("""WITH u AS (SELECT page_id, regexp_replace(lower(url), '[?#].*$', '') AS canonical, strlen(html) AS n FROM pages)
SELECT canonical, count(*) AS copies, arg_max(page_id, n * 1000000 - page_id) AS best FROM u GROUP BY canonical""")
def j16_merge_by_url(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.lower("url"), "[?#].*$", "").alias("canonical"), F.octet_length("html").cast("long").alias("n"))
    return u.groupBy("canonical").agg(F.count("*").alias("copies"), F.max_by("page_id", F.col("n") * 1000000 - F.col("page_id")).alias("best"))


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS deep, CAST(sum(l_quantity) FILTER (WHERE l_tax = 0) AS BIGINT) AS untaxed,
 count(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O') AS funds, list_sort(list(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 49)) AS numbers FROM lineitem GROUP BY 1""")
def a1_filtered_aggregates(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("deep"), F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity"))).cast("long").alias("untaxed"),
        F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("funds"), F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 49, F.col("l_linenumber")))).alias("numbers"))


@query("""SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, min(o_orderdate) AS first_order FROM orders GROUP BY 1 HAVING max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') > 300000""")
def a2_bool_or_having(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.min("o_orderdate").alias("first_order"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("most"))
    return g.where("most > 300000").drop("most")


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price FROM part GROUP BY 1""")
def a3_median(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(r6("median_price", F.percentile("p_retailprice", 0.5)))


@query("""WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_size END AS x FROM part),
r AS (SELECT *, count(x) OVER (PARTITION BY p_brand) AS reporting, rank() OVER (PARTITION BY p_brand ORDER BY x NULLS LAST) - 1 AS below FROM m)
SELECT p_partkey, reporting, CASE WHEN x IS NOT NULL AND reporting >= 5 THEN round(below * 100.0::DOUBLE / (reporting - 1), 6) END AS percentile FROM r""")
def a4_peer_percentile(spark, sf_dir):
    """The share of reporting peers below; only where five report. Ties share."""
    m = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("x"))
    by = Window.partitionBy("p_brand")
    r = m.withColumn("reporting", F.count("x").over(by)).withColumn("below", F.rank().over(by.orderBy(F.asc_nulls_last("x"))) - 1)
    return r.select("p_partkey", "reporting", F.when(F.col("x").isNotNull() & (F.col("reporting") >= 5), F.round(F.col("below") * 100.0 / (F.col("reporting") - 1), 6)).alias("percentile"))


@query("""SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id""")
def a5_latest_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_type", "value")).alias("x")).select("user_id", "x.*")


@query("""WITH e AS (SELECT source, doc_id % 50 AS event_id, doc_id, lang, n_chars FROM documents)
SELECT event_id, count(DISTINCT source) AS sources, max(n_chars) AS trust, bool_or(lang = 'fr') AS official, min(doc_id) FILTER (WHERE lang = 'fr') AS first_official, greatest(count(DISTINCT source), 3) AS merged FROM e GROUP BY 1""")
def a6_evidence_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "documents").withColumn("event_id", F.col("doc_id") % 50)
    g = e.groupBy("event_id").agg(F.countDistinct("source").alias("sources"), F.max("n_chars").alias("trust"), F.bool_or(F.col("lang") == "fr").alias("official"), F.min(F.when(F.col("lang") == "fr", F.col("doc_id"))).alias("first_official"))
    return g.withColumn("merged", F.greatest("sources", F.lit(3).cast("long")))


@query("""WITH x AS (SELECT event_type AS source, user_id AS event, min(ts) AS added FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS nth, date_diff('second', added, lead(added) OVER w) AS lead_s FROM x WINDOW w AS (PARTITION BY event ORDER BY added, source))
SELECT source, count(*) AS participated, count(*) FILTER (WHERE nth = 1) AS firsts, round(avg(lead_s) FILTER (WHERE nth = 1), 6) AS mean_lead FROM r GROUP BY source HAVING count(*) >= 2 ORDER BY firsts DESC, source""")
def a7_w13_source_latency(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("event")).agg(F.min("ts").alias("added"))
    w = Window.partitionBy("event").orderBy("added", "source")
    whole = lambda c: F.date_trunc("second", c).cast("timestamp").cast("long")
    r = x.withColumn("nth", F.row_number().over(w)).withColumn("lead_s", whole(F.lead("added").over(w)) - whole(F.col("added")))
    g = r.groupBy("source").agg(F.count("*").alias("participated"), F.count_if(F.col("nth") == 1).alias("firsts"), r6("mean_lead", F.avg(F.when(F.col("nth") == 1, F.col("lead_s")))))
    return g.where("participated >= 2").orderBy(F.desc("firsts"), "source")


@query("""SELECT coalesce(event_type, 'all') AS event_type, count(*) AS n, coalesce(CAST(sum(user_id) FILTER (WHERE value > 100) AS BIGINT), 0) AS big FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def a8_group_counts(spark, sf_dir):
    big = F.coalesce(F.sum(F.when(F.col("value") > 100, F.col("user_id"))), F.lit(0)).alias("big")
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), big).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query("""SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT max(ts) FROM events) AS newest""")
def a9_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.max("ts").alias("newest"))
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    return e.join(d)  # one row each


@query(f"""WITH {HOLD}, k AS (SELECT fund, CASE WHEN shares > 40 THEN 'large' WHEN shares > 20 THEN 'middle' ELSE 'small' END AS kind, value FROM hold)
SELECT fund, kind, count(*) AS n, round(sum(value)::DOUBLE / sum(sum(value)) OVER (PARTITION BY fund)::DOUBLE, 6) AS share FROM k GROUP BY 1, 2""")
def a20_fund_mix(spark, sf_dir):
    kind = F.when(F.col("shares") > 40, "large").when(F.col("shares") > 20, "middle").otherwise("small").alias("kind")
    g = holdings(spark, sf_dir).groupBy("fund", kind).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return g.select("fund", "kind", "n", r6("share", F.col("v") / F.sum("v").over(Window.partitionBy("fund"))))


@query("""SELECT o_orderpriority AS symbol, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice), 2) AS bought FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2""")
def a21_insider_clusters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP_NTZ '2001-01-01'")
    return o.groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.countDistinct("o_custkey").alias("buyers"), F.round(F.sum("o_totalprice"), 2).alias("bought")).where("buyers >= 2")


@query("""SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS filed, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'chief' WHEN bool_or(o_orderpriority LIKE '2%') THEN 'director' ELSE 'other' END AS role, round(sum(o_totalprice), 2) AS value
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2 HAVING sum(o_totalprice) >= 100000""")
def a22_insider_study(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    starts = lambda d: F.bool_or(F.col("o_orderpriority").startswith(d))
    g = o.groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("filed")).agg(F.when(starts("1"), "chief").when(starts("2"), "director").otherwise("other").alias("role"), F.sum("o_totalprice").alias("v"))
    return g.where("v >= 100000").select("symbol", "filed", "role", F.round("v", 2).alias("value"))


@query("""WITH p AS (SELECT value / (SELECT max(value) FROM events) AS p, CAST(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) = 'purchase' AS INT) AS hit FROM events)
SELECT CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS hit_rate FROM p WHERE hit IS NOT NULL GROUP BY 1""")
def a23_reliability_bins(spark, sf_dir):
    p = _forecasts(spark, sf_dir)
    return p.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), r6("mean_p", F.avg("p")), r6("hit_rate", F.avg("hit")))


def _forecasts(spark, sf_dir) -> DataFrame:
    """(p, hit): a value over the largest, and whether the user's next event is a purchase."""
    e = table(spark, sf_dir, "events")
    most = F.broadcast(e.agg(F.max("value").alias("most")))  # one row
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    return e.withColumn("hit", (nxt == "purchase").cast("int")).join(most).select((F.col("value") / F.col("most")).alias("p"), "hit").where("hit IS NOT NULL")


@query("""WITH p AS (SELECT value / (SELECT max(value) FROM events) AS p, CAST(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts) = 'purchase' AS INT) AS hit FROM events)
SELECT round(avg(pow(p - hit, 2)), 6) AS brier, round(avg(hit) * (1 - avg(hit)), 6) AS base FROM p WHERE hit IS NOT NULL""")
def a24_brier(spark, sf_dir):
    return _forecasts(spark, sf_dir).agg(r6("brier", F.avg(F.pow(F.col("p") - F.col("hit"), 2))), r6("base", F.avg("hit") * (1 - F.avg("hit"))))


@query("""WITH x AS (SELECT p_brand, p_retailprice, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS b, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, round(corr(a, b), 6) AS rank_ic, round(avg(p_size) FILTER (WHERE a > n - n // 10) - avg(p_size), 6) AS top_decile FROM x GROUP BY 1""")
def a25_rank_ic(spark, sf_dir):
    by = Window.partitionBy("p_brand")
    x = table(spark, sf_dir, "part").withColumn("a", F.row_number().over(by.orderBy("p_retailprice", "p_partkey"))).withColumn("b", F.row_number().over(by.orderBy("p_size", "p_partkey"))).withColumn("n", F.count("*").over(by))
    return x.groupBy("p_brand").agg(r6("rank_ic", F.corr("a", "b")), r6("top_decile", F.avg(F.when(F.col("a") > F.col("n") - F.floor(F.col("n") / 10), F.col("p_size"))) - F.avg("p_size")))


@query("""WITH y AS (SELECT o_custkey, extract(year FROM o_orderdate) AS y, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1, 2)
SELECT o_custkey, count(*) AS periods, CASE WHEN count(*) >= 4 THEN CASE WHEN abs(arg_max(x, y) / arg_min(x, y) - 1) < 0.05 THEN 'flat' WHEN arg_max(x, y) > arg_min(x, y) THEN 'improving' ELSE 'deteriorating' END END AS trend FROM y GROUP BY 1""")
def a28_period_trend(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("x"))
    g = y.groupBy("o_custkey").agg(F.count("*").alias("periods"), F.max_by("x", "y").alias("l"), F.min_by("x", "y").alias("f"))
    kind = F.when(F.abs(F.col("l") / F.col("f") - 1) < 0.05, "flat").when(F.col("l") > F.col("f"), "improving").otherwise("deteriorating")
    return g.select("o_custkey", "periods", F.when(F.col("periods") >= 4, kind).alias("trend"))


@query("""SELECT l_partkey, arg_max(l_quantity, l_shipdate::DATE - DATE '1990-01-01' + l_orderkey / 1e7) AS shares FROM (SELECT * FROM lineitem WHERE l_quantity > 25) GROUP BY 1 HAVING count(*) = 1""")
def a29_latest_positive(spark, sf_dir):
    g = lines(spark, sf_dir).where("l_quantity > 25").groupBy("l_partkey").agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey")).alias("shares"), F.count("*").alias("n"))
    return g.where("n = 1").select("l_partkey", "shares")


@query("""WITH y AS (SELECT c_mktsegment, CAST(floor(c_acctbal / 1000) AS INT) AS bin, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY 1, 2)
SELECT bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS s, list_sort(list(c_mktsegment)) AS segments FROM y GROUP BY bin""")
def a33_merged_records(spark, sf_dir):
    y = table(spark, sf_dir, "customer").groupBy("c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))
    return y.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.array_sort(F.collect_list("c_mktsegment")).alias("segments"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_totalprice END AS k FROM orders) ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 100""")
def k1_order_nulls_last(spark, sf_dir):
    k = F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").orderBy(k.desc_nulls_last(), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").limit(100)


@query("""SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50""")
def k3_paging(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).offset(50).limit(25)


@query("""SELECT event_id, ts FROM (SELECT event_id, ts FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, ts FROM events WHERE event_type = 'view') ORDER BY ts DESC, event_id DESC LIMIT 60""")
def k4_shard_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'")).drop("event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(60)


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS held, c_acctbal FROM customer ORDER BY held DESC, c_acctbal DESC NULLS LAST, c_custkey LIMIT 80""")
def k5_flag_first(spark, sf_dir):
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("held", F.lit(True))
    c = table(spark, sf_dir, "customer").join(held, "c_custkey", "left").select("c_custkey", F.coalesce("held", F.lit(False)).alias("held"), "c_acctbal")
    return c.orderBy(F.desc("held"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(80)


@query("""WITH w AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY n DESC, user_id) AS r, count(*) OVER (PARTITION BY week) AS all_ FROM w) WHERE r <= all_ // 10)
SELECT a.week, count(*) AS held, count(b.user_id) AS stayed FROM t a LEFT JOIN t b ON b.user_id = a.user_id AND b.week = a.week - 7 GROUP BY 1""")
def k6_top_decile_turnover(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("week")
    t = w.withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), "user_id"))).withColumn("all", F.count("*").over(by)).where("r <= floor(`all` / 10)")
    before = t.select("user_id", F.date_add("week", 7).alias("week"), F.lit(1).alias("was"))
    return t.join(before, ["user_id", "week"], "left").groupBy("week").agg(F.count("*").alias("held"), F.count("was").alias("stayed"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 4 AS INT) AS b, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 2 END AS c FROM orders)
SELECT o_orderkey, least(a, b, c) AS soonest, CASE least(a, b, c) WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END AS kind FROM d ORDER BY soonest, o_orderkey LIMIT 200""")
def k7_soonest_date(spark, sf_dir):
    a = F.to_date("o_orderdate")
    d = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 9 - 4).cast("int")).alias("b"), F.when(F.col("o_orderkey") % 3 == 0, F.date_sub(a, 2)).alias("c"))
    x = d.withColumn("soonest", F.least("a", "b", "c"))
    return x.select("o_orderkey", "soonest", F.when(F.col("soonest") == F.col("a"), "a").when(F.col("soonest") == F.col("b"), "b").otherwise("c").alias("kind")).orderBy("soonest", "o_orderkey").limit(200)


@query("""SELECT p_partkey, p_size FROM (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_size END AS p_size FROM part) ORDER BY coalesce(p_size, '-infinity'::DOUBLE) DESC, p_partkey LIMIT 100""")
def k8_missing_last(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_size")).alias("p_size"))
    return p.orderBy(F.desc(F.coalesce(F.col("p_size").cast("double"), F.lit(float("-inf")))), "p_partkey").limit(100)


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS nth FROM conversations) SELECT conv_id, turn, role, text FROM t WHERE nth = 1""")
def k9_latest_rows(spark, sf_dir):
    return top(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), "role", "text"], 1).select("conv_id", "turn", "role", "text")


@query("""WITH r AS (SELECT source, doc_id, n_chars % 40 AS relevance FROM documents), c AS (SELECT *, count(*) FILTER (WHERE relevance >= 10) OVER (PARTITION BY source) AS good, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS nth FROM r)
SELECT source, doc_id, relevance FROM c WHERE CASE WHEN good >= 8 THEN relevance >= 10 ELSE nth <= 30 END""")
def k10_relevance_cut(spark, sf_dir):
    by = Window.partitionBy("source")
    r = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") % 40).alias("relevance"))
    c = r.withColumn("good", F.count_if(F.col("relevance") >= 10).over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.desc("relevance"), "doc_id")))
    return c.where(F.when(F.col("good") >= 8, F.col("relevance") >= 10).otherwise(F.col("nth") <= 30)).select("source", "doc_id", "relevance")


@query("""SELECT 'c' AS side, c_nationkey AS nation FROM customer UNION SELECT 's', s_nationkey FROM supplier""")
def u1_union_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"))
    return c.union(table(spark, sf_dir, "supplier").select(F.lit("s"), "s_nationkey")).distinct()


@query("""WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY 1""")
def u2_shard_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda where: e.where(where).groupBy("event_type").agg(F.count("*").alias("n"))
    return part("ts < TIMESTAMP_NTZ '2024-01-15'").unionByName(part("ts >= TIMESTAMP_NTZ '2024-01-15'")).groupBy("event_type").agg(F.sum("n").alias("n"))


@query(f"""WITH {HOLD}, f AS (SELECT fund, period, count(*) AS positions, row_number() OVER (PARTITION BY fund ORDER BY period DESC) AS nth FROM hold GROUP BY 1, 2) SELECT fund, period, positions, nth FROM f WHERE nth <= 2""")
def w12_latest_filings(spark, sf_dir):
    f = holdings(spark, sf_dir).groupBy("fund", "period").agg(F.count("*").alias("positions"))
    return top(f, ["fund"], [F.desc("period")], 2)


@query("""SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 + 100 + 1 AS position FROM customer WHERE c_acctbal < 0""")
def w14_append_positions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return c.select("c_mktsegment", "c_custkey", (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1 + 100 + 1).cast("long").alias("position"))
