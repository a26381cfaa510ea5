"""Predicates, buckets and scalar formulas over columns (P1-P25, scalar functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.indicators import r6
from tidemark.registry import query, table


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of a list of conditions; true if it is empty."""
    return reduce(Column.__and__, conditions, F.lit(True))


def event_filter(kinds: list[str] | None = None, floor: float | None = None, users: list[int] | None = None, since: str | None = None) -> Column:
    """A filter of those conditions that are given."""
    out = []
    if kinds:
        out.append(F.col("event_type").isin(kinds))
    if floor is not None:
        out.append(F.col("value") >= floor)
    if users:
        out.append(F.col("user_id").isin(users))
    if since:
        out.append(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return all_of(out)


def content_age(published: Column, discovered: Column) -> Column:
    """When content counts as new: its publication unless that is unknown or after its discovery."""
    return F.when(published.isNull() | (published > discovered), discovered).otherwise(published)


def trusted_time(published: Column, discovered: Column, observer: Column) -> Column:
    """A publication time, or null if it is over five minutes in the future, or of an observer within a minute before."""
    late = published > discovered + F.expr("INTERVAL 5 MINUTE")
    echo = observer & (published > discovered - F.expr("INTERVAL 1 MINUTE"))
    return F.when(~F.coalesce(late | echo, F.lit(False)), published)


def staleness(at: Column, now: Column) -> Column:
    return (
        F.when(at.isNull() | (at > now), "unknown").when(at > now - F.expr("INTERVAL 24 HOUR"), "fresh")
        .when(at > now - F.expr("INTERVAL 7 DAY"), "recent").otherwise("old")
    )


def market_phase(utc: Column) -> Column:
    """The phase of the New York session at a UTC time; no holidays."""
    ny = F.from_utc_timestamp(utc.cast("timestamp"), "America/New_York")
    minute = F.hour(ny) * 60 + F.minute(ny)
    return (
        F.when(F.dayofweek(ny).isin(1, 7), "weekend").when(minute.between(240, 569), "pre_open").when(minute.between(570, 959), "open")
        .when(minute.between(960, 1199), "post_close").otherwise("overnight")
    )


def surprise_bucket(x: Column) -> Column:
    return F.when(x >= 10, "big beat").when(x >= 2, "beat").when(x > -2, "in line").when(x > -10, "miss").when(x.isNotNull(), "big miss")


#: Bounds outside of which a ratio is not usable.
BOUNDS = {"pe": (0, 100), "pb": (0, 100), "ev_ebitda": (0, 200), "debt_to_equity": (0, 2000), "roe": (-10, 10), "margin": (-10, 10), "yield": (0, 100)}


def usable(kind: str, x: Column) -> Column:
    low, high = BOUNDS[kind]
    return F.when(x.between(low, high), x)


def half_away(x: Column, places: int) -> Column:
    """Rounded half away from zero; 0 for what is no number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.round(x, places))


def skewness(x: Column, over) -> Column:
    """Mean cube of standard scores by the sample deviation."""
    n, m, s = F.count(x).over(over), F.avg(x).over(over), F.stddev_samp(x).over(over)
    third = F.avg(x * x * x).over(over) - 3 * m * F.avg(x * x).over(over) + 2 * m * m * m
    return F.when(n > 2, F.try_divide(third, s * s * s))


def unit_rank(x: Column, day: list[str]) -> Column:
    """Ranks of a cross-section drawn to [-1, 1], ties averaged; 0 for a single row."""
    by = Window.partitionBy(*day)
    n = F.count(x).over(by)
    middle = F.rank().over(by.orderBy(x)) - 1 + (F.count("*").over(Window.partitionBy(*day, x)) - 1) / 2
    return F.when(n > 1, middle / (n - 1) * 2 - 1).otherwise(0.0)


def token_cost(hit: Column, miss: Column, out: Column, model: Column, at: Column, prices: dict[str, tuple[float, float, float]]) -> Column:
    """Dollars for a million tokens each; half price from 16:30 to 00:30 UTC; an unknown model costs as the dearest."""
    dear = max(prices.values())
    minute = F.hour(at) * 60 + F.minute(at)
    price = lambda k: reduce(lambda c, m: c.when(model == m, F.lit(prices[m][k])), prices, F.when(F.lit(False), 0.0)).otherwise(F.lit(dear[k]))
    full = (hit * price(0) + miss * price(1) + out * price(2)) / 1e6
    return F.when((minute >= 990) | (minute < 30), full / 2).otherwise(full)


@query("""SELECT event_id, ts, value FROM events WHERE event_type IN ('click', 'view') AND value >= 50 AND ts >= TIMESTAMP '2024-01-20'""")
def p1_p2_dynamic_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(event_filter(["click", "view"], 50, since="2024-01-20")).select("event_id", "ts", "value")


@query("""SELECT doc_id, regexp_matches(text, 'Th[aeio]') AS hit, NOT regexp_matches(text, '\\d{3}') AS plain, regexp_matches(text, '(?i)LICENSE') AS any_case FROM documents""")
def p3_regex(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike("Th[aeio]").alias("hit"), (~t.rlike(r"\d{3}")).alias("plain"), t.rlike("(?i)LICENSE").alias("any_case"))


@query("""SELECT source, count(*) FILTER (WHERE source LIKE 'src1%') AS watched, count(*) FILTER (WHERE source NOT LIKE 'src1%') AS other FROM documents GROUP BY 1""")
def p4_like(spark, sf_dir):
    w = F.col("source").like("src1%")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(w).alias("watched"), F.count_if(~w).alias("other"))


@query("""WITH s AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS x FROM orders GROUP BY 1) SELECT o_custkey FROM s WHERE list_has_all(x, ['F', 'P'])""")
def p5_array_containment(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("x"))
    return s.where(F.size(F.array_except(F.array(F.lit("F"), F.lit("P")), "x")) == 0).select("o_custkey")


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS b, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 30 END AS c FROM orders)
SELECT o_orderkey FROM d WHERE a BETWEEN DATE '1998-06-01' AND DATE '1998-06-15' OR b BETWEEN DATE '1998-06-01' AND DATE '1998-06-15' OR c BETWEEN DATE '1998-06-01' AND DATE '1998-06-15'""")
def p6_any_date_in_window(spark, sf_dir):
    a, start = F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")
    k = F.col("o_orderkey")
    dates = [a, F.when(k % 2 == 0, F.date_add(a, 30)), F.when(k % 3 == 0, F.date_sub(a, 30))]
    return table(spark, sf_dir, "orders").where(reduce(Column.__or__, [d.between(start, F.date_add(start, 14)) for d in dates])).select("o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS kind, coalesce(nullif(p_size, 7), -1) AS size, greatest(p_size, 5) AS up, least(CASE WHEN p_size > 40 THEN NULL ELSE p_size END, 20) AS down FROM part""")
def p7_p8_ladders(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(s < 10, "small").when(s < 30, "middle").otherwise("large").alias("kind"), F.coalesce(F.nullif(s, F.lit(7)), F.lit(-1)).alias("size"), F.greatest(s, F.lit(5)).alias("up"), F.least(F.when(s <= 40, s), F.lit(20)).alias("down"))


_TIMES = """t AS (SELECT event_id, ts AS discovered, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + to_minutes(CAST(event_id % 40 - 30 AS INT)) END AS published, event_type = 'view' AS observer FROM events)"""


def _times(spark, sf_dir) -> DataFrame:
    pub = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 40 - 30).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("discovered"), pub.alias("published"), (F.col("event_type") == "view").alias("observer"))


@query(f"""WITH {_TIMES} SELECT event_id, CASE WHEN published IS NULL OR published > discovered THEN discovered ELSE published END AS age FROM t""")
def p9_content_age(spark, sf_dir):
    return _times(spark, sf_dir).select("event_id", content_age(F.col("published"), F.col("discovered")).alias("age"))


@query("""SELECT event_id, CASE WHEN x >= 10 THEN 'big beat' WHEN x >= 2 THEN 'beat' WHEN x > -2 THEN 'in line' WHEN x > -10 THEN 'miss' ELSE 'big miss' END AS bucket FROM (SELECT event_id, value - 50 AS x FROM events)""")
def p10_surprise_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", surprise_bucket(F.col("value") - 50).alias("bucket"))


@query(f"""WITH {_TIMES} SELECT event_id, CASE WHEN published > discovered + INTERVAL 5 MINUTE OR (observer AND published > discovered - INTERVAL 1 MINUTE) THEN NULL ELSE published END AS trusted FROM t""")
def p11_trusted_times(spark, sf_dir):
    return _times(spark, sf_dir).select("event_id", trusted_time(F.col("published"), F.col("discovered"), F.col("observer")).alias("trusted"))


@query(f"""WITH {_TIMES}, n AS (SELECT *, TIMESTAMP '2024-01-20' AS now FROM t) SELECT event_id, CASE WHEN published IS NULL OR published > now THEN 'unknown' WHEN published > now - INTERVAL 24 HOUR THEN 'fresh' WHEN published > now - INTERVAL 7 DAY THEN 'recent' ELSE 'old' END AS class FROM n""")
def p12_staleness(spark, sf_dir):
    return _times(spark, sf_dir).select("event_id", staleness(F.col("published"), F.lit("2024-01-20").cast("timestamp_ntz")).alias("class"))


@query("""WITH n AS (SELECT event_id, ts - INTERVAL 5 HOUR AS ny FROM events), m AS (SELECT *, extract(hour FROM ny) * 60 + extract(minute FROM ny) AS minute FROM n)
SELECT event_id, CASE WHEN extract(dow FROM ny) IN (0, 6) THEN 'weekend' WHEN minute BETWEEN 240 AND 569 THEN 'pre_open' WHEN minute BETWEEN 570 AND 959 THEN 'open' WHEN minute BETWEEN 960 AND 1199 THEN 'post_close' ELSE 'overnight' END AS phase FROM m""")
def p13_market_phase(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", market_phase(F.col("ts")).alias("phase"))


@query("""SELECT c_custkey, CASE WHEN x BETWEEN 0 AND 100 THEN x END AS pe, CASE WHEN x BETWEEN -10 AND 10 THEN x END AS roe FROM (SELECT c_custkey, c_acctbal / 40 AS x FROM customer)""")
def p14_usable_ratios(spark, sf_dir):
    x = F.col("c_acctbal") / 40
    return table(spark, sf_dir, "customer").select("c_custkey", usable("pe", x).alias("pe"), usable("roe", x).alias("roe"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) * 2 >= length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS readable FROM documents""")
def p15_script_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.script_readable(F.col("text")).alias("readable"))


#: Coverage that no reader acts on where it names no company.
MARKET_NOISE = [
    "FTSE", "DAX", "CAC 40", "Nikkei", "Hang Seng", "Euro Stoxx", "Sensex", "Nifty", "52-week (?:high|low)", "moving average cross", "RSI alert", "oversold", "overbought", "intrinsic value",
    "price target (?:raised|cut)", "analyst (?:upgrades|downgrades) stock",
]
_NOISE = r"(?i)\b(?:" + "|".join(MARKET_NOISE) + r")\b"
_ONE = "regexp_extract(text, '" + tx.sentence_pattern(1) + "', 1)"


def market_noise(title: Column, body: Column, names_company: Column) -> Column:
    """Whether a headline or the first sentence behind it is market noise, and no company is named."""
    return ~names_company & F.concat(title, F.lit(". "), tx.first_sentences(body, 1)).rlike(_NOISE)


@query(f"""SELECT doc_id, source <> 'src0' AND regexp_matches(split_part(text, chr(10), 1) || CASE WHEN doc_id % 10 = 0 THEN ' nifty' ELSE '' END || '. ' || CASE WHEN {_ONE} = '' THEN text ELSE {_ONE} END, '{_NOISE}') AS noise FROM documents""")
def p16_market_noise(spark, sf_dir):
    """``src0`` stands for items that name a company; a word of the list is put into every tenth headline."""
    title = F.concat(F.substring_index("text", "\n", 1), F.when(F.col("doc_id") % 10 == 0, " nifty").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", market_noise(title, F.col("text"), F.col("source") == "src0").alias("noise"))


#: Hosts that write for another country's investors, and the names that aggregators give them.
FOREIGN_HOSTS = [
    "livemint.com", "economictimes.indiatimes.com", "timesofindia.indiatimes.com", "indiatimes.com", "economictimes.com", "timesofindia.com", "moneycontrol.com", "business-standard.com",
    "financialexpress.com", "thehindubusinessline.com", "thehindu.com", "ndtv.com", "ndtvprofit.com", "hindustantimes.com", "zeebiz.com", "news18.com", "cnbctv18.com", "businesstoday.in",
    "indiatoday.in", "outlookbusiness.com", "rediff.com", "firstpost.com", "deccanherald.com", "goodreturns.in", "tradebrains.in", "trendlyne.com", "tickertape.in", "angelone.in",
    "zerodha.com", "groww.in", "5paisa.com", "upstox.com", "dsij.in", "equitymaster.com", "investing.com/india", "in.investing.com", "in.tradingview.com", "inc42.com", "entrackr.com", "yourstory.com",
]
FOREIGN_PUBLISHERS = [
    "mint", "livemint", "the economic times", "economic times", "the times of india", "times of india", "moneycontrol", "moneycontrol.com", "business standard", "the financial express",
    "financial express", "the hindu businessline", "businessline", "the hindu", "ndtv profit", "ndtv", "hindustan times", "zee business", "news18", "cnbc tv18", "cnbctv18", "cnbc-tv18",
    "business today", "india today", "outlook business", "rediff", "firstpost", "deccan herald", "goodreturns", "trade brains", "groww", "zerodha", "5paisa", "upstox", "angel one", "dsij",
    "equitymaster", "inc42", "entrackr", "yourstory", "the indian express", "indian express", "financial express - india",
]
_FOREIGN = r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in FOREIGN_HOSTS if "/" not in h) + ")$"
_FOREIGN_PATH = "^(" + "|".join(h.replace(".", r"\.") for h in FOREIGN_HOSTS) + ")/"


def foreign(url: Column, publisher: Column) -> Column:
    """Whether a publisher writes for another market: by the end of its host, by host and path, or by its name."""
    rest = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"(?i)^https?://([^?#]*)", 1)), r"^www\.", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/]*)", 1), r":\d+$", "")
    return host.rlike(r"\.in$") | host.rlike(_FOREIGN) | rest.rlike(_FOREIGN_PATH) | F.lower(F.trim(publisher)).isin(FOREIGN_PUBLISHERS)


_ELSEWHERE = ["https://www.livemint.com/a", "http://sub.thehindu.com:80/b?x", "https://www.investing.com/india/c", "https://investing.com/indian", "https://markets.in/", "https://notndtv.com/d", ""]


@query(f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {_ELSEWHERE}[1 + page_id // 3 % 7] ELSE url END AS url, CASE page_id % 20 WHEN 1 THEN ' The Hindu' WHEN 2 THEN 'Hindu' ELSE '' END AS publisher FROM pages),
r AS (SELECT page_id, publisher, regexp_replace(lower(regexp_extract(trim(url), '(?i)^https?://([^?#]*)', 1)), '^www\\.', '') AS rest FROM u), h AS (SELECT *, regexp_replace(regexp_extract(rest, '^([^/]*)', 1), ':\\d+$', '') AS host FROM r)
SELECT page_id FROM h WHERE NOT (regexp_matches(host, '\\.in$') OR regexp_matches(host, '{_FOREIGN}') OR regexp_matches(rest, '{_FOREIGN_PATH}') OR list_contains({FOREIGN_PUBLISHERS}, lower(trim(publisher))))""")
def p17_foreign_publishers(spark, sf_dir):
    """Pages of foreign publishers go; every third page gets another address, some a publisher's name."""
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.get(F.array(*map(F.lit, _ELSEWHERE)), (F.floor(k / 3) % 7).cast("int"))).otherwise(F.col("url"))
    publisher = F.when(k % 20 == 1, " The Hindu").when(k % 20 == 2, "Hindu").otherwise("")
    return table(spark, sf_dir, "pages").where(~foreign(url, publisher)).select("page_id")


LEVELS = {"none": 0.0, "weak": 0.25, "fair": 0.5, "good": 0.75, "full": 1.0}


def expectation(shares: list[Column], picked: Column | None = None) -> Column:
    """The mean level of a rubric under shares of its levels, which need not add up to 1. If all are 0 or missing, the level
    of the number ``picked``, rounded; 0 if there is no such level. Null without a pick."""
    shares = [F.coalesce(s, F.lit(0.0)) for s in shares]
    total = reduce(Column.__add__, shares)
    worth = reduce(Column.__add__, [s * F.lit(v) for s, v in zip(shares, LEVELS.values())])
    mean = F.when(total > 0, worth / total)
    if picked is None:
        return mean
    level = F.get(F.array(*map(F.lit, LEVELS.values())), F.when(picked >= -0.5, F.floor(picked + 0.5)).otherwise(-1).cast("int"))
    return F.coalesce(mean, level, F.lit(0.0))


@query("""SELECT p_partkey, round(CASE WHEN a + b + c + d + e > 0 THEN (a * 0.0 + b * 0.25 + c * 0.5 + d * 0.75 + e * 1.0) / (a + b + c + d + e) ELSE coalesce(CASE WHEN floor(pick + 0.5) BETWEEN 0 AND 4 THEN floor(pick + 0.5) * 0.25::DOUBLE END, 0) END, 6) AS expectation
FROM (SELECT p_partkey, (p_partkey % 17) / 2.0::DOUBLE AS pick, CAST(p_size % 2 AS DOUBLE) AS a, CAST(p_size % 3 AS DOUBLE) AS b, CAST(p_size % 5 AS DOUBLE) AS c, CAST(p_partkey % 2 AS DOUBLE) AS d, CAST(p_partkey % 3 AS DOUBLE) AS e FROM part)""")
def f_expectation(spark, sf_dir):
    shares = [(F.col(c) % k).cast("double") for c, k in (("p_size", 2), ("p_size", 3), ("p_size", 5), ("p_partkey", 2), ("p_partkey", 3))]
    return table(spark, sf_dir, "part").select("p_partkey", r6("expectation", expectation(shares, F.col("p_partkey") % 17 / 2)))


@query(f"""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part), f AS (SELECT DISTINCT word || unnest(['s', 'ies', 'sses', 'xes', 'is']) AS word FROM w) SELECT word, {tx.stem_sql('word')} AS stem FROM f""")
def f_stem(spark, sf_dir):
    ends = F.explode(F.array(*map(F.lit, ("s", "ies", "sses", "xes", "is")))).alias("end")
    w = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select("w", ends).select(F.concat("w", "end").alias("word")).distinct()
    return w.select("word", tx.stem(F.col("word")).alias("stem"))


@query("""SELECT doc_id, CASE WHEN t1 = '' THEN text ELSE t1 END AS first_one, CASE WHEN t3 = '' THEN text ELSE t3 END AS first_three FROM (SELECT doc_id, text, regexp_extract(text, '""" + tx.sentence_pattern(1) + """', 1) AS t1, regexp_extract(text, '""" + tx.sentence_pattern(3) + """', 1) AS t3 FROM documents)""")
def f_first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.first_sentences(F.col("text"), 1).alias("first_one"), tx.first_sentences(F.col("text"), 3).alias("first_three"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || ' - ' || CASE WHEN n_nationkey % 3 = 1 THEN 'The Paper' ELSE 'today' END END AS title, CAST(round(n_nationkey * 1234.5::DOUBLE, 1) AS DOUBLE) AS loose FROM nation""")
def f_headline_parts(spark, sf_dir):
    """A title without its publisher, and a number in text with separators."""
    k = F.col("n_nationkey")
    title = F.concat("n_name", F.when(k % 3 == 2, " - today").otherwise(" - The Paper"))
    number = F.format_number(k * 1234.5, 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 3 == 1, title).otherwise(tx.strip_publisher(title, F.lit("the paper"))).alias("title"), tx.loose_number(number).alias("loose"))


@query("""WITH r AS (SELECT user_id, bool_or(event_type = 'error') AS retired, bool_or(event_type = 'purchase' AND value > 100) AS live FROM events GROUP BY 1) SELECT user_id FROM r WHERE NOT (retired AND NOT live)""")
def p18_retired_exclusion(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("retired"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("live"))
    return r.where("NOT (retired AND NOT live)").select("user_id")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS period_end, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + 45 END AS report_date FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY period_end DESC, o_orderkey DESC) AS nth FROM p WHERE report_date <= DATE '1999-06-30') SELECT o_custkey, o_orderkey, period_end, nth FROM r WHERE nth <= 4""")
def p19_point_in_time(spark, sf_dir):
    """Only reports that were out by the date; a missing report date never falls back on the period's end."""
    d = F.to_date("o_orderdate")
    p = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", d.alias("period_end"), F.when(F.col("o_orderkey") % 4 > 0, F.date_add(d, 45)).alias("report_date")).where("report_date <= DATE '1999-06-30'")
    return p.withColumn("nth", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("period_end"), F.desc("o_orderkey")))).where("nth <= 4").drop("report_date")


@query("""WITH e AS (SELECT d.doc_id, d.source, d.n_chars FROM documents d), a AS (SELECT doc_id, source, n_chars, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id) AS known FROM e)
SELECT doc_id FROM a WHERE (good OR (source IN ('src1', 'src2', 'src3') AND NOT known)) AND n_chars >= 500""")
def p20_feed_admission(spark, sf_dir):
    """With a good entity, or of a sector-wide source without any entity; of some length."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"))
    d = table(spark, sf_dir, "documents").where("n_chars >= 500").join(lab, "doc_id", "left")
    return d.where(F.coalesce("good", F.lit(False)) | (F.col("source").isin("src1", "src2", "src3") & F.col("good").isNull())).select("doc_id")


@query("""WITH d AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_max(value, ts) AS close FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT symbol, list(close ORDER BY day) AS spark_line, arg_max(close, day) AS last, round((list(close ORDER BY day DESC))[1] / (list(close ORDER BY day DESC))[2] * 100 - 100, 6) AS change_percent FROM d GROUP BY 1""")
def p21_sparklines(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(F.max_by("value", "ts").alias("close"))
    g = d.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "close"))), lambda x: x["close"]).alias("spark_line"))
    last = lambda k: F.element_at("spark_line", -k)
    return g.select("symbol", "spark_line", last(1).alias("last"), r6("change_percent", last(1) / last(2) * 100 - 100))


@query(f"""WITH {_TIMES} SELECT event_id, CASE WHEN published <= discovered AND NOT observer THEN date_diff('second', published, discovered) END AS latency FROM t""")
def p22_discovery_latency(spark, sf_dir):
    s = (F.unix_micros(F.col("discovered").cast("timestamp")) - F.unix_micros(F.col("published").cast("timestamp"))) / 1000000
    return _times(spark, sf_dir).select("event_id", F.when((F.col("published") <= F.col("discovered")) & ~F.col("observer"), F.round(s).cast("long")).alias("latency"))


@query("""WITH c AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS earliest, max(CAST(o_orderdate AS DATE)) AS filed, list_sort(list(DISTINCT o_orderpriority)) AS symbols FROM orders GROUP BY 1)
SELECT o_custkey, filed - earliest AS delay, list_filter(symbols, lambda s: s IN ('1-URGENT', '2-HIGH')) AS resolved, list_filter(symbols, lambda s: s NOT IN ('1-URGENT', '2-HIGH')) AS unresolved FROM c""")
def p23_disclosure_delay(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("earliest"), F.max(F.to_date("o_orderdate")).alias("filed"), F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    known = ["1-URGENT", "2-HIGH"]
    return c.select("o_custkey", F.datediff("filed", "earliest").cast("long").alias("delay"), F.filter("s", lambda x: x.isin(known)).alias("resolved"), F.filter("s", lambda x: ~x.isin(known)).alias("unresolved"))


@query("""SELECT n_name, 'US: ' || n_name AS label, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal < -900 GROUP BY 1""")
def p24_sector_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < -900")
    n = table(spark, sf_dir, "nation")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("members")).withColumn("label", F.concat(F.lit("US: "), F.col("n_name")))


@query("""WITH r AS (SELECT c_custkey, percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS p FROM customer) SELECT c_custkey, CASE WHEN p >= 0.75 THEN 'higher than most peers' WHEN p >= 0.25 THEN 'near the middle' ELSE 'lower than most peers' END AS note FROM r""")
def p25_peer_notes(spark, sf_dir):
    p = F.percent_rank().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal"))
    return table(spark, sf_dir, "customer").withColumn("p", p).select("c_custkey", F.when(F.col("p") >= 0.75, "higher than most peers").when(F.col("p") >= 0.25, "near the middle").otherwise("lower than most peers").alias("note"))


@query("""SELECT p_brand, round(avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3), 3) AS third_moment, round(quantile_cont(x, 0.9), 6) AS q90, list_sort(list(x))[count(*) // 2 + 1] AS upper_median FROM (SELECT p_brand, p_retailprice AS x FROM part) GROUP BY 1""")
def f_scalar_statistics(spark, sf_dir):
    x = F.col("p_retailprice")
    third = F.avg(x * x * x) - 3 * F.avg(x) * F.avg(x * x) + 2 * F.pow(F.avg(x), 3)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(third, 3).alias("third_moment"), r6("q90", F.percentile(x, 0.9)), F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("upper_median"))


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS m, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, round(CASE WHEN n > 1 THEN m / (n - 1) * 2 - 1 ELSE 0 END, 6) AS unit_rank FROM r""")
def f5_unit_rank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6("unit_rank", unit_rank(F.col("p_size"), ["p_brand"])))


@query("""SELECT event_id, round(CASE WHEN m >= 990 OR m < 30 THEN 0.5 ELSE 1 END * (10 * p1 + 20 * p2 + 5 * p3) / 1e6, 9) AS cost FROM (SELECT event_id, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m,
 CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 ELSE 2.0 END AS p1, CASE event_type WHEN 'click' THEN 3.0 ELSE 5.0 END AS p2, CASE event_type WHEN 'click' THEN 7.0 ELSE 9.0 END AS p3 FROM events)""")
def f_token_cost(spark, sf_dir):
    prices = {"click": (1.0, 3.0, 7.0), "view": (2.0, 5.0, 9.0)}
    return table(spark, sf_dir, "events").select("event_id", F.round(token_cost(F.lit(10), F.lit(20), F.lit(5), F.col("event_type"), F.col("ts"), prices), 9).alias("cost"))
