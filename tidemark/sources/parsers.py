"""Parsers of payloads as DataFrames (S7, S10-S18, S20, S21, S26, S27, S29). Bad rows go or turn null; none fails a job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.registry import query, table


def keyed_daily(payloads: DataFrame) -> DataFrame:
    """Daily bars of JSON objects keyed by date (column ``json``): a row without a sound date or price goes, a missing
    volume is 0. A payload that holds a note or error gives no bars."""
    kind = "map<string, map<string, string>>"
    body = F.from_json(F.get_json_object("json", "$['Time Series (Daily)']"), kind)
    rows = payloads.select("symbol", F.explode(body).alias("day", "v"))
    num = lambda k: F.col("v")[k].try_cast("double")
    out = rows.select("symbol", F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).alias("ts"), num("1. open").alias("open"), num("2. high").alias("high"), num("3. low").alias("low"), num("4. close").alias("close"), F.coalesce(num("5. volume"), F.lit(0.0)).alias("volume"))
    return out.where(F.col("ts").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())


def listed_intraday(payloads: DataFrame) -> DataFrame:
    """Bars of JSON with a list of values in any order; times are UTC."""
    kind = "struct<status: string, meta: struct<symbol: string>, `values`: array<map<string, string>>>"
    rows = payloads.select(F.from_json("json", kind).alias("x")).where("x.status = 'ok'").select("x.meta.symbol", F.explode("x.values").alias("v"))
    num = lambda k: F.col("v")[k].try_cast("double").alias(k)
    out = rows.select("symbol", F.try_to_timestamp(F.col("v")["datetime"], F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), num("open"), num("high"), num("low"), num("close"), F.coalesce(F.col("v")["volume"].try_cast("double"), F.lit(0.0)).alias("volume"))
    return out.dropna(subset=["ts", "open", "high", "low", "close"])


_FEED = "title string, link string, description string, publisher string, published string"


def _feed_items(xml: str) -> list[tuple]:
    import html
    import re
    import xml.etree.ElementTree as ET

    keep = {"amp", "lt", "gt", "quot", "apos"}
    clean = re.sub(r"&(\w+);", lambda m: m[0] if m[1] in keep else html.unescape(m[0]), xml or "")
    clean = re.sub(r"&(?!#?\w+;)", "&amp;", clean)
    try:
        root = ET.fromstring(clean)
    except ET.ParseError:
        return []
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for item in root.iter():
        if name(item) not in ("item", "entry"):
            continue
        got: dict = {}
        for e in item:
            text = "".join(e.itertext()).strip()
            if name(e) == "link" and e.get("href"):
                if e.get("rel", "alternate") == "alternate":
                    got.setdefault("link", e.get("href"))
            elif name(e) in ("title", "link"):
                got.setdefault(name(e), text)
            elif name(e) in ("description", "summary", "content"):
                got.setdefault("description", text)
            elif name(e) == "source":
                got.setdefault("publisher", text)
            elif name(e) in ("pubDate", "published", "updated", "date"):
                got.setdefault("published", text)
        if got.get("title") and (got.get("link") or got.get("description")):
            out.append(tuple(got.get(k) for k in ("title", "link", "description", "publisher", "published")))
    return out


def feeds(payloads: DataFrame) -> DataFrame:
    """Items of RSS and Atom texts (column ``xml``): entities are forgiven; an item needs a title and a link or text."""

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ': ') for f in _FEED.split(', ')) }>>")
    def items(xml: pd.Series) -> pd.Series:
        return xml.map(_feed_items)

    rows = payloads.select("source_id", F.inline(items("xml")))
    return rows.withColumn("description", tx.clean_html(F.col("description"))).withColumn("published_at", tx.feed_time(F.col("published"))).drop("published")


def filing_index(lines: DataFrame) -> DataFrame:
    """(form, company, cik, filed, path) of fixed-width index lines, read from the right; lines that don't fit go."""
    rx = r"^(\S.*?)\s{2,}(\S.*?)\s+(\d+)\s+(\d{4}-?\d{2}-?\d{2})\s+(\S+)\s*$"
    part = lambda k: F.regexp_extract("value", rx, k)
    x = lines.where(F.col("value").rlike(rx))
    return x.select(part(1).alias("form"), part(2).alias("company"), F.regexp_replace(part(3), "^0+", "").alias("cik"), F.to_date(F.regexp_replace(part(4), "-", ""), "yyyyMMdd").alias("filed"), part(5).alias("path"))


_FORM4 = """struct<issuer: struct<issuerTradingSymbol: string>, reportingOwner: array<struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, officerTitle: string>>>,
nonDerivativeTable: struct<nonDerivativeTransaction: array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>,
transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>>, ownershipNature: struct<directOrIndirectOwnership: struct<value: string>>>>>>"""


def insider_forms(payloads: DataFrame) -> DataFrame:
    """Trades of insider filings (accession, xml): the first owner, one row a transaction with shares."""
    x = payloads.select("accession", F.from_xml("xml", F.lit(_FORM4.replace("\n", " "))).alias("d"))
    owner = F.get("d.reportingOwner", 0)
    rows = x.select("accession", F.upper("d.issuer.issuerTradingSymbol").alias("symbol"), owner["reportingOwnerId"]["rptOwnerName"].alias("owner"), owner["reportingOwnerRelationship"]["isDirector"].isin("1", "true").alias("director"), F.posexplode("d.nonDerivativeTable.nonDerivativeTransaction").alias("line", "t"))
    shares, price = tx.loose_number(F.col("t.transactionAmounts.transactionShares.value")), tx.loose_number(F.col("t.transactionAmounts.transactionPricePerShare.value"))
    out = rows.select("accession", "line", "symbol", "owner", "director", F.to_date("t.transactionDate.value").alias("tx_date"), F.col("t.transactionCoding.transactionCode").alias("code"), shares.alias("shares"), price.alias("price"), (F.col("t.ownershipNature.directOrIndirectOwnership.value") == "D").alias("direct"))
    return out.where("shares > 0").withColumn("value", F.when(F.col("price") > 0, F.col("price") * F.col("shares")))


def holdings_tables(payloads: DataFrame) -> DataFrame:
    """Positions of holdings tables (accession, xml), summed by (cusip, put_call); other amounts than shares go."""
    kind = "struct<infoTable: array<struct<nameOfIssuer: string, cusip: string, value: string, putCall: string, shrsOrPrnAmt: struct<sshPrnamt: string, sshPrnamtType: string>>>>"
    x = payloads.select("accession", F.explode(F.from_xml("xml", F.lit(kind))["infoTable"]).alias("t"))
    keep = x.where(F.coalesce("t.shrsOrPrnAmt.sshPrnamtType", F.lit("")).isin("SH", ""))
    return keep.groupBy("accession", F.upper("t.cusip").alias("cusip"), F.coalesce("t.putCall", F.lit("")).alias("put_call")).agg(F.min("t.nameOfIssuer").alias("issuer"), F.sum(tx.loose_number(F.col("t.value"))).alias("value"), F.sum(tx.loose_number(F.col("t.shrsOrPrnAmt.sshPrnamt"))).alias("shares"))


def quarterly_trades(submissions: DataFrame, owners: DataFrame, trades: DataFrame) -> DataFrame:
    """The three tables of a quarterly bundle: first owner of each filing; lines count all its rows, then only purchases
    and sales stay."""
    first = owners.withColumn("r", F.row_number().over(Window.partitionBy("accession").orderBy("seq"))).where("r = 1").select("accession", "owner")
    line = F.row_number().over(Window.partitionBy("accession").orderBy("seq"))
    t = trades.withColumn("line", line).where(F.col("code").isin("P", "S")).withColumn("tx_date", F.coalesce(F.try_to_timestamp("date", F.lit("dd-MMM-yyyy")).cast("date"))).drop("date", "seq")
    return t.join(submissions, "accession").join(first, "accession", "left")


def disclosed_tickers(texts: DataFrame) -> DataFrame:
    """Tickers in parentheses of a report's text, distinct and sorted, and its earliest date."""
    found = F.regexp_extract_all("text", F.lit(r"\(([A-Z]{1,5})\)"), F.lit(1))
    dates = F.transform(F.regexp_extract_all("text", F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1)), lambda d: F.try_to_timestamp(d, F.lit("MM/dd/yyyy")).cast("date"))
    return texts.select("doc", F.array_except(F.array_sort(F.array_distinct(found)), F.array(F.lit("ST"), F.lit("OT"), F.lit("NEW"))).alias("symbols"), F.array_min(dates).alias("earliest"))


def reference_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A reference table with headers in upper case; malformed rows and rows without a required value go, and of rows with
    one first required value the least in order of columns stays."""
    raw = spark.read.csv(path, header=True, mode="DROPMALFORMED")
    rows = raw.toDF(*[c.strip().upper() for c in raw.columns]).dropna(subset=required)
    return rows.groupBy(required[0]).agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")


def original_filings(filings: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` unamended holdings reports of parallel arrays (form, accession, filed) of each filer."""
    rows = filings.select("cik", F.inline(F.arrays_zip("form", "accession", "filed"))).where("form = '13F-HR'")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession")))).where(F.col("r") <= n).drop("r")


@query("""SELECT user_id AS symbol, date_trunc('day', ts) AS ts, max(value) AS high, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE count(*)::DOUBLE END AS volume FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2""")
def s7_vendor_json(spark, sf_dir):
    """Bars written as vendor JSON, every third symbol without volume and every seventh with an unreadable price."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("m"), F.count("*").alias("n"))
    price = F.col("m").cast("string")
    bar = F.create_map(*[x for k, v in {"1. open": price, "2. high": F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(price), "3. low": price, "4. close": price, "5. volume": F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("n").cast("string"))}.items() for x in (F.lit(k), v)])
    series = F.map_from_entries(F.collect_list(F.struct("day", bar)))
    payload = e.groupBy("user_id").agg(F.to_json(F.create_map(F.lit("Time Series (Daily)"), series)).alias("json")).withColumnRenamed("user_id", "symbol")
    return keyed_daily(payload).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "high", "volume")


@query("""SELECT source AS source_id, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'https://x.test/' || doc_id END AS link, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 10:00:00' + to_seconds(doc_id) END AS published_at FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def s10_s11_feed_items(spark, sf_dir):
    """Documents written as feeds and read back; items without link and text go, unreadable times are null."""
    d = table(spark, sf_dir, "documents")
    when = F.date_format(F.timestamp_seconds(F.lit(1704103200) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(F.lit("<item><title>T"), F.col("doc_id"), F.lit("</title>"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<link>https://x.test/"), F.col("doc_id"), F.lit("</link>"))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, "<description>a &amp; b&nbsp;c</description>").otherwise(""), F.lit("<pubDate>"), F.when(F.col("doc_id") % 5 == 0, "soon").otherwise(when), F.lit("</pubDate></item>"))
    feed = d.groupBy("source", (F.col("doc_id") % 40).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return feeds(feed.select(F.col("source").alias("source_id"), "xml")).select("source_id", "title", "link", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) > 0 AS has_text FROM pages""")
def s12_clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.length(tx.clean_html(F.col("html"))) > 0).alias("has_text"))


@query("""SELECT 'FORM ' || (o_orderkey % 3) AS form, 'Company ' || o_custkey AS company, CAST(o_custkey + 1 AS VARCHAR) AS cik, CAST(o_orderdate AS DATE) AS filed, 'edgar/' || o_orderkey || '.txt' AS path FROM orders""")
def s14_filing_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.rpad(F.concat(F.lit("FORM "), F.col("o_orderkey") % 3), 12, " "), F.rpad(F.concat(F.lit("Company "), F.col("o_custkey")), 30, " "), F.lpad((F.col("o_custkey") + 1).cast("string"), 10, "0"), F.lit("  "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  edgar/"), F.col("o_orderkey"), F.lit(".txt"))
    noise = spark.createDataFrame([("-----",), ("Form Type   Company Name",)], "value string")
    return filing_index(o.select(line.alias("value")).union(noise))


@query("""SELECT o_orderkey AS accession, 'S' || o_custkey AS symbol, 'Owner ' || o_custkey AS owner, o_custkey % 2 = 0 AS director, (o_orderkey % 50)::DOUBLE AS shares, CASE WHEN o_custkey % 3 > 0 THEN ((o_custkey % 3) * (o_orderkey % 50))::DOUBLE END AS value FROM orders WHERE o_orderkey % 50 > 0""")
def s15_insider_forms(spark, sf_dir):
    """Orders written as filings of one transaction and read back; those without shares go."""
    o = table(spark, sf_dir, "orders")
    xml = F.format_string("<ownershipDocument><issuer><issuerTradingSymbol>s%d</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Owner %d</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>%d</isDirector></reportingOwnerRelationship></reportingOwner><reportingOwner><reportingOwnerId><rptOwnerName>Second</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>%d</value></transactionShares><transactionPricePerShare><value>%d</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>", "o_custkey", "o_custkey", (F.col("o_custkey") % 2 == 0).cast("int"), F.col("o_orderkey") % 50, F.col("o_custkey") % 3)
    return insider_forms(o.select(F.col("o_orderkey").alias("accession"), xml.alias("xml"))).select("accession", "symbol", "owner", "director", "shares", "value")


@query("""SELECT l_suppkey AS accession, 'C' || l_partkey AS cusip, '' AS put_call, CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS value, CAST(sum(l_quantity) AS DOUBLE) AS shares FROM lineitem WHERE l_linenumber < 6 GROUP BY 1, 2""")
def s16_holdings_tables(spark, sf_dir):
    row = F.format_string("<infoTable><nameOfIssuer>x</nameOfIssuer><cusip>c%d</cusip><value>%d</value><shrsOrPrnAmt><sshPrnamt>%d</sshPrnamt><sshPrnamtType>%s</sshPrnamtType></shrsOrPrnAmt></infoTable>", "l_partkey", F.floor("l_extendedprice"), F.col("l_quantity").cast("long"), F.when(F.col("l_linenumber") < 6, "SH").otherwise("PRN"))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("accession")).agg(F.concat(F.lit("<informationTable>"), F.array_join(F.collect_list(row), ""), F.lit("</informationTable>")).alias("xml"))
    return holdings_tables(docs).select("accession", "cusip", "put_call", "value", "shares")


@query("""WITH t AS (SELECT o_custkey AS accession, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'G' END AS code, o_totalprice AS price, CAST(o_orderdate AS DATE) AS tx_date FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY seq) AS line FROM t) SELECT accession, line, code, price, tx_date, c_mktsegment AS symbol, 'first' AS owner FROM l JOIN customer ON c_custkey = accession WHERE code IN ('P', 'S')""")
def s17_quarterly_bundle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("G")
    trades = o.select(F.col("o_custkey").alias("accession"), F.col("o_orderkey").alias("seq"), code.alias("code"), F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "dd-MMM-yyyy").alias("date"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("accession"), F.col("c_mktsegment").alias("symbol"))
    owners = c.select("accession", F.lit(1).alias("seq"), F.lit("first").alias("owner")).union(c.select("accession", F.lit(2), F.lit("second")))
    return quarterly_trades(c, owners, trades)


@query("""SELECT c_custkey AS doc, list_sort(list_distinct(['AB' || chr(CAST(65 + c_custkey % 26 AS INT)), 'ZZ'])) AS symbols, DATE '2024-01-02' + CAST(c_custkey % 9 AS INT) AS earliest FROM customer""")
def s18_disclosed_tickers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    day = F.date_format(F.date_add(F.lit("2024-01-02").cast("date"), (F.col("c_custkey") % 9).cast("int")), "MM/dd/yyyy")
    text = F.concat(F.lit("Sold (AB"), F.char(65 + F.col("c_custkey") % 26), F.lit(") [ST] (ST) on "), day, F.lit(" and (ZZ), (ZZ) on 12/30/2024"))
    return disclosed_tickers(c.select(F.col("c_custkey").alias("doc"), text.alias("text")))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS period FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS announced FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, period, min(announced) AS report_date FROM p LEFT JOIN a ON a.o_custkey = p.o_custkey AND announced >= period AND announced <= period + 190 GROUP BY 1, 2""")
def s21_report_dates(spark, sf_dir):
    """The first announcement within 190 days of a period's end; an equi-join on buckets of that length."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    b = lambda c: F.floor(F.unix_date(c) / 191)
    p = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("d").alias("period"))
    a = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("d").alias("announced"), b(F.col("d")).alias("k"))
    hit = p.withColumn("k", F.explode(F.array(b(F.col("period")), b(F.col("period")) + 1))).join(a, ["o_custkey", "k"]).where((F.col("announced") >= F.col("period")) & (F.col("announced") <= F.date_add("period", 190)))
    return p.join(hit.groupBy("o_orderkey").agg(F.min("announced").alias("report_date")), "o_orderkey", "left").groupBy("o_orderkey", "period").agg(F.min("report_date").alias("report_date"))


@query("""WITH f AS (SELECT o_custkey AS cik, CASE o_orderkey % 3 WHEN 0 THEN '13F-HR/A' ELSE '13F-HR' END AS form, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS r FROM f WHERE form = '13F-HR') SELECT cik, form, accession, filed FROM r WHERE r <= 2""")
def s26_original_filings(spark, sf_dir):
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct(F.when(F.col("o_orderkey") % 3 == 0, "13F-HR/A").otherwise("13F-HR").alias("form"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"))).alias("x"))
    return original_filings(x.select("cik", F.col("x.form").alias("form"), F.col("x.accession").alias("accession"), F.col("x.filed").alias("filed")), 2)


@query("""SELECT DISTINCT o_orderkey AS accession, o_custkey AS cik FROM orders JOIN customer ON c_custkey = o_custkey WHERE extract(dow FROM o_orderdate) BETWEEN 1 AND 5 AND o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def s27_insider_selection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND weekday(o_orderdate) < 5").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("cik"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"))
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("accession"))
    return o.join(known, "cik", "left_semi").dropDuplicates(["accession"]).join(seen, "accession", "left_anti").select("accession", "cik")


@query("""SELECT source AS source_id, sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE doc_id % 10 < 8 GROUP BY 1, 2
UNION ALL SELECT source, sha256(text), min(doc_id) FROM documents d WHERE doc_id % 10 >= 8 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 10 < 8 AND e.source = d.source AND e.text = d.text) GROUP BY 1, 2""")
def s19_raw_item_sink(spark, sf_dir):
    """A stored table and a new batch: what is there already isn't put in again."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    first = lambda x: x.groupBy("source_id", "content_hash").agg(F.min("doc_id").alias("doc_id"))
    stored = first(d.where("doc_id % 10 < 8"))
    return stored.unionByName(first(d.where("doc_id % 10 >= 8")).join(stored, ["source_id", "content_hash"], "left_anti"))


@query("""WITH h AS (SELECT l_suppkey AS fund, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, l_partkey AS cusip, l_orderkey AS filing, l_quantity FROM lineitem),
m AS (SELECT fund, period, max(filing) AS filing FROM h GROUP BY 1, 2) SELECT fund, period, filing, count(*) AS positions, CAST(sum(l_quantity) AS BIGINT) AS shares FROM h JOIN m USING (fund, period, filing) GROUP BY 1, 2, 3""")
def s28_newest_filing(spark, sf_dir):
    """The newer filing of a fund and quarter replaces the older."""
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("fund"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("period"), F.col("l_orderkey").alias("filing"), "l_quantity")
    g = h.groupBy("fund", "period", "filing").agg(F.count("*").alias("positions"), F.sum("l_quantity").cast("long").alias("shares"))
    return g.groupBy("fund", "period").agg(F.max(F.struct("filing", "positions", "shares")).alias("x")).select("fund", "period", "x.*")


@query("""WITH a AS (SELECT event_id, ts, event_type FROM events), h AS (SELECT * FROM a WHERE ts < TIMESTAMP '2024-01-10'), w AS (SELECT * FROM a WHERE ts >= TIMESTAMP '2024-01-10')
SELECT * FROM (SELECT event_id, ts, event_type, 'cold' AS tier FROM h UNION ALL SELECT event_id, ts, event_type, 'hot' FROM w) WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 400""")
def s22_time_tiers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").withColumn("tier", F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), "cold").otherwise("hot"))
    cold, hot = e.where("tier = 'cold'"), e.where("tier = 'hot'")
    return cold.unionByName(hot).where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(400)


@query("""WITH s AS (SELECT c_custkey AS symbol, unnest([1, 2, 3]) AS as_of, c_acctbal AS base FROM customer), r AS (SELECT symbol, as_of, base * as_of AS v FROM s WHERE (symbol + as_of) % 4 <> 0)
SELECT symbol, max(as_of) AS as_of, round(arg_max(v, as_of), 2) AS v FROM r GROUP BY 1""")
def s30_latest_snapshot(spark, sf_dir):
    """Snapshots are only appended; the latest of a symbol is read."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("as_of"), "c_acctbal")
    r = s.where("(symbol + as_of) % 4 <> 0").withColumn("v", F.col("c_acctbal") * F.col("as_of"))
    return r.groupBy("symbol").agg(F.max("as_of").alias("as_of"), F.round(F.max_by("v", "as_of"), 2).alias("v"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 100 ELSE CAST(n_chars % 90 AS INT) END AS trust FROM documents WHERE contains(lower(text), 'the') AND doc_id >= (SELECT max(doc_id) - 450 FROM documents)""")
def s25_own_archive(spark, sf_dir):
    """Search in the newest items; official ones have full trust."""
    d = table(spark, sf_dir, "documents")
    most = F.broadcast(d.agg(F.max("doc_id").alias("most")))  # one row
    return d.join(most).where((F.col("doc_id") >= F.col("most") - 450) & F.contains(F.lower("text"), F.lit("the"))).select("doc_id", F.when(F.col("doc_id") % 3 == 0, 100).otherwise((F.col("n_chars") % 90).cast("int")).alias("trust"))


def aggregator_json(payloads: DataFrame, foreign: list[str]) -> DataFrame:
    """Articles of an aggregator's JSON; an empty body gives none, hosts on the list go, dates are YYYYMMDDThhmmssZ."""
    x = payloads.select(F.from_json("json", "struct<articles: array<struct<url: string, title: string, domain: string, seendate: string>>>").alias("x")).select(F.inline("x.articles"))
    return x.where(~F.lower("domain").isin(foreign)).select("url", "title", "domain", F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmssX")).alias("seen_at"))


@query("""SELECT 'https://h' || page_id % 5 || '.test/' || page_id AS url, 'P' || page_id AS title, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id % 700 AS INT)) AS seen_at FROM pages WHERE page_id % 5 <> 3""")
def s13_aggregator_json(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 700 * 3600), "yyyyMMdd'T'HHmmss'Z'")
    host = F.concat(F.lit("h"), F.col("page_id") % 5, F.lit(".test"))
    article = F.struct(F.concat(F.lit("https://"), host, F.lit("/"), F.col("page_id")).alias("url"), F.concat(F.lit("P"), F.col("page_id")).alias("title"), host.alias("domain"), at.alias("seendate"))
    j = p.groupBy((F.col("page_id") % 20).alias("k")).agg(F.to_json(F.struct(F.collect_list(article).alias("articles"))).alias("json"))
    got = aggregator_json(j.select("json").union(spark.createDataFrame([("",), (None,)], "json string")), ["h3.test"])
    return got.select("url", "title", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))


@query("""SELECT 'page' AS origin, 'p' || page_id AS id, 50 AS trust FROM pages UNION ALL SELECT 'document', 'd' || doc_id, CASE WHEN source = 'src0' THEN 100 ELSE 60 END FROM documents UNION ALL SELECT 'benchmark', 'b' || item_id, 80 FROM benchmark""")
def s24_findings(spark, sf_dir):
    """Connectors behind one shape of rows."""
    part = lambda t, origin, key, trust: table(spark, sf_dir, t).select(F.lit(origin).alias("origin"), F.concat(F.lit(origin[0]), F.col(key)).alias("id"), trust.alias("trust"))
    return part("pages", "page", "page_id", F.lit(50)).union(part("documents", "document", "doc_id", F.when(F.col("source") == "src0", 100).otherwise(60))).union(part("benchmark", "benchmark", "item_id", F.lit(80)))


@query("""SELECT p_partkey AS symbol, CASE WHEN p_size BETWEEN 0 AND 40 THEN p_size::DOUBLE END AS pe, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 3 = 0 THEN 'annual' ELSE 'quarter' END AS period_type FROM part""")
def s29_wire_fundamentals(spark, sf_dir):
    """A snapshot from JSON: fields renamed, ratios out of bounds null."""
    p = table(spark, sf_dir, "part")
    j = p.select(F.to_json(F.struct(F.col("p_partkey").alias("ticker"), F.struct(F.col("p_size").alias("trailingPE"), F.round("p_retailprice", 2).alias("currentPrice")).alias("info"), F.when(F.col("p_partkey") % 3 == 0, "annual").otherwise("quarter").alias("kind"))).alias("json"))
    x = j.select(F.from_json("json", "struct<ticker: long, info: struct<trailingPE: double, currentPrice: double>, kind: string>").alias("x"))
    return x.select(F.col("x.ticker").alias("symbol"), F.when(F.col("x.info.trailingPE").between(0, 40), F.col("x.info.trailingPE")).alias("pe"), F.col("x.info.currentPrice").alias("price"), F.col("x.kind").alias("period_type"))


@query("""SELECT c_custkey, c_mktsegment, 'new' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 'old' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def s31_dimension_upsert(spark, sf_dir):
    """Calendar rows: new ones replace old ones of their key, others stay."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new, old = c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("new")), c.where("c_custkey % 3 = 0").withColumn("origin", F.lit("old"))
    return new.unionByName(old.join(new, "c_custkey", "left_anti"))


@query("""SELECT upper(r_name) AS symbol, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def s20_reference_join(spark, sf_dir):
    """Reference rows joined to a list, unmatched dropped, the first of a key kept; CSV files go through reference_csv."""
    n = table(spark, sf_dir, "nation").dropDuplicates(["n_nationkey"])
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.upper("r_name").alias("symbol"))
    return n.join(r, "n_regionkey").groupBy("symbol").agg(F.count("*").alias("nations"))


@query("""SELECT r_name AS symbol FROM region""")
def s9_synthetic_bars(spark, sf_dir):
    """Symbols whose walks give the same bars twice, all of them sound."""
    from tidemark.sources.bars import random_walk, valid

    names = [r[0] for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five rows
    a, b = (random_walk(spark, names, 50) for _ in range(2))
    return a.intersectAll(b).where(valid()).groupBy("symbol").count().where("count = 50").select("symbol")
