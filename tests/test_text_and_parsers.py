"""Text functions, parsers, clustering and streams on small inputs."""

import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import ORACLE_SQL, QUERIES
from tidemark.functions import predicates as pr
from tidemark.functions import text as tx
from tidemark.operators import ledger, text_events
from tidemark.operators.market import Screen
from tidemark.sources import bars, parsers
from tidemark.streaming import stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://www.Example.com:80/a/?utm_source=x&b=2&a=1#top", "https://example.com/a?a=1&b=2"),
        ("https://example.com/", "https://example.com"),
        ("ftp://x", None),
        (None, None),
        ("https://m.site.org?ref=q", "https://m.site.org"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, tx.canonical_url(F.lit(url).cast("string"))) == want


def test_small_text_functions(spark):
    assert value(spark, tx.strip_publisher(F.lit("Big news - The Paper"), F.lit("the paper"))) == "Big news"
    assert value(spark, tx.strip_publisher(F.lit("Big news - today"), F.lit("The Paper"))) == "Big news - today"
    assert value(spark, tx.pipe_facts(F.lit("agency: EPA | Type: Rule: final | junk"))) == {"AGENCY": "EPA", "TYPE": "Rule: final"}
    assert value(spark, tx.loose_number(F.lit("1,234.5%"))) == 1234.5 and value(spark, tx.loose_number(F.lit("n/a"))) is None
    assert [value(spark, tx.stem(F.lit(w))) for w in ("companies", "matches", "shares", "gas", "boss", "houses", "analysis", "status", "losses", "ties", "boxes")] == [
        "company", "match", "share", "gas", "boss", "house", "analysis", "status", "loss", "tie", "box"]
    assert value(spark, tx.title_key(F.lit("The of a"))) == ""
    assert value(spark, tx.title_key(F.lit("Acme buys Bolt"))) == value(spark, tx.title_key(F.lit("BOLT: buys, acme!")))
    assert value(spark, tx.company_key(F.lit("The Acme & Sons Holdings, Inc."))) == "acme and sons"
    assert str(value(spark, tx.feed_time(F.lit("Mon, 01 Jan 2024 10:00:00 +0000")).cast("timestamp_ntz"))) == "2024-01-01 10:00:00"
    assert value(spark, tx.feed_time(F.lit("soon"))) is None
    assert value(spark, tx.clean_html(F.lit("<p>a &amp; b</p><br/>c"))) == "a & b c"


def test_kleene_and_buckets(spark):
    assert value(spark, F.lit(None).cast("boolean") & F.lit(False)) is False
    assert [value(spark, pr.surprise_bucket(F.lit(float(x)))) for x in (10, 2, 0, -2, -10)] == ["big beat", "beat", "in line", "miss", "big miss"]
    assert value(spark, pr.usable("pe", F.lit(101.0))) is None
    assert value(spark, pr.half_away(F.lit(float("nan")), 2)) == 0


def test_market_phase_keeps_to_daylight_saving(spark):
    at = lambda t: value(spark, pr.market_phase(F.lit(t).cast("timestamp_ntz")))
    assert at("2024-01-03 14:29:00") == "pre_open" and at("2024-01-03 14:30:00") == "open" and at("2024-07-03 13:30:00") == "open"
    assert at("2024-01-06 15:00:00") == "weekend" and at("2024-01-03 21:00:00") == "post_close"


def test_vendor_json(spark):
    dirty = {"Time Series (Daily)": {"2024-01-02": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2", "5. volume": ""}, "2024-01-03": {"1. open": "1", "2. high": "", "3. low": "1", "4. close": "2", "5. volume": "5"}, "bad": {"1. open": "1", "2. high": "1", "3. low": "1", "4. close": "1", "5. volume": "5"}}}
    df = spark.createDataFrame([("A", json.dumps(dirty)), ("B", '{"Note": "slow down"}'), ("C", None)], "symbol string, json string")
    got = parsers.keyed_daily(df).collect()
    assert [(r.symbol, str(r.ts)[:10], r.volume) for r in got] == [("A", "2024-01-02", 0.0)]


def test_intraday_json(spark):
    x = {"meta": {"symbol": "A"}, "status": "ok", "values": [{"datetime": "2024-01-02 10:05:00", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "7"}, {"datetime": "x", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "7"}]}
    df = spark.createDataFrame([(json.dumps(x),), ('{"status": "error"}',)], "json string")
    assert [(r.symbol, r.volume) for r in parsers.listed_intraday(df).collect()] == [("A", 7.0)]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &nbsp; B</title><link>https://x/1</link><source>Paper</source><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>none</title></item><item><link>https://x/2</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="https://x/self"/><link rel="alternate" href="https://x/3"/></entry></feed>'
    df = spark.createDataFrame([("s", rss), ("s", atom), ("s", "not xml"), ("s", None)], "source_id string, xml string")
    got = {r.link: r for r in parsers.feeds(df).collect()}
    assert set(got) == {"https://x/1", "https://x/3"} and got["https://x/1"].publisher == "Paper"
    assert got["https://x/1"].published_at is not None and got["https://x/3"].published_at is None


def test_columnar_wire(spark):
    rows = [("A", [20240102, 20240103], [1.0, 5.0], [2.0, 4.0], [1.0, 1.0], [2.0, 2.0], [10, 10]), ("B", [20240102], [1.0], [2.0], [1.0], [], [1])]
    df = spark.createDataFrame(rows, "symbol string, t array<int>, o array<double>, h array<double>, l array<double>, c array<double>, v array<int>")
    assert [(r.symbol, str(r.session)) for r in bars.from_columns(df).collect()] == [("A", "2024-01-02")]


def test_reference_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("symbol,name\nA,Acme\nA,Again\n,None\nB,Bolt\n")
    assert {r.SYMBOL for r in parsers.reference_csv(spark, str(p), ["SYMBOL"]).collect()} == {"A", "B"}


def test_article_text():
    title, body = text_events.article_text("<html><head><title>T  x</title><script>no</script></head><body><nav>menu</nav><article><p>One</p><p>Two &amp; three</p></article><div>short</div></body></html>")
    assert title == "T x" and body == "One\nTwo & three"
    assert text_events.article_text("<p>plain</p>") == ("", "plain") and text_events.article_text(None) == ("", "")


def test_clusters(spark):
    rows = [(1, "en", "Acme buys Bolt today", ""), (5, "en", "Acme buys Bolt today again", ""), (9, "en", "Weather turns cold", ""), (300, "en", "Acme buys Bolt today", ""), (6, "fr", "Acme buys Bolt today", ""), (7, "en", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, title string, body string")
    assert {r.doc_id: r.parent for r in text_events.clusters(df, 200, 0.55).collect()} == {1: 1, 5: 1, 9: 9, 300: 300, 6: 6, 7: 7}


def test_clusters_lose_no_pair(spark):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, pick.choice(("en", "fr")), " ".join(pick.sample(words[: pick.choice((12, 20, 60))], pick.choice((1, 2, 5, 9, 11, 20)) % 13 or 12)), "") for k in range(250)]
    common = [f"c{k}" for k in range(9)]  # Jaccard 9 / 15, but the rarest tokens differ
    rows += [(1000, "en", " ".join([*common, "x1", "x2", "x3"]), ""), (1001, "en", " ".join(["y1", "y2", "y3", *common]), "")]
    rows += [(1200 + k, "en", " ".join([*common, f"z{k}"]), "") for k in range(4)]
    both = [f"b{k}" for k in range(11)]  # 11 / 20 is the threshold itself
    rows += [(2000, "en", " ".join([*both, *(f"e{k}" for k in range(9))]), ""), (2001, "en", " ".join(both), "")]
    sets = {r[0]: (r[1], set(r[2].split())) for r in rows}
    want = {}
    for i, (lang, s) in sets.items():
        met = [(-len(s & t) / len(s | t), p) for p, (other, t) in sets.items() if other == lang and p < i <= p + 90 and len(s & t) / len(s | t) >= 0.55]
        want[i] = min(met)[1] if met else i
    assert want[1001] == 1000 and want[2001] == 2000 and sum(i != p for i, p in want.items()) > 40
    df = spark.createDataFrame(rows, "doc_id long, lang string, title string, body string")
    assert {r.doc_id: r.parent for r in text_events.clusters(df, 90, 0.55).collect()} == want


def test_clusters_read_whole_first_lines(spark, tmp_path):
    same = " ".join(f"word{k}" for k in range(30))  # over 200 characters
    rows = [(1, "en", "s", same + "".join(f" a{k}" for k in range(90)) + "\nx"), (2, "en", "s", same + "".join(f" b{k}" for k in range(90)) + "\nx"), (3, "en", "s", same + "".join(f" b{k}" for k in range(90)))]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.parent for r in text_events.t4_clusters(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 2}


def test_classes_equal_sql_beside_letters_of_any_script(spark, tmp_path):
    phrases = [p for _, _, ps in text_events.CLASSES for p in ps]
    plain = ["war", "sues", "fined", "bond issue", "sells big k\u212a stake", "raises $5", "raises $\u00e9", "stock split", "CEO quits", "Fed hikes", "exits its stake", "bid\u0131ng", "L1 b\u0130dder", "credit rating", "bank sell\u017f its stake"]
    edges = ["", " ", "\u00e9", "_", "7", "\u0301", "\u017f", "\u212a", "\u0416", "\u2028", "\r", "-", "a", "\u200d", "\u0660"]
    words = [*plain, *(w.replace("s", "\u017f").replace("k", "\u212a") for w in plain), *(p for p in phrases if p.replace(" ", "").isalpha())]
    texts = [f"Caf\u00e9 {a}{w}{b} x. {c}{w}" for k, w in enumerate(words) for a in edges for b, c in [(edges[k % 15], edges[(k * 7 + 3) % 15]), (" ", "\u00e9"), ("\u00e9", "")]]
    texts += [f"Title\n{a}{w}{a}. b. war" for w in plain for a in edges] + ["\u0416\u0416\u0416 \u043c\u0438\u0440 fined", "\u0397\u0398\u03a3 \u03ba\u03b1\u03b9", "", None]
    rows = [(k, "en", f"s{k % 3}", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("t9_keyword_classes", "t16_t35_replay"):
        cur = con.execute(ORACLE_SQL[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*[c[0] for c in cur.description]).collect()
        got, want = set(map(tuple, got)), set(cur.fetchall())
        assert (got - want, want - got) == (set(), set()), name


def test_screens_reject_what_is_not_one():
    for bad in ('{"conditions": [{"field": "x; drop", "op": ">", "value": 1}]}', '{"conditions": [{"field": "volume", "op": "=", "value": 1}]}', '{"match": "some"}', '{"sort_by": "name"}', '{"other": 1}', '{"limit": -1}'):
        with pytest.raises(ValueError):
            Screen.parse(bad)
    assert Screen.parse('{"limit": 9999}').limit == 750


@pytest.mark.parametrize("side,kind,limit,stop,bar,want", [
    ("buy", "limit", 9900, 0, (10100, 10200, 10000, 10100), None), ("buy", "limit", 9900, 0, (10100, 10200, 9800, 10000), 9900), ("buy", "limit", 9900, 0, (9700, 9800, 9600, 9700), 9700),
    ("sell", "stop", 0, 9500, (9700, 9800, 9400, 9500), 9495), ("sell", "stop", 0, 9500, (9000, 9200, 8900, 9000), 8995), ("sell", "stop", 0, 9500, (9700, 9800, 9600, 9700), None),
    ("buy", "market", 0, 0, (9700, 9800, 9600, 9790), 9795), ("sell", "market", 0, 0, (1, 1, 1, 1), 1),
    ("buy", "stop_limit", 10100, 10000, (10200, 10300, 10000, 10200), 10100), ("buy", "stop_limit", 10100, 10400, (10200, 10300, 10000, 10200), None),
    ("sell", "stop_limit", 9400, 9500, (9300, 9600, 9200, 9300), 9400), ("buy", "stop_limit", 10100, 10000, (10200, 10300, 10150, 10200), None),
])
def test_fills(spark, side, kind, limit, stop, bar, want):
    df = spark.createDataFrame([(side, kind, limit, stop, *bar)], "side string, kind string, limit long, stop long, open long, high long, low long, close long")
    assert df.select(ledger.fill_price(*map(F.col, ("side", "kind", "limit", "stop"))).alias("p")).first().p == want


@pytest.mark.parametrize("title,body,want", [
    ("Acme files for chapter 11 as CEO quits", "", ("INSOLVENCY", 10, 0.6)),
    ("Acme cuts its full-year earnings guidance", "", ("GUIDANCE", 8, 0.6)),
    ("Acme speaks", "Nothing here. It wins an order today. Later a lawsuit.", ("ORDER_WIN", 8, 0.45)),
    ("Acme speaks", "One. Two. Three lawsuit.", ("UNCLASSIFIED", 3, 0.0)),
    ("Acme in a deal", "A merger of v2.0 makers and more of it", ("MERGER", 9, 0.45)),
    ("Postwar compact", "", ("UNCLASSIFIED", 3, 0.0)),
])
def test_headline_classes(spark, title, body, want):
    df = spark.createDataFrame([(title, body)], "title string, body string")
    assert tuple(df.select(text_events.classified(F.col("title"), F.col("body")).alias("c")).first().c) == want


def test_first_sentences(spark):
    of = lambda t, n: value(spark, tx.first_sentences(F.lit(t), n))
    assert of("One. Two.\nThree. Four", 2) == "One. Two." and of("v1.0 is out. Yes", 1) == "v1.0 is out." and of("no stop", 1) == "no stop" and of("end.", 1) == "end."


def test_slippage_goes_against_the_trader(spark):
    assert value(spark, ledger.slipped(F.lit(10000), F.lit("buy"), 5)) == 10005 and value(spark, ledger.slipped(F.lit(10000), F.lit("sell"), 5)) == 9995


def test_stream_state_carries_over_batches():
    one = pd.DataFrame({"event_type": ["a"] * 3, "ts": pd.date_range("2024-01-01", periods=3, freq="h"), "value": [1.0, 1.0, 2.0]})
    state, rows = stream.changed(None, one)
    assert rows["value"].tolist() == [1.0, 2.0]
    state, rows = stream.changed(state, one.assign(value=[2.0, 3.0, 3.0]))
    assert rows["value"].tolist() == [3.0] and state == (3.0,)
    step = stream.cooling(1.5)
    state, rows = step(None, one)
    assert len(rows) == 2 and len(step(state, one)[1]) == 0


def test_a_key_takes_a_byte_a_row_in_a_stateful_stream(spark, tmp_path):
    at = [f"2024-01-01 00:00:0{k}" for k in (3, 1, 2)]
    rows = [(k, a, name) for k, (a, name) in enumerate((a, n) for n in ("x", None) for a in at)]
    spark.createDataFrame(rows, "event_id long, at string, event_type string").select("event_id", F.to_timestamp("at").alias("ts"), "event_type").write.parquet(f"{tmp_path}/events.parquet")

    def step(last, pdf):
        assert pdf["event_type"].dtype == "category"
        return (len(pdf),), pdf

    s = stream.event_stream(spark, str(tmp_path)).select("event_type", "ts", "event_id")
    got = stream.drained(stream.stateful(s, "event_type", "event_type string, ts timestamp, event_id long", "n long", step)).collect()
    assert sorted((r.event_id, r.event_type) for r in got) == [(0, "x"), (1, "x"), (2, "x"), (3, None), (4, None), (5, None)]
