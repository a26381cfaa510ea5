"""The alert engine: scopes, states and cooldowns."""

import datetime
import json

from pyspark.sql import functions as F

from tidemark.plans import alerts as al

DAY = datetime.datetime(2024, 3, 1)


def bars_of(spark, closes):
    rows = [(s, DAY + datetime.timedelta(days=k), *([float(c)] * 4), 10.0) for s, x in closes.items() for k, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def rule(name, **x):
    return json.dumps({"name": name, "symbols": [], "watchlists": [], "interval": "1d", "all": [{"indicator": "close", "op": ">", "compare": {"indicator": "sma", "period": 3}}]} | x)


def test_scopes_states_and_cooldowns(spark):
    bars = bars_of(spark, {"A": [1, 2, 3], "B": [3, 2, 1], "C": [1, 2], "D": [1, 2, 9], "E": [1, 2, 9]})
    texts = {
        "own": rule("own", symbols=["a", "B", "ZZ"]), "lists": rule("lists", symbols=["A"], watchlists=["w", "none"], cooldown_hours=24),
        "off": rule("off", symbols=["A"], enabled=False), "hourly": rule("hourly", symbols=["A"], interval="1h"), "bad": rule("bad"), "nonsense": "{",
    }
    lists = spark.createDataFrame([("w", "A"), ("w", "C"), ("w", "D"), ("w", "E"), ("other", "B"), ("w", "")], "watchlist string, symbol string")
    now = DAY + datetime.timedelta(days=3)
    fired = spark.createDataFrame([("lists", "A", now - datetime.timedelta(hours=23), True), ("lists", "D", now - datetime.timedelta(hours=24), True), ("lists", "E", DAY, False)], "rule string, symbol string, last_fired timestamp_ntz, readable boolean")
    got = {(r.rule, r.symbol): (r.state, r.fires) for r in al.alerts(bars, texts, "1d", lists, fired, F.lit(now)).collect()}
    assert got == {
        ("own", "A"): ("triggered", True), ("own", "B"): ("not_met", False),
        ("lists", "A"): ("triggered", False), ("lists", "C"): ("insufficient_data", False), ("lists", "D"): ("triggered", True), ("lists", "E"): ("triggered", False),
        ("bad", None): ("error", False), ("nonsense", None): ("error", False),
    }
    run = al.alerts(bars, texts, "1d", lists, fired, F.lit(now))
    after = {(r.rule, r.symbol): (r.last_fired, r.readable) for r in al.fired_after(fired, run, F.lit(now)).collect()}
    assert after == {("own", "A"): (now, True), ("lists", "A"): (now - datetime.timedelta(hours=23), True), ("lists", "D"): (now, True), ("lists", "E"): (DAY, False)}
    # The state a run leaves silences the next.
    again = al.alerts(bars, texts, "1d", lists, spark.createDataFrame([(*k, *v) for k, v in after.items()], fired.schema), F.lit(now + datetime.timedelta(hours=1)))
    assert {(r.rule, r.symbol) for r in again.where("fires").collect()} == {("own", "A"), ("lists", "A")}


def test_without_any_sound_rule(spark):
    bars = bars_of(spark, {"A": [1, 2, 3]})
    fired = spark.createDataFrame([], "rule string, symbol string, last_fired timestamp_ntz, readable boolean")
    lists = spark.createDataFrame([], "watchlist string, symbol string")
    assert [r.state for r in al.alerts(bars, {"x": "{"}, "1d", lists, fired, F.lit(DAY)).collect()] == ["error"]


def test_fifty_rules_scan_the_bars_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars_of(spark, {str(s): range(s, s + 12) for s in range(20)}).write.parquet(path)
    fired = spark.createDataFrame([], "rule string, symbol string, last_fired timestamp_ntz, readable boolean")
    lists = spark.createDataFrame([(f"N{k}", str(k)) for k in range(20)], "watchlist string, symbol string")
    run = al.alerts(spark.read.parquet(path), al.grid(), "1d", lists, fired, F.lit(DAY))
    assert run._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert run.count() > 50
