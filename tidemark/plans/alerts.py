"""Many rules over many symbols in one pass (R10 with U2, R5's states, R12).

Rules and watchlists are rows. The indicators that any rule names are added to the bars once, each bar is judged by all
rules in one projection, and the newest bar of each symbol is unpivoted to a row for each rule in whose scope the symbol
lies: its own symbols and the members of its watchlists, each once. So the bars are scanned and sorted once, however many
rules there are; what grows with the rules is the width of one row a symbol.

A rule whose text can't be parsed has the state ``error`` and no symbol. Disabled rules and those of other intervals are left
out. A triggered rule is silent while its cooldown lasts, and also where the time it last fired can't be read.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.rules import Rule, RuleError, parse, status, with_indicators
from tidemark.registry import query, table
from tidemark.sources.bars import USERS_SQL, users_daily


def parsed(texts: dict[str, str], interval: str) -> tuple[dict[str, Rule], dict[str, list[str]]]:
    """(enabled rules of an interval, faults of those that can't be parsed), by name."""
    rules, faults = {}, {}
    for name, text in texts.items():
        try:
            rule = parse(text)
        except RuleError as e:
            faults[name] = e.faults
            continue
        if rule.enabled and rule.interval == interval:
            rules[name] = rule
    return rules, faults


def scope(spark, rules: dict[str, Rule], watchlists: DataFrame) -> DataFrame:
    """(rule, symbol): each rule's symbols and the members of its watchlists, without repeats. ``watchlists``: (watchlist,
    symbol). A list that has no rows adds none."""
    own = [(name, s) for name, r in rules.items() for s in r.symbols]
    lists = [(name, w) for name, r in rules.items() for w in r.watchlists]
    named = spark.createDataFrame(own, "rule string, symbol string")
    through = spark.createDataFrame(lists, "rule string, watchlist string").join(watchlists, "watchlist").select("rule", "symbol")
    return named.unionByName(through).where("symbol IS NOT NULL AND symbol <> ''").distinct()


def judged(bars: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(symbol, ts, rule, hit): all rules at the newest bar of each symbol."""
    operands = [o for r in rules.values() for o in r.operands()]
    every = F.array(*[F.struct(F.lit(name).alias("rule"), r.root.holds().alias("hit")) for name, r in rules.items()])
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    last = with_indicators(bars, operands).select("symbol", "ts", every.alias("every"), nth.alias("nth")).where("nth = 1")
    return last.select("symbol", "ts", F.inline("every"))


def alerts(bars: DataFrame, texts: dict[str, str], interval: str, watchlists: DataFrame, fired: DataFrame, now: Column) -> DataFrame:
    """(rule, symbol, ts, state, fires): every rule at every symbol of its scope that has bars. ``fired``: (rule, symbol,
    last_fired, readable), one row at most for each rule and symbol; ``now``: the time of the run."""
    spark = bars.sparkSession
    rules, faults = parsed(texts, interval)
    broken = spark.createDataFrame([(name,) for name in faults], "rule string").select("rule", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("error").alias("state"), F.lit(False).alias("fires"))
    if not rules:
        return broken
    hours = reduce(lambda c, x: c.when(F.col("rule") == x[0], x[1].cooldown_hours), list(rules.items())[1:], F.when(F.col("rule") == next(iter(rules)), next(iter(rules.values())).cooldown_hours))
    x = judged(bars, rules).join(scope(spark, rules, watchlists), ["rule", "symbol"]).join(fired, ["rule", "symbol"], "left")
    free = F.col("last_fired").isNull() | (now >= F.timestamp_add("SECOND", (hours * 3600).cast("int"), F.col("last_fired")))
    fires = F.coalesce(F.col("hit"), F.lit(False)) & F.coalesce(F.col("readable"), F.lit(True)) & free
    return x.select("rule", "symbol", "ts", status(F.col("hit")).alias("state"), fires.alias("fires")).unionByName(broken)


def fired_after(fired: DataFrame, run: DataFrame, now: Column) -> DataFrame:
    """``fired`` after a run: what fired now has fired now."""
    new = run.where("fires").select("rule", "symbol", now.alias("last_fired"), F.lit(True).alias("readable"))
    return fired.join(new.select("rule", "symbol"), ["rule", "symbol"], "left_anti").unionByName(new)


def grid(n: int = 50) -> dict[str, str]:
    """``n`` rules of five kinds over a range of periods, scopes and cooldowns; the last one is faulty."""
    out = {}
    for k in range(n):
        p = 3 + k % 6
        close, volume = {"indicator": "close"}, {"indicator": "volume"}
        against = lambda left, op, name, **x: {**left, "op": op, "compare": {"indicator": name, "period": p, **x}}
        kind = [
            {"all": [against(close, ">", "sma")]},
            {"all": [against(close, "crosses_above", "sma")]},
            {"all": [against(volume, ">=", "vol_avg", mult=1.2, offset=0.5)]},
            {"any": [against(close, ">", "high_52w", shift=1), against(close, "<", "low_52w", shift=1)]},
            {"all": [against(close, "<", "sma", mult=1.1), {"any": [against(volume, ">", "vol_avg"), {**close, "op": ">", "value": 40 + k}]}]},
        ][k % 5]
        rule = {"name": f"rule {k}", "symbols": [str(k), str(k + 1)] if k % 3 == 0 else [], "watchlists": [f"N{k % 25}", f"N{k // 2 % 25}"], "interval": "1h" if k % 17 == 16 else "1d", "enabled": k % 13 != 12, "cooldown_hours": 24 * (k % 4), **kind}
        if k == n - 1:
            rule["interval"] = "never"
        out[f"r{k}"] = json.dumps(rule)
    return out


def _rule_sql(name: str, text: str) -> str:
    """One query for one rule of the grid."""
    k = int(name[1:])
    p = 3 + k % 6
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {p - 1} PRECEDING)"
    w = "OVER (PARTITION BY symbol ORDER BY ts)"
    full = f"CASE WHEN count(*) {over} = {p} THEN"
    inner = f"SELECT *, {full} avg(close) {over} END AS sma, {full} avg(volume) {over} END AS vol, {full} max(high) {over} END AS top, {full} min(low) {over} END AS low_ FROM bars"
    before = f"SELECT *, lag(close) {w} AS c1, lag(sma) {w} AS s1, lag(top) {w} AS t1, lag(low_) {w} AS l1, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM ({inner})"
    hit = [
        "close > sma", "CASE WHEN c1 IS NOT NULL AND s1 IS NOT NULL AND sma IS NOT NULL THEN c1 <= s1 AND close > sma END", "volume >= vol * 1.2 + 0.5", "close > t1 OR close < l1",
        f"close < sma * 1.1 AND (volume > vol OR close > {40 + k})",
    ][k % 5]
    rule = json.loads(text)
    members = " UNION ".join([*(f"SELECT symbol FROM lists WHERE watchlist = '{x}'" for x in rule["watchlists"]), *(f"SELECT '{s}'" for s in rule["symbols"])])
    return f"SELECT '{name}' AS rule, symbol, ts, {hit} AS hit, {rule['cooldown_hours']} AS hours FROM ({before}) WHERE nth = 1 AND symbol IN ({members})"


_TEXTS = grid()
_RUNS = " UNION ALL ".join(_rule_sql(k, t) for k, t in _TEXTS.items() if json.loads(t)["enabled"] and json.loads(t)["interval"] == "1d")
_STATE = """fired AS (SELECT 'r' || (user_id % 50) AS rule, CAST(user_id AS VARCHAR) AS symbol, max(ts) AS last_fired, count(*) % 5 <> 0 AS readable FROM events WHERE event_type = 'purchase' GROUP BY user_id)"""
_ALERTS = f"""{USERS_SQL.replace('user_id AS symbol', 'CAST(user_id AS VARCHAR) AS symbol')}, lists AS (SELECT DISTINCT 'N' || (user_id % 25) AS watchlist, CAST(user_id AS VARCHAR) AS symbol FROM events JOIN nation ON n_nationkey = user_id % 25),
{_STATE}, now_ AS (SELECT max(ts) AS now FROM bars), runs AS ({_RUNS}),
judged AS (SELECT rule, symbol, ts, CASE WHEN hit IS NULL THEN 'insufficient_data' WHEN hit THEN 'triggered' ELSE 'not_met' END AS state,
  coalesce(hit, false) AND coalesce(readable, true) AND (last_fired IS NULL OR now >= last_fired + to_hours(hours)) AS fires FROM runs LEFT JOIN fired USING (rule, symbol), now_
  UNION ALL SELECT 'r{len(_TEXTS) - 1}', NULL, NULL, 'error', false)"""


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, Column]:
    e = table(spark, sf_dir, "events")
    bars = users_daily(spark, sf_dir).withColumn("symbol", F.col("symbol").cast("string"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    users = e.select("user_id", (F.col("user_id") % 25).alias("k")).distinct()
    lists = users.join(nations, "k").select(F.concat(F.lit("N"), F.col("k").cast("string")).alias("watchlist"), F.col("user_id").cast("string").alias("symbol"))
    fired = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_fired"), (F.count("*") % 5 != 0).alias("readable"))
    fired = fired.select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("rule"), F.col("user_id").cast("string").alias("symbol"), "last_fired", "readable")
    now = F.lit(e.where("value > 0").agg(F.max(F.date_trunc("day", "ts").cast("timestamp_ntz"))).first()[0])
    return alerts(bars, _TEXTS, "1d", lists, fired, now), fired, now


@query(f"WITH {_ALERTS} SELECT rule, symbol, ts, state, fires FROM judged")
def r10_alert_engine(spark, sf_dir):
    """Fifty rules over all users' daily bars, with watchlists by nation and the users' last purchases as what fired last."""
    return _run(spark, sf_dir)[0]


@query(f"WITH {_ALERTS} SELECT rule, count(*) AS symbols, count(*) FILTER (state = 'triggered') AS triggered, count(*) FILTER (state = 'insufficient_data') AS unknown, count(*) FILTER (fires) AS fired, count(*) FILTER (state = 'triggered' AND NOT fires) AS suppressed FROM judged GROUP BY rule")
def r10_run_summary(spark, sf_dir):
    x = _run(spark, sf_dir)[0]
    hit = F.col("state") == "triggered"
    return x.groupBy("rule").agg(F.count("*").alias("symbols"), F.count_if(hit).alias("triggered"), F.count_if(F.col("state") == "insufficient_data").alias("unknown"), F.count_if("fires").alias("fired"), F.count_if(hit & ~F.col("fires")).alias("suppressed"))


@query(f"""WITH {_ALERTS} SELECT rule, symbol, CASE WHEN fires THEN now ELSE last_fired END AS last_fired, coalesce(fires, false) OR readable AS readable FROM fired FULL JOIN (SELECT rule, symbol, fires FROM judged WHERE fires) USING (rule, symbol), now_""")
def r12_fired_state(spark, sf_dir):
    """What a run leaves behind for the next one."""
    run, fired, now = _run(spark, sf_dir)
    return fired_after(fired, run, now)
