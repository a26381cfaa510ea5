"""The rule language: JSON rules, validated and compiled to nullable boolean columns over bars.

A rule has one of ``all`` and ``any``: a list of conditions, of which each may again be one such group. A condition
compares an indicator (left) with a value or with another indicator times ``mult`` plus ``offset``. Null is unknown, so
SQL's AND and OR are the three-valued connectives asked for. Every bar is judged in one pass over windows; the recursive
indicators that a rule names are added to the bars once, before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.indicators import _ema_walk, by_series, column, last_n, r6, series
from tidemark.registry import query
from tidemark.sources.bars import HOURLY_SQL, hourly

MOST_CONDITIONS, MOST_SYMBOLS, LONGEST, LONGEST_NAME = 20, 50, 2000, 120
OPS = ("<", "<=", ">", ">=", "==", "!=", "crosses_above", "crosses_below")


@dataclass(frozen=True)
class Indicator:
    """``defaults``: parameters and their values; ``bars``: how many bars give the first value; exactly one of ``expr``
    (a column over windows) and ``walk`` (a function of one symbol's bars)."""

    defaults: dict[str, int]
    bars: Callable[[dict], int]
    expr: Callable[[dict], Column] | None = None
    walk: Callable[[dict], Callable] | None = None


REGISTRY: dict[str, Indicator] = {}


def register_indicator(name: str, defaults: dict[str, int], bars: Callable[[dict], int], expr=None, walk=None) -> None:
    """Makes ``name`` known to rules."""
    if (expr is None) == (walk is None):
        raise ValueError("give one of expr and walk")
    REGISTRY[name] = Indicator(defaults, bars, expr, walk)


def vocabulary() -> dict[str, dict[str, int]]:
    """Known indicators with their parameters' defaults."""
    return {k: dict(v.defaults) for k, v in REGISTRY.items()}


for _field in ("open", "high", "low", "close", "volume"):
    register_indicator(_field, {}, lambda p: 1, expr=lambda p, f=_field: F.col(f))
register_indicator("sma", {"period": 20}, lambda p: p["period"], expr=lambda p: ind.sma(F.col("close"), p["period"]))
register_indicator("vol_avg", {"period": 20}, lambda p: p["period"], expr=lambda p: ind.sma(F.col("volume"), p["period"]))
register_indicator("vwap", {"period": 20}, lambda p: p["period"], expr=lambda p: ind.rolling_vwap(p["period"]))
register_indicator("session_vwap", {}, lambda p: 1, expr=lambda p: ind.session_vwap(F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York"))))
register_indicator("high_52w", {"period": 252}, lambda p: p["period"], expr=lambda p: ind.rolling(F.max, F.col("high"), p["period"]))
register_indicator("low_52w", {"period": 252}, lambda p: p["period"], expr=lambda p: ind.rolling(F.min, F.col("low"), p["period"]))
register_indicator("ema", {"period": 20}, lambda p: p["period"], walk=lambda p: lambda b: ind.ema(column("close")(b), p["period"]))
register_indicator("rsi", {"period": 14}, lambda p: p["period"] + 1, walk=lambda p: lambda b: ind.rsi(column("close")(b), p["period"]))
register_indicator("atr", {"period": 14}, lambda p: p["period"] + 1, walk=lambda p: lambda b: ind.atr(*(column(c)(b) for c in ("high", "low", "close")), p["period"]))
for _k, _name in enumerate(("macd", "macd_signal", "macd_hist")):
    register_indicator(_name, {"fast": 12, "slow": 26, "signal": 9}, lambda p: p["slow"] + p["signal"], walk=lambda p, k=_k: lambda b: ind.macd(column("close")(b), p["fast"], p["slow"], p["signal"])[k])


@dataclass
class Operand:
    indicator: str
    params: dict[str, int] = field(default_factory=dict)
    shift: int = 0
    mult: float = 1.0
    offset: float = 0.0

    def key(self) -> str:
        """The column that holds the indicator before shift, mult and offset."""
        full = REGISTRY[self.indicator].defaults | self.params
        return "_".join([self.indicator, *(str(full[k]) for k in sorted(full))])

    def bars(self) -> int:
        return REGISTRY[self.indicator].bars(REGISTRY[self.indicator].defaults | self.params) + self.shift

    def value(self, back: int = 0) -> Column:
        x = F.col(self.key())
        shifted = F.lag(x, self.shift + back).over(series()) if self.shift + back else x
        return shifted * F.lit(float(self.mult or 1.0)) + F.lit(float(self.offset))


@dataclass
class Condition:
    left: Operand
    op: str
    value: float | None = None
    right: Operand | None = None

    def sides(self, back: int = 0) -> tuple[Column, Column]:
        return self.left.value(back), self.right.value(back) if self.right else F.lit(float(self.value))

    def holds(self) -> Column:
        left, right = self.sides()
        if self.op.startswith("crosses"):
            return crosses(*self.sides(1), left, right, self.op == "crosses_above")
        return compared(left, self.op, right)


@dataclass
class Group:
    kind: str
    nodes: list

    def holds(self) -> Column:
        return reduce(Column.__and__ if self.kind == "all" else Column.__or__, [n.holds() for n in self.nodes])

    def leaves(self) -> list[Condition]:
        return [x for n in self.nodes for x in (n.leaves() if isinstance(n, Group) else [n])]


@dataclass
class Rule:
    name: str
    root: Group
    symbols: list[str] = field(default_factory=list)
    interval: str = "1h"
    cooldown_hours: float = 0.0
    enabled: bool = True
    watchlists: list[str] = field(default_factory=list)

    def operands(self) -> list[Operand]:
        return [o for c in self.root.leaves() for o in (c.left, c.right) if o]

    def required_bars(self) -> int:
        return max(o.bars() for o in self.operands()) + 2


class RuleError(ValueError):
    """All faults of a rule, each with the path of its field."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


_RULE = {"name", "symbols", "watchlists", "interval", "all", "any", "cooldown_hours", "notify", "enabled", "description"}
_LEAF = {"indicator", "period", "fast", "slow", "signal", "shift", "op", "value", "compare"}
_SIDE = {"indicator", "period", "fast", "slow", "signal", "shift", "mult", "offset"}
_SYMBOL = re.compile(r"[A-Z0-9.\-_=^]{1,20}")
INTERVALS = ("1m", "5m", "15m", "1h", "1d", "1wk")


def parse(text: str) -> Rule:
    """The rule of a JSON text; unknown fields and all other faults are told at once."""
    try:
        x = json.loads(text)
    except ValueError as e:
        raise RuleError([f"json: {e}"]) from None
    faults: list[str] = []

    def known(d, allowed: set[str], path: str) -> bool:
        if not isinstance(d, dict):
            faults.append(f"{path}: not an object")
            return False
        faults.extend(f"{path}.{k}: unknown field" for k in d if k not in allowed)
        return True

    def operand(d: dict, path: str) -> Operand | None:
        name = d.get("indicator")
        if name not in REGISTRY:
            faults.append(f"{path}.indicator: unknown indicator {name!r}")
            return None
        params = {k: d[k] for k in ("period", "fast", "slow", "signal") if k in d}
        for k, v in [*params.items(), ("shift", d.get("shift", 0))]:
            if k != "shift" and k not in REGISTRY[name].defaults:
                faults.append(f"{path}.{k}: {name} has no such parameter")
            elif not isinstance(v, int) or isinstance(v, bool) or not (k == "shift") <= v + (k == "shift") or (k != "shift" and v < 1) or v > LONGEST or v < 0:
                faults.append(f"{path}.{k}: out of range")
        full = REGISTRY[name].defaults | params
        if "fast" in full and full["fast"] >= full["slow"]:
            faults.append(f"{path}.fast: not below slow")
        return Operand(name, params, d.get("shift", 0), d.get("mult", 1.0) or 1.0, d.get("offset", 0.0))

    def node(d, path: str, depth: int):
        if isinstance(d, dict) and ("all" in d or "any" in d):
            if depth:
                faults.append(f"{path}: nested too deep")
                return None
            return known(d, {"all", "any"}, path) and group(d, path, depth + 1) or None
        if not known(d, _LEAF, path):
            return None
        left = operand(d, path)
        if d.get("op") not in OPS:
            faults.append(f"{path}.op: unknown operator {d.get('op')!r}")
        right = None
        if ("value" in d) == ("compare" in d):
            faults.append(f"{path}: needs one of value and compare")
        elif "compare" in d:
            right = known(d["compare"], _SIDE, f"{path}.compare") and operand(d["compare"], f"{path}.compare") or None
        elif not isinstance(d["value"], (int, float)) or isinstance(d["value"], bool):
            faults.append(f"{path}.value: not a number")
        return Condition(left, d.get("op"), d.get("value"), right)

    def group(d: dict, path: str, depth: int) -> Group | None:
        kinds = [k for k in ("all", "any") if k in d]
        if len(kinds) != 1:
            faults.append(f"{path}: needs one of all and any")
            return None
        items = d[kinds[0]]
        if not isinstance(items, list) or not 1 <= len(items) <= MOST_CONDITIONS:
            faults.append(f"{path}.{kinds[0]}: needs 1 to {MOST_CONDITIONS} conditions")
            return None
        return Group(kinds[0], [node(n, f"{path}.{kinds[0]}[{k}]", depth) for k, n in enumerate(items)])

    if not known(x, _RULE, "rule"):
        raise RuleError(faults)
    symbols = [str(s).strip().upper() for s in x.get("symbols") or []]
    name, hours = str(x.get("name") or "").strip(), x.get("cooldown_hours", 0)
    if not name:
        faults.append("rule.name: missing")
    elif len(name) > LONGEST_NAME:
        faults.append(f"rule.name: over {LONGEST_NAME} characters")
    if not symbols and not x.get("watchlists"):
        faults.append("rule.symbols: name a symbol or a watchlist")
    if len(symbols) > MOST_SYMBOLS:
        faults.append(f"rule.symbols: over {MOST_SYMBOLS}")
    for k, symbol in enumerate(symbols):
        if not _SYMBOL.fullmatch(symbol):
            faults.append(f"rule.symbols[{k}]: no symbol")
        elif symbol in symbols[:k]:
            faults.append(f"rule.symbols[{k}]: {symbol} again")
    if "interval" not in x:
        faults.append("rule.interval: missing")
    elif x["interval"] not in INTERVALS:
        faults.append("rule.interval: unknown")
    if not isinstance(hours, (int, float)) or isinstance(hours, bool) or not 0 <= hours <= 24 * 365:
        faults.append("rule.cooldown_hours: not from 0 to a year")
    root = group({k: x[k] for k in ("all", "any") if k in x}, "rule", 0)
    if faults:
        raise RuleError(faults)
    return Rule(name, root, symbols, x["interval"], float(hours), x.get("enabled", True), list(x.get("watchlists") or []))


def equal(a: Column, b: Column) -> Column:
    """Equal up to 1e-9, absolute or relative."""
    return (F.abs(a - b) < 1e-9) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9)


def compared(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": equal(a, b), "!=": ~equal(a, b)}[op]


def crosses(before_a: Column, before_b: Column, a: Column, b: Column, above: bool) -> Column:
    """Whether a goes over b (or under): unknown unless all four values are there."""
    there = before_a.isNotNull() & before_b.isNotNull() & a.isNotNull() & b.isNotNull()
    return F.when(there, (before_a <= before_b) & (a > b) if above else (before_a >= before_b) & (a < b))


def with_indicators(bars: DataFrame, operands: list[Operand]) -> DataFrame:
    """``bars`` with a column for each distinct indicator that the operands name."""
    need = {o.key(): o for o in operands if o.key() not in bars.columns}
    full = lambda o: REGISTRY[o.indicator].defaults | o.params
    walks = {k: REGISTRY[o.indicator].walk(full(o)) for k, o in need.items() if REGISTRY[o.indicator].walk}
    out = by_series(bars, walks) if walks else bars
    return out.withColumns({k: REGISTRY[o.indicator].expr(full(o)) for k, o in need.items() if REGISTRY[o.indicator].expr})


def evaluated(bars: DataFrame, rule: Rule) -> DataFrame:
    """``bars`` with ``hit`` (true, false or unknown) and, for each condition, its label, both sides and result."""
    x = with_indicators(bars, rule.operands())
    leaf = [F.struct(F.lit(f"{c.left.key()} {c.op} {c.right.key() if c.right else c.value}").alias("label"), c.sides()[0].alias("lv"), c.sides()[1].alias("rv"), c.holds().alias("result")) for c in rule.root.leaves()]
    return x.select(*bars.columns, rule.root.holds().alias("hit"), F.array(*leaf).alias("leaves"))


def status(hit: Column) -> Column:
    return F.when(hit.isNull(), "insufficient_data").when(hit, "triggered").otherwise("not_met")


def latest(bars: DataFrame, rule: Rule) -> DataFrame:
    """The rule at each symbol's last bar."""
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return evaluated(bars, rule).withColumn("nth", nth).where("nth = 1").select("symbol", "ts", status(F.col("hit")).alias("status"), "leaves")


def cooled(hits: DataFrame, keys: list[str], hours: float) -> DataFrame:
    """Those rows of ``hits`` (keys, ts) that fire: each silences the following ones for ``hours``. A hit that comes as long
    after the one before fires whatever fired earlier, so it begins a stretch of its own; stretches are folded, in order of
    time, each by itself."""
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("last"), F.array().cast("array<timestamp_ntz>").alias("fired"))
    wait = F.expr(f"INTERVAL {int(hours * 3600)} SECOND")
    step = lambda s, t: F.when(s["last"].isNull() | (t >= s["last"] + wait), F.struct(t.alias("last"), F.concat(s["fired"], F.array(t)).alias("fired"))).otherwise(s)
    w = Window.partitionBy(*keys).orderBy("ts")
    before = F.lag("ts").over(w)
    marked = hits.select(*keys, "ts", F.when(before.isNull() | (F.col("ts") >= before + wait), 1).otherwise(0).alias("fresh")).withColumn("stretch", F.sum("fresh").over(w))
    folded = marked.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list("ts")).alias("x"))
    return folded.select(*keys, F.explode(F.aggregate("x", start, step, lambda s: s["fired"])).alias("ts"))


_EVERYWHERE = {"watchlists": ["all"], "interval": "1h"}
MOMENTUM = json.dumps({"name": "momentum", **_EVERYWHERE, "all": [{"indicator": "close", "op": ">", "compare": {"indicator": "sma", "period": 20}}, {"indicator": "volume", "op": ">", "compare": {"indicator": "vol_avg", "period": 20, "mult": 1.5}}], "cooldown_hours": 24})
_BUSY = {"indicator": "volume", "op": ">", "compare": {"indicator": "vol_avg", "period": 20, "mult": 1.5}}
TEMPLATES = {
    "oversold_bounce": {"name": "oversold bounce", **_EVERYWHERE, "cooldown_hours": 24, "all": [{"indicator": "rsi", "period": 14, "op": "<", "value": 35}, {"indicator": "close", "op": ">", "compare": {"indicator": "sma", "period": 200}}, _BUSY]},
    "golden_cross": {"name": "golden cross", **_EVERYWHERE, "cooldown_hours": 168, "all": [{"indicator": "sma", "period": 50, "op": "crosses_above", "compare": {"indicator": "sma", "period": 200}}]},
    "year_breakout": {"name": "year breakout", **_EVERYWHERE, "cooldown_hours": 72, "all": [{"indicator": "close", "op": ">", "compare": {"indicator": "high_52w", "period": 252, "shift": 1}}, _BUSY]},
    "macd_turn": {"name": "macd turn", **_EVERYWHERE, "cooldown_hours": 48, "all": [
        {"indicator": "macd", "fast": 12, "slow": 26, "signal": 9, "op": "crosses_above", "compare": {"indicator": "macd_signal", "fast": 12, "slow": 26, "signal": 9}},
        {"any": [{"indicator": "close", "op": ">", "compare": {"indicator": "sma", "period": 50}}, {"indicator": "rsi", "period": 14, "op": ">", "value": 55}]},
    ]},
}

_MOMENTUM_SQL = f"""{HOURLY_SQL}, m AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma20, CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END AS vol20
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
hits AS (SELECT *, close > sma20 AND volume > vol20 * 1.5 AS hit FROM m)"""


@query(f"WITH {_MOMENTUM_SQL} SELECT symbol, ts, close, round(sma20, 6) AS sma20, hit FROM hits WHERE hit OR hit IS NULL")
def r5_rule_hits(spark, sf_dir):
    """The flagship: bars at which the rule holds or can't be judged."""
    rule = parse(MOMENTUM)
    x = evaluated(hourly(spark, sf_dir), rule).where(F.col("hit") | F.col("hit").isNull())
    return x.select("symbol", "ts", "close", r6("sma20", F.col("leaves")[0]["rv"]), "hit")


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE event_id // 3 % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM events)
SELECT a, b, a AND b AS both, a OR b AS either, count(*) AS n FROM e GROUP BY a, b""")
def r1_kleene(spark, sf_dir):
    three = lambda x: F.when(x == 0, True).when(x == 1, False)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(three(F.col("event_id") % 3).alias("a"), three(F.floor(F.col("event_id") / 3) % 3).alias("b"))
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), "n")


@query(f"""WITH {HOURLY_SQL}, x AS (SELECT symbol, close AS a, CASE volume % 3 WHEN 0 THEN close * (1 + 1e-12) WHEN 1 THEN close + 1e-3 ELSE open END AS b FROM bars),
c AS (SELECT *, abs(a - b) < 1e-9 OR abs(a - b) <= greatest(abs(a), abs(b)) * 1e-9 AS same FROM x)
SELECT symbol, count(*) FILTER (WHERE same) AS eq, count(*) FILTER (WHERE NOT same) AS ne, count(*) FILTER (WHERE a < b) AS lt, count(*) FILTER (WHERE a >= b) AS ge FROM c GROUP BY symbol""")
def r2_comparisons(spark, sf_dir):
    c, kind = F.col("close"), F.col("volume") % 3
    x = hourly(spark, sf_dir).select("symbol", c.alias("a"), F.when(kind == 0, c * (1 + 1e-12)).when(kind == 1, c + 1e-3).otherwise(F.col("open")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.groupBy("symbol").agg(F.count_if(compared(a, "==", b)).alias("eq"), F.count_if(compared(a, "!=", b)).alias("ne"), F.count_if(compared(a, "<", b)).alias("lt"), F.count_if(compared(a, ">=", b)).alias("ge"))


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, CASE WHEN count(close) OVER w = 10 THEN avg(close) OVER w END AS sma10 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING)),
p AS (SELECT *, lag(close) OVER w AS pc, lag(sma10) OVER w AS ps FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN pc IS NOT NULL AND ps IS NOT NULL AND sma10 IS NOT NULL THEN pc <= ps AND close > sma10 END AS above,
 CASE WHEN pc IS NOT NULL AND ps IS NOT NULL AND sma10 IS NOT NULL THEN pc >= ps AND close < sma10 END AS below FROM p""")
def r3_crosses(spark, sf_dir):
    x = with_indicators(hourly(spark, sf_dir), [Operand("sma", {"period": 10}), Operand("close")])
    up, down = (Condition(Operand("close"), op, right=Operand("sma", {"period": 10})) for op in ("crosses_above", "crosses_below"))
    return x.select("symbol", "ts", up.holds().alias("above"), down.holds().alias("below"))


@query(f"""WITH {HOURLY_SQL} SELECT symbol, ts, round(lag(close, 4) OVER (PARTITION BY symbol ORDER BY ts) * 1.05 - 2, 6) AS operand FROM bars""")
def r4_operand(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "ts", r6("operand", Operand("close", shift=4, mult=1.05, offset=-2).value()))


@query(f"""WITH {_MOMENTUM_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM hits)
SELECT symbol, ts, CASE WHEN hit IS NULL THEN 'insufficient_data' WHEN hit THEN 'triggered' ELSE 'not_met' END AS status, close > sma20 AS first_holds FROM l WHERE nth = 1""")
def r5_latest_status(spark, sf_dir):
    return latest(hourly(spark, sf_dir), parse(MOMENTUM)).select("symbol", "ts", "status", F.col("leaves")[0]["result"].alias("first_holds"))


@query(f"""WITH {HOURLY_SQL}, need AS (SELECT 20 + 2 AS n), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM bars)
SELECT symbol, count(*) AS bars, min(ts) AS since FROM r, need WHERE nth <= n GROUP BY symbol""")
def r6_required_bars(spark, sf_dir):
    from tidemark.sources.bars import newest

    return newest(hourly(spark, sf_dir), parse(MOMENTUM).required_bars()).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("since"))


@query(f"""WITH {_MOMENTUM_SQL} SELECT symbol, ts, 'close ' || CASE WHEN close >= 100 THEN printf('%.2f', close) ELSE printf('%.4f', close) END || ' > sma ' || CASE WHEN sma20 >= 100 THEN printf('%.2f', sma20) ELSE printf('%.4f', sma20) END AS summary FROM hits WHERE hit""")
def r7_summary_text(spark, sf_dir):
    """Numbers with as many digits as their size asks for."""
    shown = lambda x: F.when(x >= 100, F.format_string("%.2f", x)).otherwise(F.format_string("%.4f", x))
    x = evaluated(hourly(spark, sf_dir), parse(MOMENTUM)).where("hit")
    return x.select("symbol", "ts", F.concat(F.lit("close "), shown(F.col("leaves")[0]["lv"]), F.lit(" > sma "), shown(F.col("leaves")[0]["rv"])).alias("summary"))


def _template(spark, sf_dir, name: str) -> DataFrame:
    return evaluated(hourly(spark, sf_dir), parse(json.dumps(TEMPLATES[name]))).where("hit").select("symbol", "ts")


_RSI_SQL = f"""{HOURLY_SQL}, i AS (SELECT *, row_number() OVER w - 1 AS k, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
rsi_seed AS (SELECT symbol, avg(greatest(d, 0)) AS u, avg(greatest(-d, 0)) AS v FROM i WHERE k BETWEEN 1 AND 14 GROUP BY symbol HAVING count(d) = 14),
rsi_walk AS (SELECT symbol, CAST(14 AS BIGINT) AS k, u, v FROM rsi_seed UNION ALL
  SELECT w.symbol, w.k + 1, (w.u * 13 + greatest(i.d, 0)) / 14, (w.v * 13 + greatest(-i.d, 0)) / 14 FROM rsi_walk w JOIN i ON i.symbol = w.symbol AND i.k = w.k + 1),
rsi AS (SELECT symbol, k, CASE WHEN v = 0 AND u = 0 THEN 50 WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END AS rsi FROM rsi_walk)"""


@query(f"""WITH RECURSIVE {_RSI_SQL}, a AS (SELECT symbol, ts, k, close, volume, CASE WHEN count(*) OVER l = 200 THEN avg(close) OVER l END AS sma200, CASE WHEN count(*) OVER v = 20 THEN avg(volume) OVER v END AS vol20 FROM i
 WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING), v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, ts FROM a JOIN rsi USING (symbol, k) WHERE rsi < 35 AND close > sma200 AND volume > vol20 * 1.5""")
def r9_oversold_bounce(spark, sf_dir):
    return _template(spark, sf_dir, "oversold_bounce")


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, CASE WHEN count(*) OVER a = 50 THEN avg(close) OVER a END AS f, CASE WHEN count(*) OVER b = 200 THEN avg(close) OVER b END AS g FROM bars
 WINDOW a AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts ROWS 199 PRECEDING)),
p AS (SELECT *, lag(f) OVER w AS pf, lag(g) OVER w AS pg FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT symbol, ts FROM p WHERE pf <= pg AND f > g""")
def r9_golden_cross(spark, sf_dir):
    return _template(spark, sf_dir, "golden_cross")


@query(f"""WITH {HOURLY_SQL}, s AS (SELECT *, row_number() OVER w AS k, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS 251 PRECEDING) AS top,
  CASE WHEN count(*) OVER v = 20 THEN avg(volume) OVER v END AS v20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
p AS (SELECT *, lag(CASE WHEN k >= 252 THEN top END) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM s) SELECT symbol, ts FROM p WHERE close > before AND volume > v20 * 1.5""")
def r9_year_breakout(spark, sf_dir):
    return _template(spark, sf_dir, "year_breakout")


@query(f"""WITH RECURSIVE {_RSI_SQL}, {_ema_walk('fast', 'i', 'close', 12, '0')}, {_ema_walk('slow', 'i', 'close', 26, '0')},
line AS (SELECT i.symbol, i.ts, i.k, i.close, f.s - s.s AS line FROM i JOIN fast f USING (symbol, k) JOIN slow s USING (symbol, k)), {_ema_walk('sig', 'line', 'line', 9, '25')},
a AS (SELECT symbol, k, CASE WHEN count(*) OVER l = 50 THEN avg(close) OVER l END AS sma50 FROM i WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING)),
p AS (SELECT l.symbol, l.k, l.ts, l.close, l.line, g.s AS signal, lag(l.line) OVER w AS pl, lag(g.s) OVER w AS ps FROM line l LEFT JOIN sig g USING (symbol, k) WINDOW w AS (PARTITION BY l.symbol ORDER BY l.k))
SELECT symbol, ts FROM p JOIN a USING (symbol, k) LEFT JOIN rsi USING (symbol, k) WHERE pl <= ps AND line > signal AND (close > sma50 OR rsi > 55)""")
def r9_macd_turn(spark, sf_dir):
    return _template(spark, sf_dir, "macd_turn")


FAULTY = [
    ({"name": "", "all": [{"indicator": "nope", "op": "~", "value": 1}]}, ["rule.name", "rule.symbols", "rule.interval", "rule.all[0].indicator", "rule.all[0].op"]),
    ({"name": "n" * 121, "symbols": ["a", "A", "?"], "interval": "2h", "cooldown_hours": -1, "odd": 1, "all": []}, ["rule.odd", "rule.name", "rule.symbols[1]", "rule.symbols[2]", "rule.interval", "rule.cooldown_hours", "rule.all"]),
    ({"name": "deep", **_EVERYWHERE, "any": [{"all": [{"any": []}]}, {"indicator": "sma", "period": 0, "op": ">", "value": 1, "compare": {"indicator": "close"}}]}, ["rule.any[0].all[0]", "rule.any[1].period", "rule.any[1]"]),
    ({"name": "macd", **_EVERYWHERE, "all": [{"indicator": "macd", "fast": 26, "slow": 12, "op": ">", "value": True}]}, ["rule.all[0].fast", "rule.all[0].value"]),
    (json.loads(MOMENTUM), []),
]


@query("SELECT rule, field FROM (VALUES " + ", ".join(f"({k}, '{f}')" for k, (_, fields) in enumerate(FAULTY) for f in fields) + ") t(rule, field)")
def r8_rule_faults(spark, sf_dir):
    """The fields at fault of a table of rule texts, all at once; a sound rule has none."""
    rules = spark.createDataFrame([(k, json.dumps(rule)) for k, (rule, _) in enumerate(FAULTY)], "rule int, text string")

    @F.udf("array<string>")
    def faults(text):
        try:
            parse(text)
        except RuleError as e:
            return list(dict.fromkeys(f.split(": ")[0] for f in e.faults))
        return []

    return rules.select("rule", F.explode(faults("text")).alias("field"))


def faulty_fields(text: Column) -> Column:
    """The fields at fault of rule texts, without repeats; none for a sound rule."""

    @F.pandas_udf("array<string>")
    def faults(texts: pd.Series) -> pd.Series:
        def of(text):
            try:
                parse(text)
            except RuleError as e:
                return list(dict.fromkeys(f.split(": ")[0] for f in e.faults))
            return []

        return texts.map(of)

    return faults(text)


@query("""WITH f AS (SELECT p_partkey AS rule, unnest([CASE WHEN p_size * 60 > 2000 THEN 'rule.all[0].period' END, CASE WHEN p_partkey % 7 = 0 THEN 'rule.all[0].op' END, CASE WHEN p_partkey % 5 = 0 THEN 'rule.interval' END,
 CASE WHEN p_partkey % 11 = 0 THEN 'rule.symbols' END, CASE WHEN p_partkey % 11 > 0 AND p_partkey % 3 = 0 THEN 'rule.symbols[1]' END, CASE WHEN p_partkey % 13 = 0 THEN 'rule.cooldown_hours' END, CASE WHEN p_partkey % 17 = 0 THEN 'rule.extra' END]) AS field FROM part)
SELECT rule, field FROM f WHERE field IS NOT NULL""")
def r8_table_faults(spark, sf_dir):
    """The faults of a rule for each part, made of its numbers."""
    k = F.col("p_partkey")
    symbols = F.when(k % 11 == 0, "[]").when(k % 3 == 0, '["AB", "ab"]').otherwise('["AB"]')
    parts = [
        '{"name": "', F.col("p_name"), '", "symbols": ', symbols, ', "interval": "', F.when(k % 5 == 0, "2d").otherwise("1d"), '", "cooldown_hours": ', F.when(k % 13 == 0, "-1").otherwise("24"), F.when(k % 17 == 0, ', "extra": 1').otherwise(""),
        ', "all": [{"indicator": "sma", "period": ', (F.col("p_size") * 60).cast("string"), ', "op": "', F.when(k % 7 == 0, "~").otherwise(">"), '", "value": ', F.col("p_retailprice").cast("string"), "}]}",
    ]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("rule"), F.explode(faulty_fields(text)).alias("field"))


@query(f"""WITH {_MOMENTUM_SQL}, last_fired AS (SELECT symbol, min(ts) + INTERVAL 600 HOUR AS fired FROM bars GROUP BY symbol),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS nth FROM hits WHERE hit)
SELECT symbol, l.ts, l.ts >= f.fired + INTERVAL 24 HOUR AS fires FROM l JOIN last_fired f USING (symbol) WHERE nth <= 3""")
def r10_alert_cooldown(spark, sf_dir):
    """The newest three hits of each symbol against the time it last fired."""
    b = hourly(spark, sf_dir)
    fired = b.groupBy("symbol").agg((F.min("ts") + F.expr("INTERVAL 600 HOUR")).alias("fired"))
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    hits = evaluated(b, parse(MOMENTUM)).where("hit").withColumn("nth", nth).where("nth <= 3")
    return hits.join(fired, "symbol").select("symbol", "ts", (F.col("ts") >= F.col("fired") + F.expr("INTERVAL 24 HOUR")).alias("fires"))


@query(f"""WITH RECURSIVE {_MOMENTUM_SQL}, f AS (SELECT symbol, min(ts) AS ts FROM hits WHERE hit GROUP BY symbol
  UNION ALL (SELECT f.symbol, (SELECT min(h.ts) FROM hits h WHERE h.hit AND h.symbol = f.symbol AND h.ts >= f.ts + INTERVAL 24 HOUR) FROM f WHERE f.ts IS NOT NULL))
SELECT symbol, ts FROM f WHERE ts IS NOT NULL""")
def r11_cooldown_history(spark, sf_dir):
    rule = parse(MOMENTUM)
    return cooled(evaluated(hourly(spark, sf_dir), rule).where("hit"), ["symbol"], rule.cooldown_hours)


@query(f"""WITH {_MOMENTUM_SQL} SELECT symbol, max(ts) AS evaluated_at, max(ts) FILTER (WHERE hit) AS last_hit, count(*) FILTER (WHERE hit IS NULL) AS unknown FROM hits GROUP BY symbol""")
def r12_last_state(spark, sf_dir):
    return evaluated(hourly(spark, sf_dir), parse(MOMENTUM)).groupBy("symbol").agg(F.max("ts").alias("evaluated_at"), F.max(F.when(F.col("hit"), F.col("ts"))).alias("last_hit"), F.count_if(F.col("hit").isNull()).alias("unknown"))


@query(f"""WITH {_MOMENTUM_SQL} SELECT symbol, ts FROM hits WHERE hit AND ts < TIMESTAMP '2024-01-20' AND extract(hour FROM ts) >= 12 ORDER BY ts DESC, symbol LIMIT 20""")
def r13_alert_list(spark, sf_dir):
    x = evaluated(hourly(spark, sf_dir), parse(MOMENTUM)).where("hit AND ts < TIMESTAMP_NTZ '2024-01-20' AND hour(ts) >= 12")
    return x.select("symbol", "ts").orderBy(F.desc("ts"), "symbol").limit(20)
