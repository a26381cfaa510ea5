"""Indicators, rules, backtests and models against plain computations."""

import datetime
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import forecast as fc
from tidemark.operators import indicators as ind
from tidemark.operators import ledger
from tidemark.plans import rules
from tidemark.sources import bars as sb

NAN = float("nan")


def same(a, b):
    return np.allclose(np.nan_to_num(a, nan=-1), np.nan_to_num(b, nan=-1))


def series_df(spark, closes, symbol="A"):
    rows = [(symbol, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k), *([None if c is None else float(c)] * 4), 1000.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("x,n,want", [([1, 2, 3, 4, 5], 3, [None, None, 2, 3, 4]), ([1, 2], 1, [1, 2]), ([1, 2, 3], 3, [None, None, 2]), ([1, 2], 3, [None, None]), ([-1, -3], 2, [None, -2]), ([1, None, 3, 5, 7], 2, [None, None, None, 4, 6])])
def test_sma(spark, x, n, want):
    got = [r.s for r in series_df(spark, x).select("ts", ind.sma(F.col("close"), n).alias("s")).orderBy("ts").collect()]
    assert got == want


def test_extremes_skip_holes(spark):
    got = series_df(spark, [3, None, 1, 2]).select("ts", ind.rolling(F.max, F.col("close"), 2).alias("m")).orderBy("ts").collect()
    assert [r.m for r in got] == [None, 3, 1, 2]


def test_recursive_averages():
    x = np.arange(1.0, 8.0)
    assert same(ind.ema(x, 3), [NAN, NAN, 2, 3, 4, 5, 6])
    assert same(ind.wilder(x, 3)[:4], [NAN, NAN, 2, 8 / 3])
    assert np.isnan(ind.ema(np.array([1, NAN, 3.0]), 2)).all()
    assert same(ind.ema(np.array([1, 3, NAN, 5.0]), 2), [NAN, 2, NAN, 4])
    assert np.isnan(ind.ema(x, 9)).all()


def test_rsi_edges():
    assert ind.rsi(np.arange(1.0, 20), 14)[14] == 100
    assert ind.rsi(np.ones(20), 14)[14] == 50
    assert np.isnan(ind.rsi(np.arange(20.0), 14)[:14]).all()
    assert len(ind.rsi(np.array([]), 14)) == 0


def test_macd_without_room():
    assert all(np.isnan(v).all() for v in ind.macd(np.arange(50.0), 26, 12))


def test_cleaned_variance():
    got = ind.cleaned_variance(np.array([0.01, 0.9, 0.02, 0.9]), np.array([0, 0, 0, 1]))
    assert same(got, [0.01, 0.0498, 0.02, (0.01 + 0.0498 + 0.02) / 3])


def test_indicators_do_not_look_ahead(spark):
    walk = sb.random_walk(spark, ["A", "B"], 120).cache()
    short = walk.where("ts < TIMESTAMP_NTZ '2024-01-04 00:00:00'")
    rule = rules.parse(json.dumps(rules.TEMPLATES["macd_turn"]))
    cut = lambda b: {(r.symbol, r.ts): r.hit for r in rules.evaluated(b, rule).collect()}
    whole, part = cut(walk), cut(short)
    assert part and all(whole[k] == v for k, v in part.items())


def test_rule_faults_are_all_told():
    bad = {"name": "", "all": [{"indicator": "nope", "op": "~", "value": 1}, {"indicator": "sma", "period": 0, "op": ">", "value": 1, "extra": 1}, {"any": [{"all": []}]}], "interval": "2h", "odd": 1}
    with pytest.raises(rules.RuleError) as e:
        rules.parse(json.dumps(bad))
    assert len(e.value.faults) >= 7
    for text in ("{", "[]", '{"name": "x", "all": [], "any": []}', '{"name": "x"} trailing'):
        with pytest.raises(rules.RuleError):
            rules.parse(text)


def test_rule_defaults():
    r = rules.parse(rules.MOMENTUM)
    assert r.required_bars() == 22 and r.cooldown_hours == 24
    assert rules.parse(json.dumps(rules.TEMPLATES["golden_cross"])).required_bars() == 202


def test_registered_indicators_reach_rules(spark):
    rules.register_indicator("half_close", {}, lambda p: 1, expr=lambda p: F.col("close") / 2)
    try:
        r = rules.parse('{"name": "x", "symbols": ["A"], "interval": "1h", "all": [{"indicator": "half_close", "op": "==", "value": 2}]}')
        assert [x.hit for x in rules.evaluated(series_df(spark, [4, 5]), r).orderBy("ts").collect()] == [True, False]
        with pytest.raises(ValueError):
            rules.register_indicator("none", {}, lambda p: 1)
    finally:
        rules.REGISTRY.pop("half_close")


def frame(rows):
    d = pd.DataFrame(rows, columns=["open", "high", "low", "close", "signal", "exit_signal"])
    return d.assign(symbol="A", ts=pd.date_range("2024-01-01", periods=len(rows)))


def test_fill_is_the_next_open():
    t = bt.walk(frame([(90, 90, 90, 90, False, False), (101, 101, 101, 101, True, False), (150, 160, 149, 155, False, False), (155, 156, 154, 155, False, False)]), bt.Plan(cost=0))
    assert [(x[3], x[4], x[6]) for x in t] == [(150, 155, "end")]


def test_stop_wins_and_gaps():
    up = (100, 100, 100, 100, True, False)
    both = bt.walk(frame([up, (100, 120, 90, 100, False, False)]), bt.Plan(stop=0.05, target=0.1, cost=0))
    assert (both[0][4], both[0][6], both[0][7]) == (95, "stop", True)
    gap = bt.walk(frame([up, (100, 101, 99, 100, False, False), (80, 81, 79, 80, False, False)]), bt.Plan(stop=0.05, cost=0))
    assert (gap[0][4], gap[0][6]) == (80, "stop")
    rule = bt.walk(frame([up, (100, 101, 99, 100, False, True), (98, 99, 97, 98, False, False)]), bt.Plan(stop=0.5, cost=0))
    assert (rule[0][4], rule[0][6]) == (98, "rule")
    short = bt.walk(frame([up, (100, 106, 99, 100, False, False)]), bt.Plan(stop=0.05, cost=0, long=False))
    assert short[0][4] == 105 and math.isclose(short[0][8], -0.05)


def test_backtest_does_not_look_ahead():
    rng = np.random.default_rng(2)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 200)))
    rows = [(c[max(0, k - 1)], c[k] * 1.01, c[k] * 0.99, c[k], bool(rng.random() < 0.3), bool(rng.random() < 0.2)) for k in range(200)]
    plan = bt.Plan(stop=0.03, target=0.05, hold=3)
    long = [t for t in bt.walk(frame(rows), plan) if t[2] < pd.Timestamp("2024-05-01")]
    short = [t for t in bt.walk(frame(rows[:121]), plan) if t[6] != "end"]
    assert short and short == long[: len(short)]


def test_garch_recovers_persistence():
    rng = np.random.default_rng(4)
    a, g, b, h, r = 0.03, 0.08, 0.9, 1e-4, []
    for _ in range(2000):
        x = math.sqrt(h) * rng.standard_t(6) / math.sqrt(1.5)
        r.append(x)
        h = 1e-4 * (1 - a - g / 2 - b) + (a + g * (x < 0)) * x * x + b * h
    fa, fg, fb, _, _ = fc.garch_fit(np.array(r))
    assert abs(fa + fg / 2 + fb - 0.97) < 0.06 and fg > fa


def test_regimes_recover_states():
    rng = np.random.default_rng(5)
    s = np.zeros(1500, int)
    for k in range(1, 1500):
        s[k] = s[k - 1] if rng.random() < 0.97 else 1 - s[k - 1]
    _, sd, _, p = fc.regimes(rng.normal(0, np.where(s, 0.022, 0.007)))
    assert sd[0] < sd[1] and ((p[:, 1] > 0.5) == s).mean() > 0.85


def test_regimes_query_runs_all_rounds(spark, monkeypatch):
    r = np.random.default_rng(2).standard_t(12, 150) * 0.01  # hardly two states, so the rounds go on for long
    df = spark.createDataFrame([(k, float(c)) for k, c in enumerate(np.exp(np.r_[0, r.cumsum()]))], "ts long, mclose double")
    monkeypatch.setattr(fc, "market", lambda *_: df)
    mu, sd, _, p = fc.regimes(r, 200)
    assert not np.allclose(sd, fc.regimes(r, 50)[1], rtol=1e-3, atol=0)
    got = fc.f13_regimes(spark, "").orderBy("state").collect()
    assert np.allclose([(g["mean"], g["deviation"], g["now"]) for g in got], np.c_[mu, sd, p[-1]], rtol=1e-4, atol=1e-9)


def test_ridge_query_learns_from_all_sessions(spark, sf01_dir):
    rows = fc.learning_rows(spark, sf01_dir).toPandas()
    x, y = np.c_[np.ones(len(rows)), rows[["f1", "f2", "f3", "f4"]].to_numpy(float)], rows["y"].to_numpy(float)
    w = np.linalg.solve(x.T @ x + 0.01 * len(rows) * np.diag([0, 1, 1, 1, 1]), x.T @ y)
    assert rows["t"].max() > 20 and np.allclose([r.weight for r in fc.f8_ridge(spark, sf01_dir).collect()], w, atol=2e-6)


def test_luck_draws_as_many_entries_as_trips(spark):
    close, trips = np.random.default_rng(8).lognormal(4, 0.05, 120), 45
    bars = spark.createDataFrame([("A", k, float(c)) for k, c in enumerate(close)], "symbol string, ts long, close double")
    done = spark.createDataFrame([("A", 0.004, 2)] * trips + [("B", 0.1, 1)] * 9, "symbol string, ret double, bars int")
    picks = spark.range(1, 301).select(F.col("id").cast("int").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(trips))).alias("d")).select("s", F.pmod(F.xxhash64("s", "d", F.lit(11)), F.lit(118)).alias("k")).orderBy("s", "d").collect()
    k = np.array([p.k for p in picks]).reshape(300, trips)
    want = float(((close[k + 2] / close[k] - 1).mean(1) < 0.004).mean() * 100)
    got = ledger.luck(done, bars, 300).collect()
    assert [(r.symbol, round(r.percentile, 9)) for r in got] == [("A", round(want, 9))] and 0 < want < 100


def test_luck_query_runs_a_thousand_simulations(spark, sf_dir):
    full = ledger.luck(bt._one_bar(spark, sf_dir), sb.hourly(spark, sf_dir), 1000)
    want = {r.symbol: r.percentile for r in full.collect()}
    assert want and {r.symbol: r.percentile for r in ledger.b12_luck_test(spark, sf_dir).collect()} == want


def test_boosted_trees_find_an_interaction(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (4000, 4))
    y = 0.3 * np.sign(x[:, 0]) * x[:, 1] + rng.normal(0, 0.05, 4000)
    rows = spark.createDataFrame(pd.DataFrame({**{f"f{k + 1}": x[:, k] for k in range(4)}, "y": y})).cache()
    base, model = fc.boosted(rows, ["f1", "f2", "f3", "f4"], "y", trees=6, depth=3, rate=0.5, penalty=5)
    got = np.array([r.p for r in rows.select(fc.boosted_score(base, model, 3).alias("p")).collect()])
    assert ((y - got) ** 2).sum() < 0.7 * ((y - y.mean()) ** 2).sum()


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(500, 2)), rng.normal(size=500)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    z = np.column_stack([np.ones(500), x])
    want = np.linalg.solve(z.T @ z + np.diag([0, 5.0, 5.0]), z.T @ y)
    assert np.allclose(fc.ridge(rows, ["a", "b"], "y"), want)


def test_walk_forward_finds_a_planted_effect(spark):
    rng = np.random.default_rng(8)
    rows = [(t, float(f), float(0.5 * f + rng.normal())) for t in range(40) for f in rng.uniform(-1, 1, 60)]
    got = fc.walk_forward(spark.createDataFrame(rows, "t int, f1 double, y double").cache(), ["f1"], "y").collect()
    assert len(got) == 24 and np.mean([r.ic for r in got]) > 0.15


def test_crps_of_a_normal_sample(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([([float(v) for v in rng.normal(0, 0.02, 3000)], 0.01)], "x array<double>, y double")
    r = df.select(fc.crps(F.col("x"), F.col("y")).alias("c"), fc.pit(F.col("x"), F.col("y")).alias("p")).first()
    z = 0.5
    pdf, cdf = math.exp(-z * z / 2) / math.sqrt(2 * math.pi), 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert abs(r.c - 0.02 * (z * (2 * cdf - 1) + 2 * pdf - 1 / math.sqrt(math.pi))) < 0.0006 and abs(r.p - cdf) < 0.03


def test_isotonic():
    assert fc.pooled_adjacent([0.1, 0.4, 0.2, 0.9], [1, 1, 1, 1]) == pytest.approx([0.1, 0.3, 0.3, 0.9])
    assert fc.pooled_adjacent([], []) == []


def test_simulation_is_repeatable(spark):
    pool = spark.createDataFrame([("A", float(z)) for z in np.random.default_rng(1).normal(0, 0.01, 300)], "symbol string, z double")
    a, b = (fc.simulated(pool, 500).collect() for _ in range(2))
    assert a == b and all(r.q05 < r.q50 < r.q95 for r in a)


def test_har_against_numpy(spark):
    index = sb.random_walk(spark, ["M"], 500, seed=9).selectExpr("ts", "close AS mclose")
    rows = fc.har_rows(sb.random_walk(spark, ["A", "B", "C"], 500), index)
    assert fc.har(rows.limit(50)) is None
    x = np.array([[1.0, *(r[c] for c in fc.HAR)] for r in rows.collect()])
    y = np.array([r.y for r in rows.collect()])
    assert len(y) >= 200
    want = np.linalg.solve(x.T @ x / 1 + 1e-6 * len(y) * np.diag([0, *[1] * len(fc.HAR)]), x.T @ y)
    w, smear = fc.har(rows)
    assert np.allclose(w, want, rtol=1e-5, atol=1e-6)
    ratios = np.exp(y - x @ want)
    assert abs(smear - np.minimum(ratios, np.sort(ratios)[int(len(ratios) * 0.99)]).mean()) < 0.02


def test_stretches_do_not_change_what_fires(spark):
    """A plain walk over all hits of a key."""
    pick = np.random.default_rng(5)
    hours = {k: sorted(pick.choice(2000, 300, replace=False).tolist()) for k in "ab"}
    df = spark.createDataFrame([(k, int(h)) for k, x in hours.items() for h in x], "symbol string, h long").selectExpr("symbol", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS ts")
    got = {(r.symbol, r.ts) for r in rules.cooled(df, ["symbol"], 10).collect()}
    want, start = set(), pd.Timestamp("2024-01-01")
    for k, x in hours.items():
        last = None
        for h in x:
            if last is None or h >= last + 10:
                last = h
                want.add((k, (start + pd.Timedelta(hours=h)).to_pydatetime()))
    assert got == want
