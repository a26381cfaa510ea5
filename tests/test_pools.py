"""Shock pools, report jumps and percentile maps against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pools

KIND = "symbol long, sector long, t long, r double, m double, report boolean"


def made(seed=1, symbols=4, n=120):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.02, n)
    out = []
    for s in range(symbols):
        every = [9, 30, 12, 1000][s % 4]
        for t in range(n):
            hit = t > 0 and t % every == 0
            out.append((s, s // 2, t, None if t == 0 else float(0.8 * m[t] + rng.normal(0, 0.02) + hit * rng.normal(0, 0.4)), float(m[t]), hit))
    return out


def plain(rows, window, least):
    """Residuals of one symbol in a loop."""
    beta, idio = [], []
    for k, (_, _, _, r, m, hit) in enumerate(rows):
        raw = None if r is None else r - (beta[-1] if beta else 1.0) * m
        idio.append(raw if raw is None or hit else float(np.clip(raw, -0.223, 0.223)))
        x = [(q[3], q[4]) for q in rows[max(0, k - window + 1) : k + 1] if q[3] is not None and not q[5]]
        a = np.array(x).reshape(-1, 2)
        beta.append(0.67 * np.cov(a.T, bias=True)[0, 1] / a[:, 1].var() + 0.33 if len(x) > least else 1.0)
    return beta, idio


@pytest.fixture(scope="module")
def data(spark):
    rows = made()
    return rows, pools.residuals(spark.createDataFrame(rows, KIND), 40, 20).cache()


def test_residuals_and_pools(data):
    rows, x = data
    got = {(q.symbol, q.t): q for q in x.collect()}
    z = {}
    for q in pools.standardised_pool(x, "idio", 60, 10, 30, F.col("report")).collect():
        z.setdefault(q.symbol, {})[q.t] = q.z
    for s in range(4):
        mine = [q for q in rows if q[0] == s]
        beta, idio = plain(mine, 40, 20)
        assert np.allclose([got[s, t].beta for t in range(120)], beta)
        assert np.allclose([got[s, t].idio for t in range(1, 120)], idio[1:])
        raw = {}
        for t in range(60, 120):
            if not mine[t][5]:
                raw[t] = idio[t] / np.sqrt(np.mean([idio[k] ** 2 for k in range(t - 10, t) if not mine[k][5]]))
        v = np.array(list(raw.values()))
        assert z[s].keys() == raw.keys() and np.allclose([z[s][t] for t in raw], (v - v.mean()) / v.std(ddof=1))
    assert pools.standardised_pool(x, "idio", 60, 10, 61).count() == 0


def test_jumps_fall_back_to_the_sector(data):
    rows, x = data
    got = {q.symbol: q for q in pools.report_jumps(x, year=30, settled=5).collect()}
    assert {s: q.origin for s, q in got.items()} == {0: "own", 1: "sector", 2: "own", 3: "sector"}
    idio = {s: plain([q for q in rows if q[0] == s], 40, 20)[1] for s in range(4)}
    hit = {s: [q[2] for q in rows if q[0] == s and q[5]] for s in range(4)}
    own = np.array([idio[0][t] for t in hit[0]])
    assert np.allclose(sorted(got[0].jumps), sorted(own - own.mean()))
    calm = lambda s, lo, hi: np.sqrt(np.mean([idio[s][k] ** 2 for k in range(max(lo, 1), hi) if k not in hit[s]]))
    sector = np.array([idio[s][t] / calm(s, t - 30, t) for s in (0, 1) for t in hit[s] if t > 5]) * calm(1, 90, 120)
    assert np.allclose(sorted(got[1].jumps), sorted(sector - sector.mean()))


def test_jumps_without_sector_or_reports(spark):
    lone = [(s, None if s == 2 else 7, t, 0.01 * (-1) ** t, 0.0, s == 2 and t in (5, 9)) for s in (1, 2) for t in range(20)]
    x = pools.residuals(spark.createDataFrame(lone, KIND), 10, 5)
    assert pools.report_jumps(x, 5, 2).count() == 0
    none = pools.residuals(spark.createDataFrame([], KIND))
    assert pools.report_jumps(none).count() == 0 and pools.standardised_pool(none, "idio", 9).count() == 0


def test_percentile_map(spark):
    rng = np.random.default_rng(3)
    many, few = rng.beta(2, 2, 300), rng.beta(2, 2, 50)
    df = spark.createDataFrame([("many", float(p)) for p in many] + [("few", float(p)) for p in few] + [("none", None)], "k string, pit double")
    taus = [0.0005, 0.1, 0.5, 0.9]
    got = {q.k: (q.n, q.levels) for q in pools.level_map(df, ["k"], taus).collect()}
    half = lambda x: np.clip([t + 0.5 * (np.quantile(x, t) - t) for t in taus], 0.001, 0.999)
    assert got["few"] == (50, taus) and got["none"] == (0, taus)
    assert got["many"][0] == 300 and np.allclose(got["many"][1], half(many))
    assert got[None][0] == 350 and np.allclose(got[None][1], half(np.concatenate([many, few])))


def test_reading_draws(spark):
    x = spark.createDataFrame([([1.0, 2.0, 4.0], 2.0), ([3.0], 1.0)], "x array<double>, y double")
    got = x.select(pools.split_pit(F.col("x"), F.col("y")), *[pools.read_at(F.col("x"), F.lit(t)) for t in (0.0, 0.25, 0.75, 1.0)]).collect()
    assert [tuple(q) for q in got] == [(0.5, 1.0, 1.5, 3.0, 4.0), (0.25, 3.0, 3.0, 3.0, 3.0)]


def test_symbols_do_not_meet_in_their_sector(spark):
    rows = [(s, s % 2, t, 0.01 * ((s * 7 + t * 3) % 11 - 5), 0.0, t % 4 == 0) for s in range(6) for t in range(40)]
    x = spark.createDataFrame(rows, "symbol long, sector long, t long, r double, m double, report boolean")
    jumps = pools.report_jumps(pools.residuals(x, 10, 5), 10, 5, own=99)
    got = jumps.collect()
    assert len(got) == 6 and all(r.origin == "sector" and abs(sum(r.jumps)) < 1e-9 for r in got)
    plan = jumps._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and plan.count("aggregate(raw") <= 1
