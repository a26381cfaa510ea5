"""Outlooks against plain computations."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import outlook as o


def test_normal(spark):
    z = [-9.0, -3.2, -0.5, 0.0, 1e-9, 0.7, 2.5, 7.9]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", o.normal_cdf(F.col("z")).alias("p"), o.normal_crps(F.lit(0.0), F.lit(1.0), F.col("z")).alias("c")).collect()
    for r in got:
        assert abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-12
    draws = np.random.default_rng(1).normal(size=20000)
    spread = (2 * np.arange(1, 20001) - 20001) @ np.sort(draws) / 20000**2  # half the mean distance of two draws
    for r in got[1:7]:
        assert abs(r.c - (np.abs(draws - r.z).mean() - spread)) < 0.03
    assert spark.range(1).select(o.normal_crps(F.lit(1.0), F.lit(0.0), F.lit(3.0))).first()[0] == 2.0


def plain_grid(q):
    lq, u = np.log1p(np.maximum(q, -0.99)), np.arange(1, 200) / 200
    out = np.interp(u, o.LEVELS, lq)
    low, high = u < 0.05, u > 0.95
    out[low] = lq[0] - (lq[1] - lq[0]) / 0.05 * (0.05 - u[low]) * 1.5
    out[high] = lq[-1] + (lq[-1] - lq[-2]) / 0.05 * (u[high] - 0.95) * 1.5
    return out


def test_prior_and_scenarios(spark):
    rng = np.random.default_rng(3)
    series = {"long": np.exp(np.cumsum(rng.normal(0, 0.02, 700))), "short": np.exp(np.cumsum(rng.normal(0, 0.02, 259))), "least": np.exp(np.cumsum(rng.normal(0, 0.01, 260))), "flat": np.full(300, 5.0)}
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, start + datetime.timedelta(hours=i), float(c)) for s, cs in series.items() for i, c in enumerate(cs)]
    p = o.history_prior(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"))
    g = p.withColumn("g", o.grid(F.col("quantiles"))).withColumn("s", o.scenarios(F.col("g"), F.col("threshold_pct")))
    got = {r.symbol: r for r in g.withColumn("m", o.moved(F.col("g"), F.lit(0.9), F.lit(0.0))).collect()}
    assert set(got) == {"long", "least", "flat"}
    for s in got:
        c, r = series[s], got[s]
        n, first = len(c), max(1, len(c) - 504)
        daily = np.log(c[first:] / c[first - 1 : -1])
        ratio = np.clip(daily[-20:].std(ddof=1) / daily.std(ddof=1), 0.6, 2.5) if s != "flat" else 1
        far = np.log(c[first + 5 :] / c[first : n - 5]) * ratio
        assert r.n == len(far) and abs(r.p_up - (far > 0).mean()) < 1e-12
        assert np.allclose(r.quantiles, np.expm1(np.quantile(far, o.LEVELS)), atol=1e-12)
        t = daily[-252:].std(ddof=1) * math.sqrt(5) * 100
        assert abs(r.threshold_pct - t) < 1e-9
        want = plain_grid(np.array(r.quantiles))
        assert np.allclose(r.g, want, atol=1e-12)
        cut = math.log1p(t / 100)
        assert r.s.bull == round((want > cut).sum() / 199, 4) and r.s.bear == round((want < -cut).sum() / 199, 4)
        if (want > cut).any():
            assert abs(r.s.bull_move - np.expm1(want[want > cut]).mean() * 100) < 0.0051
        assert np.allclose(r.m, want + 0.5 * want.std(ddof=1), atol=1e-12)


def test_shrinking(spark):
    got = spark.createDataFrame([(2.0, 6.0), (2.0, 1.5), (2.0, -1.0), (-2.0, -4.0)], "m double, t double").select(o.shrunk(F.col("m"), F.col("t"))).collect()
    assert [r[0] for r in got] == [2.0, 1.0, 0.0, -0.0]


def test_series_stops_where_terms_change_nothing(spark):
    """Fewer terms near the middle give the very value of all of them."""
    z = [k / 50 for k in range(-420, 421)]

    def whole(z):
        z = min(max(z, -8.0), 8.0)
        term = total = z
        for k in range(1, 121):
            term = term * z * z / (2 * k + 1)
            total += term
        return total

    x = spark.createDataFrame([(v,) for v in z], "z double")
    clipped = F.least(F.greatest("z", F.lit(-8.0)), F.lit(8.0))
    got = x.select("z", o.normal_cdf(F.col("z")).alias("p"), o.normal_pdf(clipped).alias("d"), o.series_terms(F.col("z")).alias("n")).collect()
    assert all(r.p == 0.5 + r.d * whole(r.z) for r in got)
    assert all(r.n < 40 for r in got if abs(r.z) <= 2)
