"""Walk-forward fits against a plain loop over folds."""

import numpy as np
import pytest

from tidemark.operators import walkforward as wf


def planted(spark, sessions=40, stocks=60, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (sessions, stocks, 4))
    y = 0.02 * x[..., 0] - 0.01 * x[..., 2] + 0.01 * rng.normal(size=(sessions, stocks))
    rank = np.argsort(np.argsort(y, 1), 1) / (stocks - 1) * 2 - 1
    rows = [(s, t, *map(float, x[t, s]), float(y[t, s]), float(rank[t, s])) for t in range(sessions) for s in range(stocks)]
    return rows, spark.createDataFrame(rows, "symbol long, t long, f1 double, f2 double, f3 double, f4 double, y double, rank double")


def plain_fold(rows, start, train, h, gap):
    lo, hi = start - gap - train, start - gap - h
    mid = lo + (hi - lo) * 4 // 5
    a = np.array(rows)
    part = lambda u, v: a[(a[:, 1] >= u) & (a[:, 1] < v)]
    design = lambda z: np.hstack([np.ones((len(z), 1)), z[:, 2:6]])

    def ridge(z, y, p):
        x = design(z)
        return np.linalg.solve(x.T @ x + np.diag([0.0] + [p * len(z)] * 4), x.T @ y)

    first, last, whole = part(lo, mid), part(mid, hi), part(lo, hi)
    losses = [((last[:, 7] - design(last) @ ridge(first, first[:, 7], p)) ** 2).sum() for p in wf.PENALTIES]
    p = wf.PENALTIES[int(np.argmin(losses))]
    returns = ridge(whole, whole[:, 6], p)
    return len(whole), p, ridge(whole, whole[:, 7], p), returns, np.sqrt(np.mean((whole[:, 6] - design(whole) @ returns) ** 2))


@pytest.mark.parametrize("h,gap", [(1, 0), (3, 2)])
def test_folds_equal_a_loop(spark, h, gap):
    rows, df = planted(spark)
    models, measures = wf.walk(df, wf.FACTORS, train=15, step=5, h=h, gap=gap, least_rows=500)
    got = {r.fold: r for r in models.collect()}
    starts = list(range(15 + gap, 40, 5))
    assert sorted(got) == list(range(len(starts)))
    for k, start in enumerate(starts):
        n, penalty, ranks, returns, sd = plain_fold(rows, start, 15, h, gap)
        assert (got[k].start, got[k].n, got[k].penalty) == (start, n, penalty)
        assert np.allclose(got[k].weights, ranks) and np.allclose(got[k].returns, returns) and np.isclose(got[k].sd, sd)
    days = {r.t: r for r in measures.collect()}
    assert sorted(days) == list(range(starts[0], 40))
    a = np.array(rows)
    before = None
    for t in sorted(days):
        z, fold = a[a[:, 1] == t], got[(t - starts[0]) // 5]
        score = np.hstack([np.ones((len(z), 1)), z[:, 2:6]]) @ np.array(fold.weights)
        order = np.argsort(-score)
        assert np.isclose(days[t].ic, np.corrcoef(score, z[:, 7])[0, 1])
        assert np.isclose(days[t].spread, z[order[:6], 6].mean() - z[order[-6:], 6].mean())
        top = set(z[order[:6], 0])
        assert days[t].turnover == (None if before is None else pytest.approx(1 - len(top & before) / 6))
        before = top
        assert days[t].crps < days[t].crps0  # the planted effect pays
    assert 0.4 < np.mean([d.in50 for d in days.values()]) < 0.6 and 0.84 < np.mean([d.in90 for d in days.values()]) < 0.95


def test_outcomes_behind_the_cut_do_not_count(spark):
    rows, df = planted(spark)
    wild = df.replace({})  # same rows, but outcomes of sessions from the cut on are nonsense
    cut = 15 + 2
    from pyspark.sql import functions as F

    wild = wild.withColumn("rank", F.when(F.col("t") + 3 >= cut - 2, 9.0).otherwise(F.col("rank"))).withColumn("y", F.when(F.col("t") + 3 >= cut - 2, 9.0).otherwise(F.col("y")))
    pick = lambda d: wf.walk(d, wf.FACTORS, 15, 5, 3, 2, least_rows=500)[0].where("fold = 0").first()
    assert pick(df) == pick(wild)


def test_windows_too_small_have_no_fold(spark):
    _, df = planted(spark, 20)
    assert wf.walk(df, wf.FACTORS, 15, 5, 1, least_rows=5000)[0].count() == 0
    models, measures = wf.walk(df.limit(0), wf.FACTORS, 15, 5, 1)
    assert models.count() == 0 and measures.count() == 0
    assert wf.products(df, wf.FACTORS, least=61).count() == 0
