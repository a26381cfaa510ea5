"""Walk-forward fits of linear return models (F30, F22): every fold from one pass over the panel.

Each session's cross products of factors and targets are summed once, into one small row a session. A fold's training
window is a difference of two prefix sums of that table, so windows that overlap cost nothing, and so does the choice of
the penalty, whose loss on the last fifth of a window follows from the sums of that fifth. Folds are solved in tasks, one
small system each; weights go back to the tested sessions in a broadcast join of one row a fold, and a second pass over
them gives all measures.

An outcome counts as known if it lies before the cut: sessions t of a window have t + h < cut. Sessions with too few
outcomes give no products; a window with under ``least_rows`` rows, or under half of them in its first four fifths, has no
fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import unit_rank
from tidemark.operators.forecast import _PANEL_SQL, panel
from tidemark.operators.indicators import r6, series
from tidemark.operators.outlook import normal_cdf, normal_crps
from tidemark.registry import query

FACTORS = ["f1", "f2", "f3", "f4"]
PENALTIES = [0.001, 0.01, 0.1, 1.0]


def model_rows(spark, sf_dir, h: int) -> DataFrame:
    """(symbol, t, f1..f4, y, rank): ranked factors of the panel, the return over the next ``h`` sessions and its rank."""
    lag = lambda n: F.lag("close", n).over(series())
    x = panel(spark, sf_dir).select(
        "symbol", "t", (F.col("close") / lag(1) - 1).alias("a"), (F.col("close") / lag(3) - 1).alias("b"), F.ln(1 + F.col("volume")).alias("c"), (F.col("high") / F.col("low") - 1).alias("d"),
        F.ln(F.lead("close", h).over(series()) / F.col("close")).alias("y"),
    )
    x = x.where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
    return x.select("symbol", "t", *[unit_rank(F.col(c), ["t"]).alias(f"f{k}") for k, c in enumerate("abcd", 1)], "y", unit_rank(F.col("y"), ["t"]).alias("rank"))


def _terms(x: list[str]) -> list[tuple[Column, Column]]:
    """What a session sums: products of the intercept and the factors, those with both targets, the targets' squares."""
    one = [F.lit(1.0), *map(F.col, x)]
    pairs = [(one[i], one[j]) for i in range(len(one)) for j in range(i, len(one))]
    return [*pairs, *[(c, F.col(y)) for y in ("rank", "y") for c in one], (F.col("rank"), F.col("rank")), (F.col("y"), F.col("y"))]


def products(rows: DataFrame, x: list[str], least: int = 30) -> DataFrame:
    """(t, n, p0, p1, ...): one row for each session with ``least`` outcomes, its sums in the order of ``_terms``."""
    sums = [F.sum(a * b).alias(f"p{k}") for k, (a, b) in enumerate(_terms(x))]
    return rows.groupBy("t").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)


def plan(days: DataFrame, train: int, step: int, h: int, gap: int) -> DataFrame:
    """(fold, start, lo, mid, hi): tested from ``start`` on, ``step`` sessions; windows [lo, hi) with their first four fifths
    before ``mid``; only sessions with outcomes known ``gap`` sessions before the start."""
    ends = days.agg(F.min("t").alias("first"), F.max("t").alias("last"))  # one row
    at = ends.where(F.col("first") + train + gap <= F.col("last")).select("first", F.posexplode(F.sequence(F.col("first") + train + gap, F.col("last"), F.lit(step))).alias("fold", "start"))
    lo, hi = F.col("start") - gap - train, F.col("start") - gap - h
    return at.select("fold", "start", lo.alias("lo"), (lo + F.floor((hi - lo) * 4 / 5)).cast("long").alias("mid"), hi.alias("hi"))


def systems(days: DataFrame, folds: DataFrame) -> DataFrame:
    """``folds`` with (n, s) and (n4, s4): rows and sums of the window and of its first four fifths, as differences of
    prefix sums over ``days``, which has one row a session."""
    names = [c for c in days.columns if c != "t"]
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # one row a session
    ends = days.agg(F.min("t").alias("first"), F.max("t").alias("last"))
    every = ends.select(F.explode(F.sequence(F.col("first") - 1, F.col("last"))).alias("t")).join(days, "t", "left")
    prefix = every.select("t", F.array(*[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("double") for c in names]).alias("s"))
    at = lambda c, name: prefix.select((F.col("t") + 1).alias(c), F.col("s").alias(name))
    x = folds.join(at("lo", "a"), "lo").join(at("mid", "b"), "mid").join(at("hi", "c"), "hi")
    minus = lambda u, v: F.zip_with(u, v, lambda p, q: p - q)
    x = x.withColumn("w", minus("c", "a")).withColumn("w4", minus("b", "a"))
    rest = lambda c: F.slice(c, 2, len(names) - 1)
    return x.select("fold", "start", "lo", "mid", "hi", F.get("w", F.lit(0)).cast("long").alias("n"), F.get("w4", F.lit(0)).cast("long").alias("n4"), rest("w").alias("s"), rest("w4").alias("s4"))


def _unpacked(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X'X, X'y of both targets, squares of both) of the sums of ``_terms``."""
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = s[: k * (k + 1) // 2]
    xx = xx + xx.T - np.diag(xx.diagonal())
    at = k * (k + 1) // 2
    return xx, s[at : at + 2 * k].reshape(2, k).T, s[-2:]


def _solved(xx: np.ndarray, xy: np.ndarray, penalty: float) -> np.ndarray:
    return np.linalg.solve(xx + np.diag([0.0] + [penalty * xx[0, 0]] * (len(xx) - 1)), xy)


def fitted(windows: DataFrame, factors: int, penalties: list[float] = PENALTIES, least_rows: int = 5000) -> DataFrame:
    """(fold, start, n, penalty, weights, returns, sd, mean0, sd0): for each fold of ``systems`` the penalty that loses
    least on the last fifth of its window, the weights of ranks and of returns on the whole of it, the spread that returns
    leave, and the mean and spread of returns by themselves."""
    k = factors + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                whole, first = np.asarray(r.s, float), np.asarray(r.s4, float)
                (xx, xy, yy), (xx4, xy4, _) = _unpacked(whole, k), _unpacked(first, k)
                xx1, xy1, yy1 = _unpacked(whole - first, k)
                losses = []
                for p in penalties:
                    w = _solved(xx4, xy4[:, 0], p)
                    losses.append(yy1[0] - 2 * w @ xy1[:, 0] + w @ xx1 @ w)
                best = penalties[int(np.argmin(losses))]
                w = _solved(xx, xy, best)
                left = yy[1] - 2 * w[:, 1] @ xy[:, 1] + w[:, 1] @ xx @ w[:, 1]
                mean = xy[0, 1] / r.n
                out.append((r.fold, r.start, r.n, best, w[:, 0], w[:, 1], max(left / r.n, 0.0) ** 0.5, mean, max(yy[1] / r.n - mean * mean, 0.0) ** 0.5))
            yield pd.DataFrame(out, columns=["fold", "start", "n", "penalty", "weights", "returns", "sd", "mean0", "sd0"])

    enough = windows.where((F.col("n") >= least_rows) & (F.col("n4") >= F.col("n") / 2) & (F.col("n4") > 0) & (F.col("n4") < F.col("n")))
    return enough.mapInPandas(solve, "fold int, start long, n long, penalty double, weights array<double>, returns array<double>, sd double, mean0 double, sd0 double")


def predicted(rows: DataFrame, models: DataFrame, x: list[str], step: int) -> DataFrame:
    """``rows`` of tested sessions with their fold's score (of ranks) and expected return ``mu``. Models are one row a fold."""
    m = models.withColumn("t", F.explode(F.sequence(F.col("start"), F.col("start") + step - 1)))
    both = rows.join(F.broadcast(m.drop("n", "start", "penalty")), "t")
    dot = lambda w: F.get(w, F.lit(0)) + sum(F.get(w, F.lit(k)) * F.col(c) for k, c in enumerate(x, 1))
    return both.withColumn("score", dot(F.col("weights"))).withColumn("mu", dot(F.col("returns"))).drop("weights", "returns")


def measured(scores: DataFrame) -> DataFrame:
    """One row for each tested session: rank IC, the mean return of the top tenth less that of the bottom tenth, the share
    of the top tenth that is new, CRPS of the normal forecast and of the plain one, mean PIT, shares in the bands."""
    by = Window.partitionBy("t")
    tenth = F.greatest(F.lit(1), F.floor(F.count("*").over(by) / 10))
    up, down = F.row_number().over(by.orderBy(F.desc("score"), "symbol")), F.row_number().over(by.orderBy("score", F.desc("symbol")))
    z = F.try_divide(F.col("y") - F.col("mu"), F.col("sd"))
    p = scores.withColumn("top", up <= tenth).withColumn("bottom", down <= tenth).withColumn("cdf", normal_cdf(z)).withColumn("pit", F.when(F.col("sd") > 0, F.col("cdf")).otherwise(0.5))
    p = p.withColumn("crps", normal_crps(F.col("mu"), F.col("sd"), F.col("y"), F.col("cdf"))).withColumn("crps0", normal_crps(F.col("mean0"), F.col("sd0"), F.col("y")))
    inside = lambda a: F.avg(F.col("pit").between(a, 1 - a).cast("double"))
    days = p.groupBy("t", "fold").agg(
        F.count("*").alias("n"), F.corr("score", "rank").alias("ic"), (F.avg(F.when(F.col("top"), F.col("y"))) - F.avg(F.when(F.col("bottom"), F.col("y")))).alias("spread"),
        F.avg("crps").alias("crps"), F.avg("crps0").alias("crps0"), F.avg("pit").alias("pit"), inside(0.25).alias("in50"), inside(0.1).alias("in80"), inside(0.05).alias("in90"), F.count_if("top").alias("tops"),
    )
    nth = Window.orderBy("t")  # one row a session
    days = days.withColumn("k", F.row_number().over(nth))
    top = p.where("top").select("t", "symbol").join(F.broadcast(days.select("t", "k")), "t")
    same = top.withColumn("stays", F.lag("k").over(Window.partitionBy("symbol").orderBy("k")) == F.col("k") - 1).groupBy("t").agg(F.count_if("stays").alias("stays"))
    turnover = F.when(F.col("k") > 1, 1 - F.col("stays") / F.col("tops"))
    return days.join(same, "t").withColumn("turnover", turnover).drop("k", "stays", "tops")


def walk(rows: DataFrame, x: list[str], train: int, step: int, h: int, gap: int = 0, least: int = 30, least_rows: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(models, measures) of all folds."""
    days = products(rows, x, least)
    models = fitted(systems(days, plan(days, train, step, h, gap)), len(x), least_rows=least_rows)
    return models, measured(predicted(rows.join(F.broadcast(days.select("t")), "t"), models, x, step))


# SQL twins: sums over windows in place of prefix sums, elimination in place of a solver.

H, TRAIN, STEP, GAP, LEAST, LEAST_ROWS = 2, 12, 4, 1, 10, 60


def _rank(c: str) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN (rank() OVER (PARTITION BY t ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY t, {c}) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY t) - 1) * 2 - 1 ELSE 0 END"


_ROWS = f"""{_PANEL_SQL}, raw AS (SELECT symbol, t, close / lag(close) OVER w - 1 AS a, close / lag(close, 3) OVER w - 1 AS b, ln(1 + volume) AS c, high / low - 1 AS d, ln(lead(close, {H}) OVER w / close) AS y FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY t)),
sound AS (SELECT * FROM raw WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
rows_ AS (SELECT symbol, t, {", ".join(f"{_rank(c)} AS f{k}" for k, c in enumerate("abcd", 1))}, y, {_rank("y")} AS rank FROM sound)"""
_ONE = ["1.0::DOUBLE", *FACTORS]
_PAIRS = [*[(a, b) for i, a in enumerate(_ONE) for b in _ONE[i:]], *[(a, y) for y in ("rank", "y") for a in _ONE], ("rank", "rank"), ("y", "y")]
_DAYS = f"{_ROWS}, days AS (SELECT t, count(*) AS n, {', '.join(f'sum({a} * {b}) AS p{k}' for k, (a, b) in enumerate(_PAIRS))} FROM rows_ GROUP BY t HAVING count(*) >= {LEAST})"
_ALL = ["n", *[f"p{k}" for k in range(len(_PAIRS))]]
_FOLDS = f"""{_DAYS}, ends AS (SELECT min(t) AS first, max(t) AS last FROM days), starts AS (SELECT unnest(range(first + {TRAIN + GAP}, last + 1, {STEP})) AS start, first FROM ends),
folds AS (SELECT CAST((start - first - {TRAIN + GAP}) // {STEP} AS INT) AS fold, start, start - {GAP + TRAIN} AS lo, start - {GAP + TRAIN} + CAST(floor({TRAIN - H} * 4 / 5.0) AS BIGINT) AS mid, start - {GAP + H} AS hi FROM starts),
windows AS (SELECT fold, start, lo, mid, hi, {", ".join(f"coalesce(sum(d.{c}), 0) AS {c}, coalesce(sum(d.{c}) FILTER (d.t < mid), 0) AS q_{c}" for c in _ALL)} FROM folds LEFT JOIN days d ON d.t >= lo AND d.t < hi GROUP BY 1, 2, 3, 4, 5)"""


def _place(i: int, j: int) -> int:
    i, j = min(i, j), max(i, j)
    return i * 5 - i * (i - 1) // 2 + j - i


def _eliminated() -> str:
    """CTEs that solve five equations with two right sides (columns a00..a46), one pivot after another, to e5."""
    out = []
    for k in range(5):
        cells = []
        for i in range(5):
            for j in range(k + 1, 7):
                cells.append(f"a{k}{j} / a{k}{k} AS a{k}{j}" if i == k else f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}")
        out.append(f"e{k + 1} AS (SELECT fold, part, penalty, {', '.join(cells)} FROM e{k})")
    return ", ".join(out)


def _system(part: str, prefix: str) -> str:
    cells = [f"{prefix}p{_place(i, j)}" + (f" + penalty * {prefix}p0" if i == j and i else "") + f" AS a{i}{j}" for i in range(5) for j in range(5)]
    cells += [f"{prefix}p{15 + 5 * y + i} AS a{i}{5 + y}" for i in range(5) for y in range(2)]
    return f"SELECT fold, '{part}' AS part, penalty, {', '.join(cells)} FROM enough, (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty)"


def _form(w: str, p: str, q: str = "") -> str:
    """The sum of squares that weights {w}0.. leave of target 0 (or 1), from sums {p}p.. less {q}p.."""
    y, cell = (1 if w.startswith("r") else 0), lambda k: f"({p}p{k} - {q}p{k})" if q else f"{p}p{k}"
    return cell(25 + y) + "".join(f" - 2 * {w}{i} * {cell(15 + 5 * y + i)}" for i in range(5)) + "".join(f" + {w}{i} * {w}{j} * {cell(_place(i, j))}" for i in range(5) for j in range(5))


_MODELS = f"""{_FOLDS}, enough AS (SELECT * FROM windows WHERE n >= {LEAST_ROWS} AND q_n >= n / 2.0 AND q_n > 0 AND q_n < n),
e0 AS ({_system('first', 'q_')} UNION ALL {_system('whole', '')}), {_eliminated()},
solved AS (SELECT fold, part, penalty, {", ".join(f"a{i}5 AS w{i}, a{i}6 AS r{i}" for i in range(5))} FROM e5),
tried AS (SELECT s.fold, s.penalty, {_form('w', '', 'q_')} AS loss FROM solved s JOIN enough USING (fold) WHERE part = 'first'),
chosen AS (SELECT fold, arg_min(penalty, loss) AS penalty FROM tried GROUP BY fold),
models AS (SELECT fold, start, n, penalty, {", ".join(f"w{i}, r{i}" for i in range(5))}, sqrt(greatest(({_form('r', '')}) / n, 0)) AS sd, p20 / n AS mean0, sqrt(greatest(p26 / n - pow(p20 / n, 2), 0)) AS sd0
 FROM solved JOIN chosen USING (fold, penalty) JOIN enough USING (fold) WHERE part = 'whole')"""
_Z = "least(greatest((y - {m}) / nullif({s}, 0), -8), 8)"
_CDF = "(0.5::DOUBLE + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z) * list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2::DOUBLE) - lgamma(k + 1.5::DOUBLE) + ln(pi()) / 2))))"


def _crps(m: str, s: str, z: str) -> str:
    raw = f"((y - {m}) / {s})"
    return f"CASE WHEN {s} > 0 THEN {s} * ({raw} * (2 * {_CDF.replace('(z)', f'({z})').replace('-z * z', f'-{z} * {z}')} - 1) + 2 * exp(-{raw} * {raw} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) ELSE abs(y - {m}) END"


_WALK = f"""{_MODELS}, scored AS (SELECT r.*, m.fold, sd, mean0, sd0, w0 + w1 * f1 + w2 * f2 + w3 * f3 + w4 * f4 AS score, r0 + r1 * f1 + r2 * f2 + r3 * f3 + r4 * f4 AS mu
 FROM rows_ r JOIN days USING (t) JOIN models m ON r.t >= m.start AND r.t < m.start + {STEP}),
marked AS (SELECT *, {_Z.format(m="mu", s="sd")} AS z, {_Z.format(m="mean0", s="sd0")} AS z0, greatest(1, count(*) OVER d // 10) AS tenth, row_number() OVER (PARTITION BY t ORDER BY score DESC, symbol) AS up, row_number() OVER (PARTITION BY t ORDER BY score, symbol DESC) AS down FROM scored WINDOW d AS (PARTITION BY t)),
judged AS (SELECT *, CASE WHEN sd > 0 THEN {_CDF} ELSE 0.5 END AS pit, {_crps('mu', 'sd', 'z')} AS crps, {_crps('mean0', 'sd0', 'z0')} AS crps0 FROM marked),
tested AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM judged)),
kept AS (SELECT a.t, count(b.symbol) AS stays FROM (SELECT t, k, symbol FROM judged JOIN tested USING (t) WHERE up <= tenth) a LEFT JOIN (SELECT k, symbol FROM judged JOIN tested USING (t) WHERE up <= tenth) b ON b.symbol = a.symbol AND b.k = a.k - 1 GROUP BY 1)"""


@query(f"WITH {_DAYS} SELECT t, n, {', '.join(f'round(p{k}, 6) + 0.0::DOUBLE AS p{k}' for k in range(len(_PAIRS)))} FROM days")
def f30_session_products(spark, sf_dir):
    """The table that all folds are summed from."""
    days = products(model_rows(spark, sf_dir, H), FACTORS, LEAST)
    # Sums of ranks are 0 up to a sign.
    return days.select("t", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in days.columns if c.startswith("p")])


@query(f"WITH {_MODELS} SELECT fold, start, n, penalty, {', '.join(f'round(w{i}, 6) AS w{i}, round(r{i}, 6) AS r{i}' for i in range(5))}, round(sd, 6) AS sd, round(sd0, 6) AS sd0 FROM models")
def f30_fold_models(spark, sf_dir):
    """Each fold's penalty and weights of ranks and returns; windows of 12 sessions here, as the panel has thirty."""
    days = products(model_rows(spark, sf_dir, H), FACTORS, LEAST)
    m = fitted(systems(days, plan(days, TRAIN, STEP, H, GAP)), len(FACTORS), least_rows=LEAST_ROWS)
    each = [c for i in range(5) for c in (r6(f"w{i}", F.get("weights", F.lit(i))), r6(f"r{i}", F.get("returns", F.lit(i))))]
    return m.select("fold", "start", "n", "penalty", *each, r6("sd", F.col("sd")), r6("sd0", F.col("sd0")))


@query(f"""WITH {_WALK} SELECT t, fold, count(*) AS n, round(corr(score, rank), 6) AS ic, round(avg(y) FILTER (up <= tenth) - avg(y) FILTER (down <= tenth), 6) AS spread, round(avg(crps), 6) AS crps, round(avg(crps0), 6) AS crps0, round(avg(pit), 6) AS pit,
 round(avg(CASE WHEN pit BETWEEN 0.25 AND 0.75 THEN 1.0::DOUBLE ELSE 0 END), 6) AS in50, round(avg(CASE WHEN pit BETWEEN 0.1 AND 0.9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS in80, round(avg(CASE WHEN pit BETWEEN 0.05 AND 0.95 THEN 1.0::DOUBLE ELSE 0 END), 6) AS in90,
 round(CASE WHEN any_value(k) > 1 THEN 1 - any_value(stays)::DOUBLE / any_value(tenth) END, 6) AS turnover FROM judged JOIN tested USING (t) JOIN kept USING (t) GROUP BY t, fold""")
def f22_walk_measures(spark, sf_dir):
    """All measures of each tested session's own forecasts."""
    _, m = walk(model_rows(spark, sf_dir, H).cache(), FACTORS, TRAIN, STEP, H, GAP, LEAST, LEAST_ROWS)
    return m.select("t", "fold", "n", *[r6(c, F.col(c)) for c in ("ic", "spread", "crps", "crps0", "pit", "in50", "in80", "in90", "turnover")])
