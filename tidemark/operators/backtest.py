"""Backtests over bars (B1-B4, A16, A17). Signals are columns over windows that end at their bar; the path of positions is
folded over one symbol's bars at a time."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import last_n, r6, series, sma
from tidemark.registry import query
from tidemark.sources.bars import HOURLY_SQL, hourly


@dataclass(frozen=True)
class Plan:
    stop: float | None = None
    target: float | None = None
    hold: int | None = None
    cost: float = 0.0005
    long: bool = True


TRADES = "symbol string, entry_at timestamp_ntz, exit_at timestamp_ntz, entry double, exit double, bars int, reason string, ambiguous boolean, ret double"


def trade_return(x, cost: float, long: bool = True):
    """Of the price relation x of exit to entry, costs on both sides."""
    return x * (1 - cost) - (1 + cost) if long else (1 - cost) - x * (1 + cost)


def walk(bars: pd.DataFrame, plan: Plan) -> list[tuple]:
    """Trades of one symbol: a signal on a bar fills at the next open (its close if there is no open), one position at a
    time; stop before target inside a bar, then the hold at its close; an exit rule fills at the next open; the last bar
    closes what is left. A bar that closes a position may open the next."""
    o, h, low, c = (bars[k].to_numpy(float) for k in ("open", "high", "low", "close"))
    # Unknown signals are none.
    enter, leave, ts = (bars["signal"] == True).to_numpy(bool), (bars["exit_signal"] == True).to_numpy(bool), bars["ts"].to_list()  # noqa: E712
    out, since, price = [], None, 0.0
    sign = 1 if plan.long else -1

    def close(i: int, at: float, reason: str, ambiguous: bool = False) -> None:
        nonlocal since
        out.append((bars["symbol"].iloc[0], ts[since], ts[i], price, at, i - since, reason, ambiguous, trade_return(at / price, plan.cost, plan.long)))
        since = None

    for i in range(1, len(bars)):
        opened = o[i] if o[i] > 0 else c[i]
        if since is not None and leave[i - 1]:
            close(i, opened, "rule")
        if since is None and enter[i - 1]:
            since, price = i, opened
        if since is None:
            continue
        stop = price * (1 - sign * plan.stop) if plan.stop else None
        target = price * (1 + sign * plan.target) if plan.target else None
        hit_stop = stop is not None and (low[i] <= stop if plan.long else h[i] >= stop)
        hit_target = target is not None and (h[i] >= target if plan.long else low[i] <= target)
        if hit_stop:
            gap = opened <= stop if plan.long else opened >= stop
            close(i, opened if gap and since < i else stop, "stop", hit_target)
        elif hit_target:
            gap = opened >= target if plan.long else opened <= target
            close(i, opened if gap and since < i else target, "target")
        elif plan.hold and i - since >= plan.hold:
            close(i, c[i], "hold")
    if since is not None:
        close(len(bars) - 1, c[-1], "end")
    return out


def trades(bars: DataFrame, plan: Plan) -> DataFrame:
    """``bars`` with boolean columns signal and exit_signal to trades."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(walk(pdf.sort_values("ts").reset_index(drop=True), plan), columns=[f.split()[0] for f in TRADES.split(", ")])

    return bars.groupBy("symbol").applyInPandas(fold, TRADES)


def sized(equity: Column, entry: Column, stop: Column, how: str, share: float) -> Column:
    """The part of equity to invest: all, a share, or so much that a stop costs the share; never over all."""
    if how == "full":
        return F.lit(1.0)
    return F.lit(min(1.0, share)) if how == "fraction" else F.least(F.lit(1.0), F.lit(share) / F.abs(F.col("entry") / stop - 1))


def statistics(t: DataFrame) -> DataFrame:
    """Per symbol: trades, win rate, mean win and loss, profit factor (0 without losses), and the compounded result."""
    win, loss = F.when(F.col("ret") > 0, F.col("ret")), F.when(F.col("ret") <= 0, F.col("ret"))
    factor = F.coalesce(F.try_divide(F.sum(win), -F.sum(F.when(F.col("ret") < 0, F.col("ret")))), F.lit(0.0))
    return t.groupBy("symbol").agg(F.count("*").alias("trades"), r6("win_rate", F.avg((F.col("ret") > 0).cast("double"))), r6("avg_win", F.avg(win)), r6("avg_loss", F.avg(loss)), r6("profit_factor", factor), r6("total", F.exp(F.sum(F.ln(1 + F.col("ret")))) - 1))


def warnings(s: DataFrame, bars: Column) -> DataFrame:
    w = [F.when(bars < 60, "short history"), F.when(F.col("trades") < 10, "few trades"), F.when(F.col("win_rate") > 0.9, "nearly always wins")]
    return s.withColumn("warnings", F.array_compact(F.array(*w)))


def _signals(spark, sf_dir) -> DataFrame:
    c = F.col("close")
    b = hourly(spark, sf_dir).withColumn("m", sma(c, 20))
    return b.withColumn("signal", (c > F.col("m")) & (F.lag("close").over(series()) <= F.lag("m").over(series()))).withColumn("exit_signal", c < F.col("m"))


@query()
def b1_backtest(spark, sf_dir):
    """Path-dependent: tested against trades worked out by hand and against longer and shorter histories."""
    t = trades(_signals(spark, sf_dir), Plan(stop=0.3, target=0.6, hold=12))
    return t.withColumns({c: F.round(c, 6) for c in ("entry", "exit", "ret")})


#: A plan that only holds for one bar has a closed form.
_HOLD_SQL = f"""{HOURLY_SQL}, m AS (SELECT *, CASE WHEN count(*) OVER v = 20 THEN avg(close) OVER v END AS m FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
s AS (SELECT *, close > m AND lag(close) OVER w <= lag(m) OVER w AS signal, lead(open) OVER w AS entry, lead(ts) OVER w AS entry_at, lead(close, 2) OVER w AS exit, lead(ts, 2) OVER w AS exit_at FROM m WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
t AS (SELECT symbol, entry_at, exit_at, entry, exit, exit / entry * 0.9995 - 1.0005 AS ret FROM s WHERE signal AND exit IS NOT NULL)"""


def _one_bar(spark, sf_dir) -> DataFrame:
    b = _signals(spark, sf_dir).withColumn("exit_signal", F.lit(False))
    return trades(b, Plan(hold=1)).where("reason = 'hold'")


@query(f"WITH {_HOLD_SQL} SELECT symbol, entry_at, exit_at, entry, exit, round(ret, 10) AS ret FROM t")
def b2_trade_returns(spark, sf_dir):
    return _one_bar(spark, sf_dir).select("symbol", "entry_at", "exit_at", "entry", "exit", F.round("ret", 10).alias("ret"))


@query(f"WITH {_HOLD_SQL} SELECT symbol, entry_at, round(least(1, 0.02 / 0.3), 6) AS by_risk, round(least(1, 0.02 / abs(entry / (entry * 0.9) - 1)), 6) AS by_stop FROM t")
def b3_position_size(spark, sf_dir):
    t = _one_bar(spark, sf_dir)
    return t.select("symbol", "entry_at", r6("by_risk", F.least(F.lit(1.0), F.lit(0.02) / 0.3)), r6("by_stop", sized(F.lit(1.0), F.col("entry"), F.col("entry") * 0.9, "risk", 0.02)))


_STAT_SQL = f"""{_HOLD_SQL}, g AS (SELECT symbol, count(*) AS trades, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(ret) FILTER (WHERE ret > 0), 6) AS avg_win, round(avg(ret) FILTER (WHERE ret <= 0), 6) AS avg_loss,
 round(coalesce(sum(ret) FILTER (WHERE ret > 0) / nullif(-sum(ret) FILTER (WHERE ret < 0), 0), 0), 6) AS profit_factor FROM t GROUP BY 1)"""


@query(f"WITH {_STAT_SQL} SELECT * FROM g")
def a16_backtest_statistics(spark, sf_dir):
    return statistics(_one_bar(spark, sf_dir)).drop("total")


@query(f"WITH {_STAT_SQL} SELECT count(*) AS symbols, round(avg(win_rate), 5) AS mean_win_rate, round(median(profit_factor), 5) AS median_factor, count(*) FILTER (WHERE profit_factor > 1) AS ahead FROM g")
def a17_backtest_summary(spark, sf_dir):
    s = statistics(_one_bar(spark, sf_dir))
    return s.agg(F.count("*").alias("symbols"), F.round(F.avg("win_rate"), 5).alias("mean_win_rate"), F.round(F.median("profit_factor"), 5).alias("median_factor"), F.count_if(F.col("profit_factor") > 1).alias("ahead"))


@query(f"WITH {_STAT_SQL} SELECT symbol, list_filter([CASE WHEN trades < 10 THEN 'few trades' END, CASE WHEN win_rate > 0.9 THEN 'nearly always wins' END], lambda x: x IS NOT NULL) AS warnings FROM g")
def b4_warnings(spark, sf_dir):
    return warnings(statistics(_one_bar(spark, sf_dir)), F.lit(700)).select("symbol", "warnings")


def equity(bars: DataFrame, t: DataFrame) -> DataFrame:
    """(symbol, ts, close, ret, held, equity): the account at each bar, which a trade's return moves when it ends; ``held``:
    whether the bar ends a trade or stands inside of one that ends with the next bar. Of an account that loses all a millionth is left."""
    won = t.groupBy("symbol", F.col("exit_at").alias("ts")).agg(F.sum(F.ln(F.greatest(1 + F.col("ret"), F.lit(1e-6)))).alias("won"))
    x = bars.select("symbol", "ts", "close").join(won, ["symbol", "ts"], "left").withColumn("won", F.coalesce("won", F.lit(0.0)))
    ended = F.col("won") != 0
    return x.withColumn("held", ended | F.coalesce(F.lead("won").over(series()) != 0, F.lit(False))).withColumn("equity", F.exp(F.sum("won").over(series().rowsBetween(Window.unboundedPreceding, 0)))).withColumn("ret", F.exp("won") - 1)


@query(f"""WITH {_HOLD_SQL}, won AS (SELECT symbol, exit_at AS ts, sum(ln(greatest(1 + ret, 1e-6::DOUBLE))) AS won FROM t GROUP BY 1, 2), x AS (SELECT b.symbol, b.ts, b.close, coalesce(w.won, 0) AS won FROM bars b LEFT JOIN won w USING (symbol, ts)),
e AS (SELECT *, won <> 0 OR coalesce(lead(won) OVER w <> 0, false) AS held, exp(sum(won) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity, exp(won) - 1 AS r FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT symbol, round(ln(arg_max(equity, ts)), 6) AS log_return, round(pow(arg_max(equity, ts), 168.0::DOUBLE / count(*)) - 1, 6) AS weekly, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(8760), 6) AS sharpe, round(least(min(equity / peak - 1), 0), 6) AS drawdown,
 round(avg(CASE WHEN held THEN 1.0::DOUBLE ELSE 0 END), 6) AS exposure, round(arg_max(close, ts) / arg_min(close, ts) - 1, 6) AS buy_and_hold FROM p GROUP BY 1""")
def a16_equity_statistics(spark, sf_dir):
    """Of each account: the logarithm of the total return, what it comes to a week, Sharpe ratio of its bars, drawdown, exposure, and holding all the time."""
    e = equity(hourly(spark, sf_dir), _one_bar(spark, sf_dir)).withColumn("peak", F.max("equity").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("equity", "ts")
    return e.groupBy("symbol").agg(
        r6("log_return", F.ln(last)), r6("weekly", F.pow(last, 168.0 / F.count("*")) - 1), r6("sharpe", F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(8760.0))),
        r6("drawdown", F.least(F.min(F.col("equity") / F.col("peak") - 1), F.lit(0.0))), r6("exposure", F.avg(F.col("held").cast("double"))), r6("buy_and_hold", F.max_by("close", "ts") / F.min_by("close", "ts") - 1))
