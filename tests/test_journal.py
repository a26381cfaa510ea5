"""Applied fills against a plain ledger that looks at everything that came before."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import journal as jo

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "wallet long, symbol string, id long, side string, qty long, price long, fee long, placed timestamp, filled_at timestamp, parent long"


def random_fills(n, wallets, seed):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        side = rnd.choice(["buy", "sell", "sell"]) if k % 4 else "buy"
        at = T0 + datetime.timedelta(minutes=k)
        out.append((rnd.randrange(wallets), rnd.choice("AB"), k, side, rnd.randrange(1, 6), rnd.randrange(50, 400), rnd.randrange(3), at - datetime.timedelta(minutes=rnd.randrange(40)), at, rnd.randrange(6) if side == "sell" and rnd.random() < 0.7 else None))
    return out


def plain(fills, cash):
    """Each wallet from its history of what filled, worked out anew for every fill."""
    done, out = [], {}
    for wallet, symbol, k, side, qty, price, fee, placed, at, parent in sorted(fills, key=lambda f: (f[8], f[2])):
        mine = [d for d in done if d["wallet"] == wallet]
        here = [d for d in mine if d["symbol"] == symbol]
        held = sum(d["qty"] if d["side"] == "buy" else -d["qty"] for d in here)
        cost = sum(d["qty"] * d["price"] if d["side"] == "buy" else -d["basis"] for d in here)
        money = None if cash is None else cash + sum(-d["qty"] * d["price"] - d["fee"] if d["side"] == "buy" else d["qty"] * d["price"] - d["fee"] for d in mine)
        state, basis = "filled", None
        if side == "buy":
            state = "no cash" if money is not None and money < qty * price + fee else state
        elif any(d["closes"] and placed <= d["at"] for d in here):
            state = "position closed"
        elif parent is not None and any(d["parent"] == parent and d["side"] == "sell" and placed <= d["at"] for d in here):
            state = "other exit"
        elif held < qty:
            state = "not held"
        else:
            basis = cost if qty == held else int(cost * qty / held + 0.5)
        if state == "filled":
            done.append({"wallet": wallet, "symbol": symbol, "side": side, "qty": qty, "price": price, "fee": fee, "at": at, "parent": parent, "basis": basis, "closes": side == "sell" and qty == held})
            held, cost = (held + qty, cost + qty * price) if side == "buy" else (held - qty, cost - basis)
        out[k] = (state, basis, held, cost)
    return out


@pytest.mark.parametrize("cash", [None, 2000])
def test_journal_equals_a_plain_ledger(spark, cash):
    fills = random_fills(700, 3, 7)
    applied = jo.journal(spark.createDataFrame(fills, SCHEMA), cash).cache()
    got = {r.id: (r.state, r.basis, r.held, r.cost) for r in applied.collect()}
    assert got == plain(fills, cash)
    assert {"filled", "position closed", "other exit", "not held"} <= {v[0] for v in got.values()}
    assert (cash is None) != ("no cash" in {v[0] for v in got.values()})
    assert jo.entries(applied).groupBy("id").agg(F.sum("cents").alias("s")).where("s <> 0").count() == 0
    left = {(r.wallet, r.symbol): r.c for r in applied.where("state = 'filled'").groupBy("wallet", "symbol").agg(F.sum(F.when(F.col("side") == "buy", F.col("qty") * F.col("price")).otherwise(-F.col("basis"))).alias("c")).collect()}
    for r in applied.collect():
        last = max(x for x in got if fills[x][0] == r.wallet and fills[x][1] == r.symbol)
        assert left[r.wallet, r.symbol] == got[last][3]
    applied.unpersist()


def test_costs_are_taken_in_parts_and_whole_at_the_end(spark):
    at = lambda k: T0 + datetime.timedelta(minutes=k)
    fills = [(1, "A", 1, "buy", 3, 100, 0, at(1), at(1), None), (1, "A", 2, "buy", 1, 1, 0, at(2), at(2), None), (1, "A", 3, "sell", 1, 90, 2, at(3), at(3), 9), (1, "A", 4, "sell", 1, 90, 2, at(1), at(4), 9), (1, "A", 5, "sell", 3, 80, 0, at(4), at(5), None), (1, "A", 6, "sell", 1, 80, 0, at(4), at(6), None)]
    applied = jo.journal(spark.createDataFrame(fills, SCHEMA)).orderBy("id")
    assert [(r.state, r.basis, r.realized) for r in applied.collect()] == [("filled", None, None), ("filled", None, None), ("filled", 75, 15), ("other exit", None, None), ("filled", 226, 14), ("position closed", None, None)]
    assert [(r.id, r.entry, r.exit, r.pnl) for r in jo.trades(applied).orderBy("id").collect()] == [(3, 0.75, 0.9, 0.13), (5, 226 / 3 / 100, 0.8, 0.14)]
    assert jo.journal(spark.createDataFrame([], SCHEMA)).count() == 0
