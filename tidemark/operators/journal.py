"""Fills applied to positions (B9, B10, B11): cost basis, postings, exits that cancel each other, closed trades.

A position's fills are dealt out by wallet and symbol, sorted, and pass through a fold one batch at a time; what is carried
from fill to fill is the position itself and the exits that are still open. With a cash limit the purchases of a wallet
depend on each other, so then the fold is by wallet. A fold needs its rows in order, so a wallet (or position) is one
stream, of any length; others run beside it.

Sales take their part of the cost, rounded to whole cents; what closes a position takes all that is left. A sale of more
than is held is rejected, as is a purchase that costs more than the cash there. An exit that fills cancels those of its
parent that were placed and have not filled; a position that closes cancels all sales placed before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.operators.ledger import _FILL_SQL, _fills, fees
from tidemark.registry import query

IN = ["wallet", "symbol", "id", "side", "qty", "price", "fee", "placed", "filled_at", "parent"]
OUT = pa.schema([
    ("wallet", pa.int64()), ("symbol", pa.string()), ("id", pa.int64()), ("side", pa.string()), ("qty", pa.int64()), ("price", pa.int64()), ("fee", pa.int64()), ("filled_at", pa.timestamp("us")),
    ("state", pa.string()), ("basis", pa.int64()), ("realized", pa.int64()), ("opened_at", pa.timestamp("us")), ("held", pa.int64()), ("cost", pa.int64()),
])


class Position:
    def __init__(self):
        self.held, self.cost, self.opened, self.closed, self.exits = 0, 0, None, None, {}


class Book:
    """A wallet's positions, and its cash where that limits it."""

    def __init__(self, cash: int | None):
        self.cash, self.positions = cash, {}

    def apply(self, wallet, symbol, id_, side, qty, price, fee, placed, at, parent) -> tuple:
        p = self.positions.setdefault(symbol, Position())
        state, basis, realized, opened, worth = "filled", None, None, None, qty * price
        if side == "buy":
            if self.cash is not None and self.cash < worth + fee:
                state = "no cash"
            else:
                p.opened = at if p.held == 0 else p.opened
                p.held, p.cost = p.held + qty, p.cost + worth
                self._pay(-worth - fee)
        elif p.closed is not None and placed <= p.closed:
            state = "position closed"
        elif parent is not None and parent in p.exits and placed <= p.exits[parent]:
            state = "other exit"
        elif p.held < qty:
            state = "not held"
        else:
            basis = p.cost if qty == p.held else (2 * p.cost * qty + p.held) // (2 * p.held)
            realized, opened = worth - basis, p.opened
            p.held, p.cost = p.held - qty, p.cost - basis
            self._pay(worth - fee)
            if parent is not None:
                p.exits[parent] = at
            if p.held == 0:
                p.closed, p.opened = at, None
                p.exits = {}  # placed before now, they are cancelled anyway
        return wallet, symbol, id_, side, qty, price, fee, at, state, basis, realized, opened, p.held, p.cost

    def _pay(self, cents: int) -> None:
        if self.cash is not None:
            self.cash += cents


def journal(fills: DataFrame, cash: int | None = None) -> DataFrame:
    """``fills`` (``IN``; prices, fees in cents; ``parent`` null for what is no exit of another order) with what became of
    each: its state, the cost of what was sold, the gain, when the position was opened, and the position after it."""
    keys = ["wallet", "symbol"] if cash is None else ["wallet"]
    width = len(keys)
    rows = fills.select(*IN).repartition(*keys).sortWithinPartitions(*keys, "filled_at", "id")

    def run(batches):
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def out() -> Iterator[tuple]:
            for _, group in groupby(stream(), lambda r: r[:width]):
                book = Book(cash)
                for r in group:
                    yield book.apply(*r)

        done = out()
        while part := list(islice(done, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), OUT.types)], OUT.names)

    return rows.mapInArrow(run, from_arrow_schema(OUT))


def entries(applied: DataFrame) -> DataFrame:
    """(id, wallet, account, cents): double entry of what filled. Each id adds up to nothing."""
    worth, sale = F.col("qty") * F.col("price"), F.col("side") == "sell"
    rows = [
        ("cash", F.when(sale, worth - F.col("fee")).otherwise(-worth - F.col("fee"))), ("securities", F.when(sale, -F.col("basis")).otherwise(worth)), ("fees", F.col("fee")),
        ("realized_pnl", F.when(sale, -F.col("realized")).otherwise(F.lit(0))),
    ]
    return applied.where("state = 'filled'").select("id", "wallet", F.inline(F.array(*[F.struct(F.lit(a).alias("account"), c.alias("cents")) for a, c in rows]))).where("cents <> 0 OR account <> 'realized_pnl'")


def trades(applied: DataFrame) -> DataFrame:
    """The journal: a row for each sale, in dollars, the gain after its fee."""
    sold = applied.where("state = 'filled' AND side = 'sell'")
    return sold.select("id", "wallet", "symbol", "qty", (F.col("basis") / F.col("qty") / 100).alias("entry"), (F.col("price") / 100).alias("exit"), "opened_at", F.col("filled_at").alias("closed_at"), ((F.col("realized") - F.col("fee")) / 100).alias("pnl"))


# Queries: orders that events stand for; sales of a wallet, symbol and day exit one parent.

_IN_SQL = f"""{_FILL_SQL}, i AS (SELECT wallet, symbol, o.id, side, qty, price, CASE WHEN side = 'sell' THEN CAST(ceil(qty * price * 27.8::DOUBLE / 1e6) + least(ceil(qty * 0.0166::DOUBLE), 830) AS BIGINT) ELSE 0 END AS fee, placed, filled_at,
 CASE WHEN side = 'sell' THEN epoch(date_trunc('day', placed))::BIGINT END AS parent, row_number() OVER (PARTITION BY wallet, symbol ORDER BY filled_at, o.id) AS k FROM o JOIN f USING (id)),
start AS (SELECT wallet, symbol FROM i GROUP BY 1, 2),
steps AS (SELECT wallet, symbol, 0::BIGINT AS k, 0::BIGINT AS id, 0::BIGINT AS held, 0::HUGEINT AS cost, NULL::TIMESTAMP AS opened, NULL::TIMESTAMP AS closed, []::STRUCT(p BIGINT, t TIMESTAMP)[] AS exits, '' AS state, NULL::HUGEINT AS basis, NULL::TIMESTAMP AS opened_at FROM start
 UNION ALL SELECT wallet, symbol, k, id,
  CASE WHEN now_ <> 'filled' THEN held WHEN side = 'buy' THEN held + qty ELSE held - qty END, CASE WHEN now_ <> 'filled' THEN cost WHEN side = 'buy' THEN cost + qty * price ELSE cost - part END,
  CASE WHEN now_ = 'filled' AND side = 'buy' AND held = 0 THEN filled_at WHEN now_ = 'filled' AND side = 'sell' AND held = qty THEN NULL ELSE opened END,
  CASE WHEN now_ = 'filled' AND side = 'sell' AND held = qty THEN filled_at ELSE closed END,
  CASE WHEN now_ = 'filled' AND side = 'sell' THEN list_append(exits, {{'p': parent, 't': filled_at}}) ELSE exits END, now_, CASE WHEN now_ = 'filled' AND side = 'sell' THEN part END, CASE WHEN now_ = 'filled' AND side = 'sell' THEN opened END
 FROM (SELECT s.wallet, s.symbol, i.k, i.id, i.side, i.qty, i.price, i.parent, i.filled_at, s.held, s.cost, s.opened, s.closed, s.exits,
   CASE WHEN i.side = 'buy' THEN 'filled' WHEN s.closed IS NOT NULL AND i.placed <= s.closed THEN 'position closed' WHEN len(list_filter(s.exits, lambda x: x.p = i.parent AND i.placed <= x.t)) > 0 THEN 'other exit' WHEN s.held < i.qty THEN 'not held' ELSE 'filled' END AS now_,
   CASE WHEN i.qty = s.held OR s.held = 0 THEN s.cost ELSE (2 * s.cost * i.qty + s.held) // (2 * s.held) END AS part
  FROM steps s JOIN i ON i.wallet = s.wallet AND i.symbol = s.symbol AND i.k = s.k + 1)),
applied AS (SELECT i.*, state, CAST(basis AS BIGINT) AS basis, CAST(qty * price - basis AS BIGINT) AS realized, opened_at, held, CAST(cost AS BIGINT) AS cost FROM steps JOIN i USING (wallet, symbol, k, id))"""


def _journal(spark, sf_dir) -> DataFrame:
    f = _fills(spark, sf_dir).where("price IS NOT NULL")
    day = F.unix_timestamp(F.date_trunc("day", F.col("at").cast("timestamp")))
    return journal(f.select("wallet", "symbol", "id", "side", F.col("qty").cast("long").alias("qty"), "price", fees(F.col("side"), F.col("qty"), F.col("price")).alias("fee"), F.col("at").alias("placed"), "filled_at", F.when(F.col("side") == "sell", day).alias("parent")))


@query(f"WITH RECURSIVE {_IN_SQL} SELECT id, wallet, symbol, state, basis, realized, opened_at, held, cost FROM applied")
def b9_applied_fills(spark, sf_dir):
    return _journal(spark, sf_dir).select("id", "wallet", "symbol", "state", "basis", "realized", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"), "held", "cost")


@query(f"""WITH RECURSIVE {_IN_SQL}, e AS (SELECT wallet, 'cash' AS account, CASE WHEN side = 'sell' THEN qty * price - fee ELSE -qty * price - fee END AS cents FROM applied WHERE state = 'filled' UNION ALL SELECT wallet, 'securities', CASE WHEN side = 'sell' THEN -basis ELSE qty * price END FROM applied WHERE state = 'filled'
 UNION ALL SELECT wallet, 'fees', fee FROM applied WHERE state = 'filled' UNION ALL SELECT wallet, 'realized_pnl', -realized FROM applied WHERE state = 'filled' AND side = 'sell' AND realized <> 0)
SELECT wallet, account, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS entries FROM e GROUP BY 1, 2""")
def b9_wallet_postings(spark, sf_dir):
    return entries(_journal(spark, sf_dir)).groupBy("wallet", "account").agg(F.sum("cents").alias("cents"), F.count("*").alias("entries"))


@query(f"WITH RECURSIVE {_IN_SQL} SELECT id, wallet, symbol, qty, round(basis / qty / 100.0::DOUBLE, 6) AS entry, round(price / 100.0::DOUBLE, 6) AS exit, opened_at, filled_at AS closed_at, round((realized - fee) / 100.0::DOUBLE, 6) AS pnl FROM applied WHERE state = 'filled' AND side = 'sell'")
def b9_trade_journal(spark, sf_dir):
    t = trades(_journal(spark, sf_dir))
    return t.select("id", "wallet", "symbol", "qty", *[F.round(c, 6).alias(c) for c in ("entry", "exit")], *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened_at", "closed_at")], F.round("pnl", 6).alias("pnl"))
