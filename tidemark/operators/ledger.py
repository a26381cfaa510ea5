"""Orders, fills, fees and the ledger, in whole cents.

Customers' orders stand for wallets' orders, hourly bars of events for the market they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import r6
from tidemark.registry import query, table
from tidemark.sources.bars import HOURLY_SQL, hourly


def slipped(price: Column, side: Column, basis_points: int) -> Column:
    """The price moved against the trader by a share of it, to the next whole cent, one cent at least."""
    off = F.ceil(price * F.lit(basis_points) / F.lit(10000.0))
    return F.when(side == "buy", price + off).otherwise(F.greatest(F.lit(1), price - off)).cast("long")


def fill_price(side: Column, kind: Column, limit: Column, stop: Column, basis_points: int = 5) -> Column:
    """The price at which an order meets a bar (open, high, low, close), or null. A market order gets the slipped close. A
    limit order gets the better of limit and open once the bar trades through it. A stop order gets, once touched, the
    worse of stop and open, slipped; a stop-limit order, once its stop is touched, is a limit order in the same bar."""
    o, h, low, buy = F.col("open"), F.col("high"), F.col("low"), side == "buy"
    at_limit = F.when(buy & (low <= limit), F.least(limit, o)).when(~buy & (h >= limit), F.greatest(limit, o))
    hit = F.when(buy, h >= stop).otherwise(low <= stop)
    at_stop = F.when(hit, slipped(F.when(buy, F.greatest(stop, o)).otherwise(F.least(stop, o)), side, basis_points))
    return F.when(kind == "market", slipped(F.col("close"), side, basis_points)).when(kind == "limit", at_limit).when(kind == "stop", at_stop).when(kind == "stop_limit", F.when(hit, at_limit))


def fees(side: Column, qty: Column, cents: Column, commission: int = 0) -> Column:
    """Commission, and on sales the regulator's share of the value (ceiling) and the capped share by quantity."""
    worth = qty * cents
    sec = F.ceil(worth * 27.8 / 1e6)
    taf = F.least(F.ceil(qty * 0.0166), F.lit(830))
    return (F.lit(commission) + F.when(side == "sell", sec + taf).otherwise(0)).cast("long")


def first_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Each order (id, symbol, at, expires, side, kind, limit, stop) with the first bar from ``at`` on that fills it before
    it expires. A join on days replaces the range join."""
    span = orders.withColumn("day", F.explode(F.sequence(F.to_date("at"), F.to_date("expires"))))
    b = bars.withColumn("day", F.to_date("ts"))
    hit = span.join(b, ["symbol", "day"]).where("ts >= at AND ts < expires").withColumn("price", fill_price(F.col("side"), F.col("kind"), F.col("limit"), F.col("stop"))).where("price IS NOT NULL")
    first = hit.groupBy("id").agg(F.min("ts").alias("filled_at"), F.min_by("price", "ts").alias("price"))
    return orders.join(first, "id", "left")


def refusal(order_cents: Column, power: Column, qty: Column, free: Column, side: Column, equity: Column, day_trades: Column, most: int) -> Column:
    """The first reason against an order, or null."""
    return (
        F.when((side == "buy") & (order_cents > power), "buying power").when((side == "sell") & (qty > free), "free shares")
        .when((equity < 2_500_000) & (day_trades >= 3), "day trades").when(order_cents > most, "agent limit")
    )


def cents_bars(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", *[F.round(F.col(c) * 100).cast("long").alias(c) for c in ("open", "high", "low", "close")])


_ORD_SQL = f"""{HOURLY_SQL}, cb AS (SELECT symbol, ts, CAST(round(open * 100) AS BIGINT) AS open, CAST(round(high * 100) AS BIGINT) AS high, CAST(round(low * 100) AS BIGINT) AS low, CAST(round(close * 100) AS BIGINT) AS close FROM bars),
o AS (SELECT event_id AS id, event_type AS symbol, ts AS placed, ts + INTERVAL 24 HOUR AS expires, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
 CASE event_id % 8 // 2 WHEN 0 THEN 'limit' WHEN 1 THEN 'stop' WHEN 2 THEN 'stop_limit' ELSE 'market' END AS kind, CAST(round(value * 80) AS BIGINT) AS lim, CAST(round(value * 120) AS BIGINT) AS stop, 1 + user_id % 7 AS qty, user_id AS wallet FROM events WHERE value > 0)"""


def _orders(spark, sf_dir) -> DataFrame:
    """Each event of some worth as an order of one of the four kinds."""
    k, worth = F.col("event_id"), F.col("value")
    kind = F.floor(k % 8 / 2)
    return table(spark, sf_dir, "events").where("value > 0").select(
        k.alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 24 HOUR")).alias("expires"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.when(kind == 0, "limit").when(kind == 1, "stop").when(kind == 2, "stop_limit").otherwise("market").alias("kind"), F.round(worth * 80).cast("long").alias("limit"), F.round(worth * 120).cast("long").alias("stop"), (1 + F.col("user_id") % 7).alias("qty"), F.col("user_id").alias("wallet"))


_SLIP = "CAST(CASE WHEN side = 'buy' THEN {0} + ceil({0} * 5 / 10000.0::DOUBLE) ELSE greatest(1, {0} - ceil({0} * 5 / 10000.0::DOUBLE)) END AS BIGINT)"
_FILL_SQL = f"""{_ORD_SQL}, h AS (SELECT o.id, side, kind, cb.ts, close, CASE WHEN side = 'buy' AND low <= lim THEN least(lim, open) WHEN side = 'sell' AND high >= lim THEN greatest(lim, open) END AS at_limit,
 CASE WHEN side = 'buy' THEN high >= stop ELSE low <= stop END AS hit, CASE WHEN side = 'buy' THEN greatest(stop, open) ELSE least(stop, open) END AS at_stop FROM o JOIN cb ON cb.symbol = o.symbol AND cb.ts >= placed AND cb.ts < expires),
m AS (SELECT id, ts, CASE kind WHEN 'market' THEN {_SLIP.format('close')} WHEN 'limit' THEN at_limit WHEN 'stop' THEN CASE WHEN hit THEN {_SLIP.format('at_stop')} END ELSE CASE WHEN hit THEN at_limit END END AS price FROM h),
f AS (SELECT id, min(ts) AS filled_at, arg_min(price, ts) AS price FROM m WHERE price IS NOT NULL GROUP BY id)"""


def _fills(spark, sf_dir) -> DataFrame:
    return first_fills(_orders(spark, sf_dir), cents_bars(hourly(spark, sf_dir)))


@query(f"WITH {_FILL_SQL} SELECT o.id, side, kind, filled_at, price FROM o LEFT JOIN f USING (id)")
def b5_order_match(spark, sf_dir):
    return _fills(spark, sf_dir).select("id", "side", "kind", "filled_at", "price")


@query(f"""WITH {_FILL_SQL} SELECT o.id, price AS paid, CAST(5 + CASE WHEN side = 'sell' THEN ceil(qty * price * 27.8::DOUBLE / 1e6) + least(ceil(qty * 0.0166::DOUBLE), 830) ELSE 0 END AS BIGINT) AS fee FROM o JOIN f USING (id)""")
def b6_fees_and_slippage(spark, sf_dir):
    """Prices of market and stop orders are slipped."""
    p = _fills(spark, sf_dir).where("price IS NOT NULL")
    return p.select("id", F.col("price").alias("paid"), fees(F.col("side"), F.col("qty"), F.col("price"), 5).alias("fee"))


def reserve(kind: Column, limit: Column, stop: Column, last: Column, qty: Column, commission: int = 0) -> Column:
    """The worst cost of an open purchase: at its limit, else its stop, else the last price, of which stop and market
    orders may move by 2 %; and the fee."""
    price = F.when(kind.isin("limit", "stop_limit"), limit).when(kind == "stop", F.ceil(stop * F.lit(1.02))).otherwise(F.ceil(last * F.lit(1.02)))
    return (price * qty + commission).cast("long")


@query(f"""WITH {_FILL_SQL}, l AS (SELECT symbol, arg_max(close, ts) AS last FROM cb GROUP BY 1)
SELECT wallet, CAST(sum(5 + qty * CASE WHEN kind IN ('limit', 'stop_limit') THEN lim WHEN kind = 'stop' THEN ceil(stop * 1.02::DOUBLE) ELSE ceil(last * 1.02::DOUBLE) END) AS BIGINT) AS reserved
FROM o LEFT JOIN f USING (id) JOIN l USING (symbol) WHERE price IS NULL AND side = 'buy' GROUP BY 1""")
def b7_reserved(spark, sf_dir):
    """What open purchases may still cost."""
    last = cents_bars(hourly(spark, sf_dir)).groupBy("symbol").agg(F.max_by("close", "ts").alias("last"))
    x = _fills(spark, sf_dir).where("price IS NULL AND side = 'buy'").join(last, "symbol")
    return x.groupBy("wallet").agg(F.sum(reserve(F.col("kind"), F.col("limit"), F.col("stop"), F.col("last"), F.col("qty"), 5)).alias("reserved"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_totalprice > c_acctbal * 50 THEN 'buying power' WHEN o_orderkey % 2 = 1 AND o_orderkey % 11 > 8 THEN 'free shares' WHEN c_acctbal * 100 < 250000 AND o_orderkey % 5 >= 3 THEN 'day trades' WHEN o_totalprice > 400000 THEN 'agent limit' END AS refusal FROM orders JOIN customer ON c_custkey = o_custkey""")
def b8_risk_checks(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").join(c, "o_custkey")
    side = F.when(k % 2 == 0, "buy").otherwise("sell")
    return x.select("o_orderkey", refusal(F.col("o_totalprice"), F.col("c_acctbal") * 50, k % 11, F.lit(8), side, F.col("c_acctbal") * 1000, k % 5, 400000).alias("refusal"))


def postings(fills: DataFrame) -> DataFrame:
    """Double entry: each fill moves cents between cash, shares and fees, which add up to nothing."""
    worth, sign = F.col("qty") * F.col("paid"), F.when(F.col("side") == "buy", 1).otherwise(-1)
    entries = F.array(F.struct(F.lit("cash").alias("account"), (-sign * worth - F.col("fee")).alias("cents")), F.struct(F.lit("shares").alias("account"), (sign * worth).alias("cents")), F.struct(F.lit("fees").alias("account"), F.col("fee").alias("cents")))
    return fills.select("id", "wallet", F.inline(entries))


_POST_SQL = f"""{_FILL_SQL}, p AS (SELECT o.id, wallet, side, qty, price AS paid FROM o JOIN f USING (id)), q AS (SELECT *, CASE WHEN side = 'sell' THEN CAST(ceil(qty * paid * 27.8::DOUBLE / 1e6) + least(ceil(qty * 0.0166::DOUBLE), 830) AS BIGINT) ELSE 0 END AS fee, CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS s FROM p),
e AS (SELECT id, wallet, 'cash' AS account, -s * qty * paid - fee AS cents FROM q UNION ALL SELECT id, wallet, 'shares', s * qty * paid FROM q UNION ALL SELECT id, wallet, 'fees', fee FROM q)"""


def _postings(spark, sf_dir) -> DataFrame:
    p = _fills(spark, sf_dir).where("price IS NOT NULL").withColumn("paid", F.col("price"))
    return postings(p.withColumn("fee", fees(F.col("side"), F.col("qty"), F.col("paid"))))


@query(f"WITH {_POST_SQL} SELECT wallet, account, CAST(sum(cents) AS BIGINT) AS cents FROM e GROUP BY 1, 2")
def a26_b9_balances(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("wallet", "account").agg(F.sum("cents").alias("cents"))


@query(f"WITH {_POST_SQL} SELECT id, CAST(sum(cents) AS BIGINT) AS off, count(*) AS entries FROM e GROUP BY 1")
def b10_postings_balance(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("id").agg(F.sum("cents").alias("off"), F.count("*").alias("entries"))


@query("""SELECT l_orderkey, l_partkey, round(sum(l_extendedprice * l_discount) / (sum(l_extendedprice) - sum(l_extendedprice * l_discount)), 6) AS round_trip FROM lineitem GROUP BY 1, 2""")
def b11_round_trips(spark, sf_dir):
    """Realised over what was paid."""
    gain = F.sum(F.col("l_extendedprice") * F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(r6("round_trip", gain / (F.sum("l_extendedprice") - gain)))


def luck(trips: DataFrame, bars: DataFrame, simulations: int = 1000, seed: int = 11) -> DataFrame:
    """(symbol, actual, percentile): where the mean gain of a symbol's trips stands among draws of random entries held as
    long. A draw has as many entries as the symbol has trips. Each entry is a hash of its number, so it is repeatable;
    symbols under ten trips have no row."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    mean = trips.groupBy("symbol").agg(F.count("*").alias("trips"), F.avg("ret").alias("actual"), F.max("bars").alias("hold")).where("trips >= 10")
    draws = mean.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(simulations)))).withColumn("d", F.explode(F.sequence(F.lit(1), F.col("trips").cast("int"))))
    size = b.groupBy("symbol").agg(F.max("n").alias("n"))
    picked = draws.join(size, "symbol").withColumn("k", F.pmod(F.xxhash64("s", "d", F.lit(seed)), F.col("n") - F.col("hold")))
    held = b.select("symbol", "k", "close")
    out = held.withColumnRenamed("close", "exit")
    gain = picked.join(held, ["symbol", "k"]).withColumn("k", F.col("k") + F.col("hold")).join(out, ["symbol", "k"])
    sim = gain.groupBy("symbol", "actual", "s").agg(F.avg(F.col("exit") / F.col("close") - 1).alias("g"))
    return sim.groupBy("symbol", "actual").agg((F.count_if(F.col("g") < F.col("actual")) * 100 / F.count("*")).alias("percentile"))


@query()
def b12_luck_test(spark, sf_dir):
    """Rows only: a simulation."""
    from tidemark.operators.backtest import _one_bar

    return luck(_one_bar(spark, sf_dir), hourly(spark, sf_dir)).select("symbol", r6("actual", F.col("actual")), "percentile")


@query("""WITH p AS (SELECT l_partkey AS position, CAST(l_quantity AS BIGINT) AS held, l_linenumber * 8 AS sold, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey FROM lineitem)
SELECT l_orderkey, position, held, sold, held - sold AS rest, cents * sold // (held * 10) AS pnl FROM p WHERE sold <= held""")
def b13_position_close(spark, sf_dir):
    """Parts of positions are sold; more than is held is refused."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("position"), F.col("l_quantity").cast("long").alias("held"), (F.col("l_linenumber") * 8).alias("sold"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return p.where("sold <= held").select("l_orderkey", "position", "held", "sold", (F.col("held") - F.col("sold")).alias("rest"), F.expr("cents * sold DIV (held * 10)").alias("pnl"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) + 90 ELSE CAST(o_orderdate AS DATE) + CAST(CASE extract(dow FROM o_orderdate) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS INT) END AS expires FROM orders""")
def b14_order_expiry(spark, sf_dir):
    """Ninety days, or the session's end, which at weekends is Monday's."""
    d = F.to_date("o_orderdate")
    ahead = F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_add(d, 90)).otherwise(F.date_add(d, ahead)).alias("expires"))


@query("""SELECT c_custkey, CAST(floor(least(c_acctbal * 0.1, 0.98 * c_acctbal * 0.5) / 17.0::DOUBLE) AS BIGINT) AS qty, CASE WHEN c_acctbal <= 0 THEN 'no equity' WHEN floor(least(c_acctbal * 0.1, 0.98 * c_acctbal * 0.5) / 17.0::DOUBLE) < 1 THEN 'too small' WHEN c_custkey % 13 > 10 THEN 'positions' END AS refusal FROM customer""")
def b15_agent_size(spark, sf_dir):
    e = F.col("c_acctbal")
    qty = F.floor(F.least(e * 0.1, 0.98 * e * 0.5) / 17.0)
    return table(spark, sf_dir, "customer").select("c_custkey", qty.alias("qty"), F.when(e <= 0, "no equity").when(qty < 1, "too small").when(F.col("c_custkey") % 13 > 10, "positions").alias("refusal"))


@query(f"""WITH {HOURLY_SQL}, l AS (SELECT symbol, arg_max(close, ts) AS c, avg(close) AS m FROM bars GROUP BY 1), held AS (SELECT unnest(['view', 'error']) AS symbol)
SELECT symbol, 'enter' AS act FROM l WHERE c > m AND symbol NOT IN (SELECT symbol FROM held) UNION ALL SELECT symbol, 'leave' FROM l WHERE c < m AND symbol IN (SELECT symbol FROM held)""")
def b16_rule_agent(spark, sf_dir):
    """Entry signals on what isn't held, exit signals on what is."""
    last = hourly(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("c"), F.avg("close").alias("m"))
    held = spark.createDataFrame([("view",), ("error",)], "symbol string")
    enter = last.where("c > m").join(held, "symbol", "left_anti").select("symbol", F.lit("enter").alias("act"))
    return enter.union(last.where("c < m").join(held, "symbol", "left_semi").select("symbol", F.lit("leave")))


@query("""SELECT o_custkey AS wallet, o_orderkey % 50 AS idempotency_key, min(o_orderkey) AS request, CAST(arg_min(round(o_totalprice * 100), o_orderkey) AS BIGINT) AS cents, count(*) - 1 AS ignored FROM orders GROUP BY 1, 2""")
def b17_idempotent_payments(spark, sf_dir):
    """Of one key the first request is booked, once."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("wallet"), (F.col("o_orderkey") % 50).alias("idempotency_key")).agg(F.min("o_orderkey").alias("request"), F.min_by(F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderkey").alias("cents"), (F.count("*") - 1).alias("ignored"))


@query("""SELECT o_orderkey, upper(trim(o_orderstatus)) AS side, CAST(least(greatest(o_orderkey % 1500, 1), 1000) AS BIGINT) AS qty, CASE WHEN o_orderkey % 1500 = 0 THEN 'quantity' WHEN o_orderstatus = 'P' THEN 'side' END AS fault FROM orders""")
def b18_request_validation(spark, sf_dir):
    k = F.col("o_orderkey") % 1500
    return table(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.trim("o_orderstatus")).alias("side"), F.least(F.greatest(k, F.lit(1)), F.lit(1000)).alias("qty"), F.when(k == 0, "quantity").when(F.col("o_orderstatus") == "P", "side").alias("fault"))


@query(f"""WITH {_FILL_SQL}, p AS (SELECT o.id, price, qty FROM o JOIN f USING (id) WHERE side = 'buy')
SELECT id, 'stop' AS kind, CAST(floor(price * 95 / 100) AS BIGINT) AS cents, qty, CAST(id AS VARCHAR) AS cancels FROM p UNION ALL SELECT id, 'limit', CAST(ceil(price * 110 / 100) AS BIGINT), qty, CAST(id AS VARCHAR) FROM p""")
def b19_exit_orders(spark, sf_dir):
    """A stop and a target for each purchase; one cancels the other."""
    p, cents = _fills(spark, sf_dir).where("price IS NOT NULL AND side = 'buy'"), F.col("price")
    legs = F.array(F.struct(F.lit("stop").alias("kind"), F.floor(cents * 95 / 100).alias("cents")), F.struct(F.lit("limit").alias("kind"), F.ceil(cents * 110 / 100).alias("cents")))
    return p.select("id", F.inline(legs), "qty", F.col("id").cast("string").alias("cancels"))


@query(f"WITH {_FILL_SQL} SELECT o.symbol, count(*) FILTER (WHERE price IS NOT NULL) AS filled, count(*) FILTER (WHERE price IS NULL AND expires < TIMESTAMP '2024-01-30') AS expired, count(*) FILTER (WHERE price IS NULL AND expires >= TIMESTAMP '2024-01-30') AS open FROM o LEFT JOIN f USING (id) GROUP BY 1")
def b20_order_tick(spark, sf_dir):
    x = _fills(spark, sf_dir)
    out = F.col("price").isNull()
    late = F.col("expires") < F.lit("2024-01-30").cast("timestamp_ntz")
    return x.groupBy("symbol").agg(F.count("price").alias("filled"), F.count_if(out & late).alias("expired"), F.count_if(out & ~late).alias("open"))
