"""Streams of events (X1-X9) and event-time windows (extensions).

A run reads what is available now, a bounded number of files a micro-batch in order of arrival, and writes Parquet to the
shared folder that the cluster names in ``spark.checkpoint.dir``; state and offsets are kept there too. A run that is given
the name of an earlier one goes on where that one stopped; without a name it starts anew.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.indicators import r6
from tidemark.registry import query, table


SLICE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session (tests) takes a temporary one; on a
    cluster this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.gettempdir()


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 8, size: int | None = None) -> DataFrame:
    """A table read as a stream of at most ``files`` files a micro-batch, or of ``size`` bytes (one file at least), which
    bounds what a key holds at once; times are instants, as watermarks ask for."""
    kind = table(spark, sf_dir, name).schema
    bound = ("maxBytesPerTrigger", size) if size else ("maxFilesPerTrigger", files)
    x = spark.readStream.schema(kind).option(*bound).parquet(f"{sf_dir}/{name}.parque[t]")
    return x.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in kind.names else x


def place(spark: SparkSession, name: str | None) -> str:
    return f"{shared_dir(spark)}/stream-{name or uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream until nothing is left and returns what it wrote, in earlier runs of this name too."""
    at = place(stream.sparkSession, name)
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append")
    else:
        run = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/out"))
    run.option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def upserted(stream: DataFrame, keys: list[str], version: str, name: str | None = None) -> DataFrame:
    """Micro-batches merged into a table by key, where the larger ``version`` stays. A batch adds the newest row of each of
    its keys, in a folder of its own, which a batch that comes again writes over; reading merges them."""
    spark, at = stream.sparkSession, place(stream.sparkSession, name)
    newest = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), version).alias("r")

    def add(df: DataFrame, batch: int) -> None:
        df.groupBy(*keys).agg(newest).select(*keys, "r.*").write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return rows.groupBy(*keys).agg(newest).select(*keys, "r.*").select(*stream.columns)


def stateful(stream: DataFrame, key: str, out: str, state: str, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]]) -> DataFrame:
    """A function of a key's state and its new rows of a micro-batch, in order of time, to the next state and rows to emit.
    The key's column is a byte a row until rows are emitted, some at a time: as strings it would take most of the memory."""

    def work(k, batches, held: GroupState):
        pdf = pd.concat([b.drop(columns=key) for b in batches], ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)
        pdf[key] = pd.Categorical.from_codes(np.zeros(len(pdf), "int8"), [""])
        after, rows = step(tuple(held.get) if held.exists else None, pdf)
        held.update(after)
        for at in range(0, len(rows), SLICE):
            yield rows.iloc[at : at + SLICE].assign(**{key: k[0]})

    return stream.groupBy(key).applyInPandasWithState(work, out, state, "append", GroupStateTimeout.NoTimeout)


def changed(last: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Rows whose value differs from the one before; a symbol's first always."""
    before = pdf["value"].shift()
    if last is not None:
        before.iloc[0] = last[0]
    keep = pdf["value"] != before
    return (float(pdf["value"].iloc[-1]),), pdf.loc[keep, ["event_type", "ts", "value"]]


def numbered(last: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """A topic's messages with numbers that only grow."""
    start = last[0] if last else 0
    return (start + len(pdf),), pdf.assign(seq=range(start + 1, start + len(pdf) + 1))[["event_type", "ts", "event_id", "seq"]]


def cooling(hours: float) -> Callable:
    """Rows that fire, each silencing the following for some hours."""
    wait = pd.Timedelta(hours=hours)

    def step(last: tuple | None, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at, keep = pd.Timestamp(last[0], unit="us") if last else None, []
        for t in pdf["ts"]:
            keep.append(at is None or t >= at + wait)
            at = t if keep[-1] else at
        return (int(at.value // 1000),), pdf.loc[keep, ["event_type", "ts"]]

    return step


_naive = lambda x, *names: x.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("""SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS seq FROM events""")
def x1_topic_sequence(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("event_type", "ts", "event_id")
    return _naive(drained(stateful(s, "event_type", "event_type string, ts timestamp, event_id long, seq long", "n long", numbered)), "ts")


@query("""SELECT event_type, ts, value FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events) WHERE before IS DISTINCT FROM value""")
def x2_change_detection(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("event_type", "ts", "value")
    return _naive(drained(stateful(s, "event_type", "event_type string, ts timestamp, value double", "last double", changed)), "ts")


@query("""SELECT event_id, ts FROM events WHERE extract(dow FROM ts - INTERVAL 5 HOUR) BETWEEN 1 AND 5 AND extract(hour FROM ts - INTERVAL 5 HOUR) * 60 + extract(minute FROM ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959""")
def x3_session_gate(spark, sf_dir):
    from tidemark.functions.predicates import market_phase

    return _naive(drained(event_stream(spark, sf_dir).where(market_phase(F.col("ts")) == "open").select("event_id", "ts")), "ts")


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1""")
def x6_micro_batch_upsert(spark, sf_dir):
    return _naive(upserted(event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "value"), ["user_id"], "ts"), "ts")


@query("""WITH RECURSIVE h AS (SELECT event_type, ts FROM events WHERE value > 100), f AS (SELECT event_type, min(ts) AS ts FROM h GROUP BY 1
 UNION ALL SELECT f.event_type, (SELECT min(h.ts) FROM h WHERE h.event_type = f.event_type AND h.ts >= f.ts + INTERVAL 24 HOUR) FROM f WHERE f.ts IS NOT NULL) SELECT event_type, ts FROM f WHERE ts IS NOT NULL""")
def x7_cooldown_state(spark, sf_dir):
    s = event_stream(spark, sf_dir).where("value > 100").select("event_type", "ts")
    return _naive(drained(stateful(s, "event_type", "event_type string, ts timestamp", "at long", cooling(24))), "ts")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def x8_duplicate_suppression(spark, sf_dir):
    s = event_stream(spark, sf_dir).withWatermark("ts", "60 days").select("user_id", "event_type", "ts")
    return drained(s.dropDuplicatesWithinWatermark(["user_id", "event_type"])).select("user_id", "event_type")


@query("""SELECT event_type, date_trunc('day', ts) AS day, round(sum(value * value) / sum(value), 6) AS vwap FROM events WHERE value > 0 GROUP BY 1, 2""")
def x9_daily_vwap(spark, sf_dir):
    s = event_stream(spark, sf_dir).where("value > 0").withWatermark("ts", "2 hours")
    g = s.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg((F.sum(F.col("value") * F.col("value")) / F.sum("value")).alias("v"))
    return _naive(drained(g, "complete").select("event_type", F.col("w.start").alias("day"), r6("vwap", F.col("v"))), "day")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2""")
def x_tumbling_window(spark, sf_dir):
    g = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return _naive(drained(g, "complete").select("event_type", F.col("w.start").alias("start"), "n"), "start")


@query("""SELECT s.start, count(*) AS n FROM events, LATERAL (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start) s GROUP BY 1""")
def x_sliding_window(spark, sf_dir):
    g = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return _naive(drained(g, "complete").select(F.col("w.start").alias("start"), "n"), "start")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def x_session_window(spark, sf_dir):
    g = event_stream(spark, sf_dir).withWatermark("ts", "12 hours").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return _naive(drained(g, "complete").select("user_id", F.col("w.start").alias("start"), "n"), "start")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON p.user_id = c.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def x_stream_join(spark, sf_dir):
    s = event_stream(spark, sf_dir)
    c = s.where("event_type = 'click'").select(F.col("user_id").alias("cu"), F.col("ts").alias("ct"), F.col("event_id").alias("click")).withWatermark("ct", "2 hours")
    p = s.where("event_type = 'purchase'").select(F.col("user_id").alias("pu"), F.col("ts").alias("pt"), F.col("event_id").alias("purchase")).withWatermark("pt", "2 hours")
    near = (F.col("cu") == F.col("pu")) & (F.col("pt") > F.col("ct")) & (F.col("pt") <= F.col("ct") + F.expr("INTERVAL 1 HOUR"))
    return drained(c.join(p, near)).select("click", "purchase")
