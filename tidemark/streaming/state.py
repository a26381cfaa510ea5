"""Keyed state with timers: heat that fades, inboxes of bounded size, tokens of sources that are forgotten.

Each key's state is its own value or list in the state store, and timers follow event time: what happens without a new row (a
level that falls, a token that runs out) is emitted once the watermark has passed its instant. A key's rows of a micro-batch
are taken in order of time, and between two of them whatever fell due, so rows and timers give the same output however the
input is cut into micro-batches, as long as no row comes later than the watermark allows (Spark drops such rows). A row that
isn't later than the key's last one is taken as if at the same instant. Rows without key or time are left out. What falls due
after the last watermark is still to come and isn't emitted; a run that goes on later emits it.

A call for a key costs milliseconds, whatever it does. So a processor without timers may name ``SHARDS``: keys are dealt to so
many groups by hash, whose states are one value each, and a call takes all rows of a group.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.registry import query
from tidemark.streaming.stream import drained, event_stream

HALF_LIFE = 45 * 60 * 1_000_000
CEILING = 20.0
LEVELS = (2.0, 6.0)
FORGOTTEN = 0.05
CAPACITY = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession, timers: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which values, lists and timers of a key ask for. Without timers
    nothing falls due, and no micro-batch without rows is run."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({} if timers else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, whose size the source bounds, by time."""
    return pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")


def faded(score: float, past: int) -> float:
    """A score after some microseconds: halves with each half-life, linearly inside one."""
    if past <= 0:
        return score
    whole, rest = divmod(past, HALF_LIFE)
    return score * 0.5 ** whole * (1 - 0.5 * (rest / HALF_LIFE))


def below(score: float, at: int, bar: float) -> int:
    """The first millisecond at which a score, ``bar`` or more at ``at``, has faded below it."""
    whole = math.floor(math.log2(score / bar))
    return math.floor((at + (whole + 2 * (1 - bar * 2**whole / score)) * HALF_LIFE) / 1000) + 1


def falls(score: float, at: int, level: int, upto: int) -> list[tuple[int, int]]:
    """(millisecond, level) of each fall up to a millisecond."""
    due = [(below(score, at, LEVELS[k - 1]), k - 1) for k in range(level, 0, -1)]
    return [d for d in due if d[0] <= upto]


def framed(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=columns)


class Heat(StatefulProcessor):
    """Rows (key, at, id, gain) to changes of level (key, at, level, heat). A key whose heat has faded to nothing is removed."""

    OUT = "key long, at long, level int, heat double"
    NAMES = ["key", "at", "level", "heat"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("heat", "score double, at long, level int")

    def _wait(self, score: float, at: int, level: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if score < FORGOTTEN:
            self.held.clear()
            return
        self.held.update((score, at, level))
        self.handle.registerTimer(below(score, at, LEVELS[level - 1] if level else FORGOTTEN))

    def handleInputRows(self, key, rows, timerValues):
        score, at, level = self.held.get() if self.held.exists() else (0.0, 0, 0)
        out = []
        for now, gain in in_order(rows)[["at", "gain"]].itertuples(index=False):
            for t, k in falls(score, at, level, now // 1000):
                out.append((key[0], t * 1000, k, faded(score, t * 1000 - at)))
                level = k
            left = faded(score, now - at)
            score, at = min(CEILING, (left if left >= FORGOTTEN else 0.0) + gain), max(now, at)
            rise = sum(score >= bar for bar in LEVELS)
            if rise > level:
                out.append((key[0], now, rise, score))
                level = rise
        self._wait(score, at, level)
        yield from framed(out, self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.held.exists():
            return
        score, at, level = self.held.get()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        out = [(key[0], t * 1000, k, faded(score, t * 1000 - at)) for t, k in falls(score, at, level, now)]
        level = out[-1][2] if out else level
        if level == 0 and below(score, at, FORGOTTEN) <= now:
            self.held.clear()
        else:
            self._wait(score, at, level)
        yield from framed(out, self.NAMES)

    def close(self) -> None:
        pass


class Inbox(StatefulProcessor):
    """Rows (key, at, id) to (key, id, at, seq, taken, dropped). A reader takes a message at a time, ``pace`` microseconds
    apart; at most ``capacity`` wait, and one that finds no room is dropped (``taken`` null) and counted. Numbers go on over
    dropped ones, so that a reader sees the gap. The state of a shard has an entry a key: its counts and what waits."""

    OUT = "key long, id long, at long, seq long, taken long, dropped long"
    SHARDS = 4096

    def __init__(self, pace: int, capacity: int = CAPACITY):
        self.pace, self.capacity = pace, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("inboxes", "keys array<long>, seq array<long>, dropped array<long>, last array<long>, waiting array<array<long>>")

    def handleInputRows(self, key, rows, timerValues):
        held = {k: (*counts, deque(queue)) for k, *counts, queue in zip(*self.held.get())} if self.held.exists() else {}
        columns = ("key", "at", "id")
        parts = [[pdf[c].to_numpy() for c in columns] for pdf in rows]
        keys, ats, ids = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, ats, keys))
        keys, ats, ids = keys[order], ats[order], ids[order]
        numbers, lost, takes = [], [], []
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip([0, *ends], ends):
            name = int(keys[start])
            seq, dropped, last, queue = held.get(name, (0, 0, None, deque()))
            for now in ats[start:end].tolist():
                while queue and queue[0] <= now:  # what waits is in order of time
                    queue.popleft()
                seq, taken = seq + 1, None
                if len(queue) < self.capacity:
                    taken = last = now if last is None else max(now, last + self.pace)
                    if taken > now:
                        queue.append(taken)
                dropped += taken is None
                numbers.append(seq)
                takes.append(taken)
                lost.append(dropped)
            held[name] = (seq, dropped, last, queue)
        self.held.update((list(held), *([v[c] for v in held.values()] for c in range(3)), [list(v[3]) for v in held.values()]))
        yield pd.DataFrame({"key": keys, "id": ids, "at": ats, "seq": numbers, "taken": pd.array(takes, "Int64"), "dropped": lost})

    def close(self) -> None:
        pass


class Tokens(StatefulProcessor):
    """Polls (key, at, id, token) to what they change: ``new``, ``changed``, or ``expired`` at ``keep`` microseconds after the
    last poll. A poll with the token last seen changes nothing but the time; a null token is a token of its own."""

    OUT = "key long, at long, status string, token string"
    NAMES = ["key", "at", "status", "token"]

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("token", "token string, at long")

    def _due(self, at: int) -> int:
        return (at + self.keep) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        known = self.held.exists()
        token, at = self.held.get() if known else (None, 0)
        out = []
        for now, seen in in_order(rows)[["at", "token"]].itertuples(index=False):
            seen = None if pd.isna(seen) else seen
            if known and self._due(at) <= now // 1000:
                out.append((key[0], self._due(at) * 1000, "expired", token))
                known = False
            if not known or seen != token:
                out.append((key[0], now, "changed" if known else "new", seen))
            known, token, at = True, seen, max(now, at)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.held.update((token, at))
        self.handle.registerTimer(self._due(at))
        yield from framed(out, self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.held.exists():
            token, at = self.held.get()
            self.held.clear()
            yield from framed([(key[0], self._due(at) * 1000, "expired", token)], self.NAMES)

    def close(self) -> None:
        pass


def timed(stream: DataFrame, work: StatefulProcessor, delay: str = "0 seconds", name: str | None = None) -> DataFrame:
    """Runs a stream with columns key, ts and id through a processor until nothing is left; instants come back as ``at``.
    ``delay``: how far behind the latest row others may come."""
    x = stream.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    shards = getattr(work, "SHARDS", None)
    x = x.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))) if shards else x
    with rocks(stream.sparkSession, timers=not shards):
        rows = drained(x.groupBy("shard" if shards else "key").transformWithStateInPandas(work, work.OUT, "Append", "EventTime"), name=name)
    return rows.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("at", "taken") if c in rows.columns})


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream by user, at most 256 MB of files a micro-batch."""
    return event_stream(spark, sf_dir, size=256 << 20).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "event_type", "value")


_H = 45 * 60 * 1000000
_BELOW = lambda bar: f"(floor((u + (floor(log2(s / {bar})) + 2 * (1 - {bar} * pow(2, floor(log2(s / {bar}))) / s)) * {_H}) / 1000) + 1)"
_FADED = lambda s, past: f"({s} * pow(0.5, floor(({past}) / {_H})) * (1 - 0.5 * ((({past}) % {_H}) / {_H})))"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS t, value / 25 AS gain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT key, k, t AS u, least(20, gain) AS s, 0.0::DOUBLE AS b FROM e WHERE k = 1 UNION ALL
  SELECT e.key, e.k, e.t, least(20, CASE WHEN {_FADED('w.s', 'e.t - w.u')} >= 0.05 THEN {_FADED('w.s', 'e.t - w.u')} ELSE 0 END + e.gain), {_FADED('w.s', 'e.t - w.u')} FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1),
n AS (SELECT *, lead(u) OVER (PARTITION BY key ORDER BY k) // 1000 AS until, (SELECT max(epoch_us(ts)) // 1000 FROM events) AS mark FROM w),
f AS (SELECT key, s, u, lvl, CASE lvl WHEN 1 THEN {_BELOW('6.0')} ELSE {_BELOW('2.0')} END::BIGINT AS ms, coalesce(until, mark) AS upto FROM n, (VALUES (0), (1)) v(lvl) WHERE s >= CASE lvl WHEN 1 THEN 6 ELSE 2 END),
r AS (SELECT key, u, s, CASE WHEN s >= 6 THEN 2 WHEN s >= 2 THEN 1 ELSE 0 END AS now, CASE WHEN b >= 6 THEN 2 WHEN b >= 2 THEN 1 ELSE 0 END AS before FROM n)
SELECT key, make_timestamp(ms * 1000) AS at, lvl AS level, round({_FADED('s', 'ms * 1000 - u')}, 6) AS heat FROM f WHERE ms <= upto
UNION ALL SELECT key, make_timestamp(u), now, round(s, 6) FROM r WHERE now > before""")
def x7_heat_timers(spark, sf_dir):
    """When each user turns warm (2) or hot (6), by an event, and when that fades, by a timer."""
    rows = timed(user_events(spark, sf_dir).withColumn("gain", F.coalesce(F.col("value"), F.lit(0.0)) / 25), Heat())
    return rows.select("key", "at", "level", F.round("heat", 6).alias("heat"))


_PACE = 5 * 24 * 3600 * 1000000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT key, id, t, k, t AS last, t AS taken, 0::BIGINT AS dropped FROM e WHERE k = 1 UNION ALL
  SELECT e.key, e.id, e.t, e.k, CASE WHEN (w.last - e.t + {_PACE} - 1) // {_PACE} >= 64 THEN w.last ELSE greatest(e.t, w.last + {_PACE}) END,
   CASE WHEN (w.last - e.t + {_PACE} - 1) // {_PACE} >= 64 THEN NULL ELSE greatest(e.t, w.last + {_PACE}) END,
   w.dropped + CASE WHEN (w.last - e.t + {_PACE} - 1) // {_PACE} >= 64 THEN 1 ELSE 0 END FROM w JOIN e ON e.key = w.key AND e.k = w.k + 1)
SELECT key, id, make_timestamp(t) AS at, k AS seq, make_timestamp(taken) AS taken, dropped FROM w""")
def x1_bounded_inbox(spark, sf_dir):
    """Each user's events as messages to a reader who takes one in five days: 64 wait, further ones are dropped and counted."""
    return timed(user_events(spark, sf_dir).select("key", "ts", "id"), Inbox(_PACE))


_KEEP = 24 * 3600 * 1000000


@query(f"""WITH e AS (SELECT user_id AS key, event_type AS token, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS before, lag(event_type) OVER w AS had, lead(epoch_us(ts)) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, (t + {_KEEP}) // 1000 + 1 AS due, coalesce((before + {_KEEP}) // 1000 + 1 <= t // 1000, true) AS gone, (SELECT max(epoch_us(ts)) // 1000 FROM events) AS mark FROM e)
SELECT key, make_timestamp(t) AS at, CASE WHEN gone THEN 'new' ELSE 'changed' END AS status, token FROM d WHERE gone OR token IS DISTINCT FROM had
UNION ALL SELECT key, make_timestamp(due * 1000), 'expired', token FROM d WHERE due <= coalesce(after // 1000, mark)""")
def x7_source_tokens(spark, sf_dir):
    """The last token seen of each source, here the kind of a user's last event, forgotten after a day without a poll."""
    return timed(user_events(spark, sf_dir).select("key", "ts", "id", F.col("event_type").alias("token")), Tokens(_KEEP))
