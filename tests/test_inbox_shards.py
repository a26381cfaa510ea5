"""Inboxes of many keys in one state: each as if it were alone, whatever is cut where."""

import numpy as np
import pandas as pd

from tidemark.streaming import state


class Held:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1


class Handle:
    def __init__(self):
        self.held = Held()

    def getValueState(self, *args):
        return self.held


def alone(rows, pace, capacity):
    """A list that is looked through for each message."""
    out, queue, last, dropped = [], [], None, 0
    for seq, (key, at, name) in enumerate(sorted(rows, key=lambda r: r[1:]), 1):
        queue, taken = [t for t in queue if t > at], None
        if len(queue) < capacity:
            taken = last = at if last is None else max(at, last + pace)
            queue += [taken] if taken > at else []
        dropped += taken is None
        out.append((key, name, at, seq, taken, dropped))
    return out


def test_keys_of_a_shard_are_kept_apart():
    rng = np.random.default_rng(5)
    rows = [(int(k), int(at), n) for n, (k, at) in enumerate(zip(rng.integers(0, 300, 6000), np.sort(rng.integers(0, 3000, 6000))))]
    want = [r for k in range(300) for r in alone([x for x in rows if x[0] == k], 150, 3)]
    assert any(r[4] is None for r in want) and any(r[4] is not None and r[4] > r[2] for r in want)
    handle, got = Handle(), []
    for batch in (rows[:2000], rows[2000:2001], rows[2001:]):
        work = state.Inbox(150, 3)
        work.init(handle)
        frame = pd.DataFrame(batch, columns=["key", "at", "id"])
        halves = [f for f in (frame.iloc[1::2], frame.iloc[::2]) if len(f)]  # frames of a call are in no order
        for out in work.handleInputRows((7,), iter(halves), None):
            got += [tuple(None if pd.isna(v) else int(v) for v in r) for r in out.itertuples(index=False)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert handle.held.calls == 3  # one call a shard and micro-batch, not one a key


def test_keys_share_calls(spark, tmp_path):
    """A call for a key costs milliseconds, so keys come by the shard, and no micro-batch runs for timers there are none of."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    seen, before = [], state.drained
    try:
        state.drained = lambda df, **kw: (seen.append((df._jdf.queryExecution().analyzed().toString(), spark.conf.get(name))), df)[1]
        path = str(tmp_path / "events.parquet")
        spark.sql("SELECT 1L AS key, TIMESTAMP '2024-01-01' AS ts, 1L AS id, 'a' AS token").coalesce(1).write.parquet(path)
        x = state.event_stream(spark, str(tmp_path))
        state.timed(x, state.Inbox(1))
        state.timed(x, state.Tokens(1))
    finally:
        state.drained = before
    assert "shard" in seen[0][0] and seen[0][1] == "false"
    assert "shard" not in seen[1][0] and seen[1][1] == "true"
    assert spark.conf.get(name) == "true"
