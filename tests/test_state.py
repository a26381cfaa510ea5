"""Keyed state: the same rows however the input is cut and wherever a run stops, and cases that the tables don't hold."""

import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import state
from tidemark.streaming.stream import event_stream

WORK = {
    "heat": (state.Heat, lambda x: x.withColumn("gain", F.col("value") / 25)),
    "inbox": (lambda: state.Inbox(3 * 24 * 3600 * 1000000, 8), lambda x: x),
    "tokens": (lambda: state.Tokens(24 * 3600 * 1000000), lambda x: x.withColumn("token", F.col("event_type"))),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cut(sf_dir, folder, parts, of=4):
    """Puts some of the parts of the events, in order of time, into a folder as files of their own."""
    whole = pq.read_table(f"{sf_dir}/events.parquet").sort_by("ts")
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    n = -(-whole.num_rows // of)
    for k in parts:
        at = f"{folder}/events.parquet/part-{k}.parquet"
        pq.write_table(whole.slice(k * n, n), at)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))


def stream(spark, folder):
    return event_stream(spark, folder, files=1).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), "event_type", "value")


@pytest.mark.parametrize("kind", WORK)
def test_micro_batches_and_restart_change_nothing(spark, sf_dir, tmp_path, kind):
    make, shape = WORK[kind]
    want = rows(state.timed(shape(state.user_events(spark, sf_dir)), make()))
    assert want
    name = f"restart-{kind}-{os.getpid()}"
    cut(sf_dir, tmp_path, [0, 1])
    first = rows(state.timed(shape(stream(spark, str(tmp_path))), make(), name=name))
    assert 0 < len(first) < len(want)
    cut(sf_dir, tmp_path, [2, 3])
    assert rows(state.timed(shape(stream(spark, str(tmp_path))), make(), name=name)) == want


def write(spark, folder, data):
    spark.createDataFrame(data, "key long, ts timestamp, id long, gain double, token string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return event_stream(spark, folder)


def test_small_cases(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    h = lambda x: t + dt.timedelta(hours=x)
    data = [(1, t, 1, 8.0, "a"), (1, t, 2, 8.0, "a"), (1, h(0.1), 3, 30.0, None), (2, t, 4, 0.0, "x"), (None, t, 5, 9.0, "a"), (1, None, 6, 9.0, "a"), (3, h(40), 7, 1.0, "z")]
    x = write(spark, str(tmp_path / "some"), data)

    heat = rows(state.timed(x, state.Heat()))
    falls = [(k, at, level) for k, at, level, s in heat]
    assert falls[:1] == [(1, t, 2)] and len(falls) == 3 and [f[2] for f in falls] == [2, 1, 0]
    # 20 at 0:06, halved to 10 after 45 minutes, below 6 after 2 * (1 - 6 / 10) of the next 45, and below 2 in the fourth
    assert abs(falls[1][1] - (h(0.1) + dt.timedelta(minutes=45 + 36))) <= dt.timedelta(milliseconds=1)
    assert abs(falls[2][1] - (h(0.1) + dt.timedelta(minutes=3 * 45 + 45 * 2 * (1 - 2 / 2.5)))) <= dt.timedelta(milliseconds=1)

    inbox = rows(state.timed(x, state.Inbox(3_600_000_000, 1)))
    assert [r[1:2] + r[3:] for r in inbox if r[0] == 1] == [(1, 1, t, 0), (2, 2, h(1), 0), (3, 3, None, 1)]

    tokens = rows(state.timed(x, state.Tokens(24 * 3_600_000_000)))
    assert [(r[2], r[3]) for r in tokens if r[0] == 1] == [("new", "a"), ("changed", None), ("expired", None)]
    assert [r[2] for r in tokens if r[0] == 3] == ["new"]


@pytest.mark.parametrize("kind", WORK)
def test_empty(spark, tmp_path, kind):
    x = write(spark, str(tmp_path / "none"), [])
    assert rows(state.timed(x, WORK[kind][0]())) == []


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as S

    from tidemark.streaming.stream import shared_dir

    def session(master, where):
        return S(conf=S(get=lambda name, other: None), sparkContext=S(master=master, getConf=lambda: S(get=lambda name: where)))

    assert shared_dir(session("spark://host:7077", "/shared/x/")) == "/shared/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", None))
