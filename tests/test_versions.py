"""Changes of stored tables are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions as ve


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(spark, tmp_path):
    t = ve.Versions(spark, str(tmp_path / "t"), "k bigint, part string, x int", "part")
    assert t.version() == 0 and rows(t.read()) == []
    t.append(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "a/b=%", 4)], "k long, part string, x int"))
    return t


def test_changes(spark, tmp_path):
    t = made(spark, tmp_path)
    start = [(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "a/b=%", 4)]
    assert rows(t.read()) == sorted(start, key=repr)
    t.replace_parts(spark.createDataFrame([(9, "b", 9), (8, None, 8), (7, "c", 7)], "k long, part string, x int"))
    assert rows(t.read()) == sorted([(1, "a", 1), (9, "b", 9), (8, None, 8), (7, "c", 7), (4, "a/b=%", 4)], key=repr)
    assert rows(t.read(1)) == sorted(start, key=repr)  # the former version is still there
    t.append(spark.createDataFrame([(10, "a", 0)], "k long, part string, x int"))
    assert t.move(F.col("x") < 5, "old") == 4
    assert rows(t.read()) == sorted([(1, "old", 1), (10, "old", 0), (9, "b", 9), (8, None, 8), (7, "c", 7), (4, "old", 4)], key=repr)
    assert t.move(F.col("x") < 5, "old") == 4  # nothing left to move: no new version
    t.replace_all(spark.createDataFrame([(0, "z", 0)], "k long, part string, x int"))
    assert rows(t.read()) == [(0, "z", 0)]


def test_a_failed_run_changes_nothing(spark, tmp_path, monkeypatch):
    t = made(spark, tmp_path)
    before = rows(t.read())
    boom = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "k long, part string, x int").withColumn("x", F.when(F.col("x") == 1, F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="boom"):
        t.replace_parts(boom)
    assert rows(t.read()) == before and t.version() == 1
    monkeypatch.setattr(t, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost before the last step")))
    with pytest.raises(OSError):
        t.move(F.col("x") < 3, "old")
    monkeypatch.undo()
    assert rows(t.read()) == before
    t.move(F.col("x") < 3, "old")
    assert [r[1] for r in rows(t.read())].count("old") == 2 and len(rows(t.read())) == 4


def test_the_second_of_two_changes_conflicts(spark, tmp_path):
    t = made(spark, tmp_path)
    folders = t.folders()
    t.commit(folders, 1)
    with pytest.raises(ve.Conflict):
        t.commit([], 1)
    assert t.version() == 2 and len(rows(t.read())) == 4


def test_insert_if_absent_and_newer_filings(spark):
    old = spark.createDataFrame([("a", 1, 5)], "k string, n int, x int")
    new = spark.createDataFrame([("a", 2, 6), ("b", 4, 7), ("b", 3, 8)], "k string, n int, x int")
    assert rows(ve.insert_absent(old, new, ["k"], "n")) == [("b", 3, 8)]
    both = spark.createDataFrame([("a", 1, 2), ("b", 9, 1)], "k string, n int, x int")
    assert rows(ve.newer_filings(old, both, ["k"], "n")) == [("a", 1, 2), ("a", 1, 5), ("b", 9, 1)]
