"""Statements merged by period."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions.predicates import expectation
from tidemark.operators.market import verdict
from tidemark.sources import statements as st

D = datetime.date


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, period_end date, line string, value double")


def test_precedence_snapping_and_report_dates(spark):
    income = frame(spark, [("A", D(2024, 3, 31), "Rev", 1.0), ("A", D(2024, 3, 31), "Debt", 5.0), ("A", D(2024, 6, 30), "Rev", 2.0), ("B", D(2024, 3, 31), "Rev", float("nan")), ("C", D(2024, 3, 31), "Rev", None)])
    balance = frame(spark, [("A", D(2024, 4, 2), "Debt", 7.0), ("A", D(2024, 6, 22), "Debt", 8.0), ("A", D(2024, 6, 30), "Rev", float("inf")), ("B", D(2024, 3, 31), "Odd", 1.0)])
    annual = frame(spark, [("A", D(2024, 3, 31), "Rev", 9.0)])
    said = spark.createDataFrame([("A", D(2024, 3, 30)), ("A", D(2024, 5, 1)), ("A", D(2024, 5, 9)), ("B", D(2024, 10, 8))], "symbol string, announced date")
    names = {"Rev": "revenue", "Debt": "debt"}
    got = {(r.symbol, r.period_end, r.period_type): (r.report_date, r.metrics, r.raw) for r in st.merged([(income, names, "quarter"), (annual, names, "year"), (balance, names, "quarter")], said).collect()}
    first = D(2024, 5, 1)
    assert got == {
        ("A", D(2024, 3, 31), "quarter"): (first, {"revenue": 1.0, "debt": 7.0}, {"Rev": 1.0, "Debt": 7.0}),
        ("A", D(2024, 6, 30), "quarter"): (None, {"revenue": 2.0}, {"Rev": 2.0}),
        ("A", D(2024, 6, 22), "quarter"): (None, {"debt": 8.0}, {"Debt": 8.0}),
        ("A", D(2024, 3, 31), "year"): (first, {"revenue": 9.0}, {"Rev": 9.0}),
        ("B", D(2024, 3, 31), "quarter"): (None, {}, {"Odd": 1.0}),
    }
    assert st.merged([(income.limit(0), names, "quarter")], said).count() == 0


def test_nearest_end_and_bound_of_reports(spark):
    ends = spark.createDataFrame([("A", D(2024, 1, 1)), ("A", D(2024, 1, 7))], "symbol string, period_end date")
    x = frame(spark, [("A", D(2024, 1, 4), "a", 1.0), ("A", D(2024, 1, 5), "b", 1.0), ("A", D(2024, 1, 12), "c", 1.0), ("A", D(2024, 1, 13), "d", 1.0), ("B", D(2024, 1, 1), "e", 1.0)])
    got = {r.line: r.period_end for r in st.snapped(x, ends, 5).collect()}
    assert got == {"a": D(2024, 1, 1), "b": D(2024, 1, 7), "c": D(2024, 1, 7), "d": D(2024, 1, 13), "e": D(2024, 1, 1)}
    p = spark.createDataFrame([("A", D(2024, 1, 1)), ("B", D(2024, 1, 1))], "symbol string, period_end date")
    said = spark.createDataFrame([("A", D(2024, 7, 9)), ("B", D(2024, 7, 10))], "symbol string, announced date")
    assert {r.symbol: r.report_date for r in st.report_dates(p, said).collect()} == {"A": D(2024, 7, 9), "B": None}
    again = spark.createDataFrame([("A", D(2024, 1, 1), "q", 1, 5), ("A", D(2024, 1, 1), "q", 2, 4)], "symbol string, period_end date, period_type string, stored int, x int")
    assert [r.x for r in st.latest_records(again, "stored").collect()] == [4]


def test_expectation_and_verdict(spark):
    rows = spark.createDataFrame([(1, 0.0, 3.2), (2, 2.0, 1.0), (3, None, 9.0), (4, 0.0, -1.0), (5, 0.0, 2.5)], "k int, last double, pick double")
    zero = [F.lit(0.0)] * 4
    got = {r.k: r.e for r in rows.select("k", expectation([*zero, F.col("last")], F.col("pick")).alias("e")).collect()}
    assert got == {1: 0.75, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.75}
    v = spark.createDataFrame([(99.0, 20, 1.0), (50.0, 20, 1.0), (70.0, 20, 1.0), (None, 9, 1.0), (None, 20, 1.0), (None, 20, None)], "b double, t int, e double")
    assert [r.v for r in v.select(verdict(F.col("b"), F.col("t"), F.col("e")).alias("v")).collect()] == ["skill", "luck", "unclear", "too few trades", "ahead", "behind"]


def test_frames_are_read_once(spark):
    frame = lambda n, ends: spark.createDataFrame([("A", D(2024, *e), n, 1.0 + k) for k, e in enumerate(ends)], "symbol string, period_end date, line string, value double")
    lead, other = frame("x", [(3, 31), (4, 6), (6, 30)]), frame("y", [(4, 3), (6, 27), (8, 1)])
    said = spark.createDataFrame([("A", D(2024, 6, 30))], "symbol string, announced date")
    m = st.merged([(lead, {"x": "m"}, "quarter"), (other, {}, "quarter")], said)
    got = {r.period_end: (r.report_date, r.metrics, r.raw) for r in m.collect()}
    assert got == {
        D(2024, 3, 31): (D(2024, 6, 30), {"m": 1.0}, {"x": 1.0, "y": 1.0}), D(2024, 4, 6): (D(2024, 6, 30), {"m": 2.0}, {"x": 2.0}),
        D(2024, 6, 30): (D(2024, 6, 30), {"m": 3.0}, {"x": 3.0, "y": 2.0}), D(2024, 8, 1): (None, {}, {"y": 3.0}),
    }
    assert m._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
