"""Statements of companies merged to one record a period.

Frames are long: a row for each company, period and line. Those of one kind of period are joined in full: of a line that
several frames have the later frame's value counts. Period ends that lie within some days of the leading frame's are taken
for its, the nearest first. A record was known on the day of the first announcement within 190 days of its period's end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.registry import query, table

LATEST = 190


def _near(a: Column, days: int) -> Column:
    return F.floor(F.unix_date(a) / days).cast("long")


def snapped(frame: DataFrame, ends: DataFrame, tolerance: int) -> DataFrame:
    """``frame`` (symbol, period_end, ...) with each period end moved to the nearest of ``ends`` (symbol, period_end) within
    ``tolerance`` days, the earlier of two as near; others stay. An equi-join on slots of that length."""
    own = frame.select("symbol", "period_end").distinct()
    slot = _near(F.col("period_end"), tolerance)
    left = own.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    right = ends.distinct().select("symbol", F.col("period_end").alias("to"), _near(F.col("period_end"), tolerance).alias("slot"))
    off = F.abs(F.datediff("to", "period_end"))
    best = left.join(right, ["symbol", "slot"]).where(off <= tolerance).groupBy("symbol", "period_end").agg(F.min(F.struct(off.alias("off"), "to")).alias("b"))
    return frame.join(best, ["symbol", "period_end"], "left").withColumn("period_end", F.coalesce("b.to", "period_end")).drop("b")


def report_dates(periods: DataFrame, announcements: DataFrame) -> DataFrame:
    """``periods`` (symbol, period_end, ...) with the first of ``announcements`` (symbol, announced) from the period's end on,
    none if it comes later than ``LATEST`` days."""
    # Later dates come first, so the nearest announcement from a period's end on is a running least value.
    said = announcements.where("symbol IS NOT NULL AND announced IS NOT NULL").select("symbol", F.col("announced").alias("day"), "announced", F.lit(False).alias("period"))
    both = periods.withColumns({"day": F.col("period_end"), "period": F.lit(True)}).unionByName(said, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy(F.desc("day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    next_ = both.withColumn("announced", F.min("announced").over(w)).where("period")
    return next_.select(*periods.columns, F.when(F.col("announced") <= F.date_add("period_end", LATEST), F.col("announced")).alias("report_date"))


def merged(frames: list[tuple[DataFrame, dict[str, str], str]], announcements: DataFrame, tolerance: int = 5) -> DataFrame:
    """(symbol, period_end, period_type, report_date, metrics, raw): one record for each company, period end and kind of
    period. ``frames``: (symbol, period_end, line, value) with the names of the lines that are metrics and the kind, in
    order of precedence, the last one strongest; the first frame of a kind sets its period ends. Values that are not finite
    don't count, and a period without any has no record."""
    first = {kind: nth for nth, (_, _, kind) in reversed(list(enumerate(frames)))}
    rows = []
    for nth, (frame, names, kind) in enumerate(frames):
        x = frame.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
        metric = F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("line")) if names else F.lit(None).cast("string")
        rows.append(x.select("symbol", "period_end", F.lit(kind).alias("period_type"), F.lit(nth).alias("nth"), F.lit(nth == first[kind]).alias("leads"), "line", metric.alias("metric"), "value"))
    # All frames in one pass by company, each period a row; the nearest leading end before and after are running values.
    every = reduce(DataFrame.unionByName, rows).repartition("symbol")
    every = every.groupBy("symbol", "period_type", "period_end", "nth", "leads").agg(F.collect_list(F.struct("line", "metric", "nth", "value")).alias("values"))
    end, lead = F.col("period_end"), F.when(F.col("leads"), F.col("period_end"))
    w = Window.partitionBy("symbol", "period_type")
    running = (Window.unboundedPreceding, Window.currentRow)
    every = every.withColumn("before", F.max(lead).over(w.orderBy("period_end").rangeBetween(*running))).withColumn("after", F.min(lead).over(w.orderBy(F.desc("period_end")).rangeBetween(*running)))
    near = lambda c: F.coalesce(F.abs(F.datediff(c, end)) <= tolerance, F.lit(False))
    late = near("after") & (~near("before") | (F.datediff("after", end) < F.datediff(end, "before")))
    every = every.withColumn("period_end", F.when(F.col("leads") | F.col("symbol").isNull(), end).when(late, F.col("after")).when(near("before"), F.col("before")).otherwise(end))
    key = ["symbol", "period_end", "period_type"]
    whole = every.groupBy(*key).agg(F.flatten(F.collect_list("values")).alias("values"))

    def last(name: str) -> Column:
        """Of each name the value of the last frame; two ends of a frame may be snapped together, then the larger counts."""
        of = lambda n: F.array_max(F.transform(F.filter("values", lambda v: v[name] == n), lambda v: F.struct(v["nth"], v["value"])))["value"]
        names = F.array_sort(F.array_distinct(F.filter(F.transform("values", lambda v: v[name]), lambda n: n.isNotNull())))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, of(n))))

    return report_dates(whole.select(*key, last("metric").alias("metrics"), last("line").alias("raw")), announcements).select(*key, "report_date", "metrics", "raw").where(F.size("raw") > 0)


def latest_records(history: DataFrame, version: str) -> DataFrame:
    """Of records stored again and again the newest of each company, period end and kind."""
    w = Window.partitionBy("symbol", "period_end", "period_type").orderBy(F.desc(version))
    return history.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


# Query: a customer's orders stand for a company's statements.

NAMES = {"Total Revenue": "revenue", "Orders": "orders", "Largest": "largest"}
_FRAMES = [("o_orderstatus <> 'X'", "quarter", 0), ("o_orderstatus <> 'X'", "year", 0), ("o_orderstatus = 'O'", "quarter", 2), ("o_orderstatus = 'O'", "year", -3), ("o_orderstatus = 'F'", "quarter", 9), ("o_orderstatus = 'F'", "year", 1)]


def _frame(o: DataFrame, where: str, unit: str, shift: int) -> DataFrame:
    end = F.date_add(F.last_day(F.date_trunc(unit, "o_orderdate") + F.expr("INTERVAL 2 MONTH" if unit == "quarter" else "INTERVAL 11 MONTH")), shift)
    g = o.where(where).groupBy(F.col("o_custkey").alias("symbol"), end.alias("period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"), F.count("*").cast("double").alias("b"), F.max("o_totalprice").alias("c"))
    lines = [("Total Revenue", "a"), ("Orders" if shift % 2 == 0 else "Filled", "b"), ("Largest", "c")]
    return g.select("symbol", "period_end", F.inline(F.array(*[F.struct(F.lit(n).alias("line"), F.col(c).alias("value")) for n, c in lines])))


def _frames_sql() -> str:
    out = []
    for nth, (where, unit, shift) in enumerate(_FRAMES):
        end = f"last_day(CAST(date_trunc('{unit}', o_orderdate) + INTERVAL {2 if unit == 'quarter' else 11} MONTH AS DATE)) + {shift}"
        lines = f"['Total Revenue', '{'Orders' if shift % 2 == 0 else 'Filled'}', 'Largest']"
        g = f"SELECT o_custkey AS symbol, CAST({end} AS DATE) AS period_end, [round(sum(o_totalprice), 2), count(*)::DOUBLE, max(o_totalprice)] AS v FROM orders WHERE {where} GROUP BY 1, 2"
        lead = "period_end" if nth < 2 else f"coalesce((SELECT l.period_end FROM f{nth % 2} l WHERE l.symbol = g.symbol AND abs(l.period_end - g.period_end) <= 5 ORDER BY abs(l.period_end - g.period_end), l.period_end LIMIT 1), period_end)"
        out.append(f"f{nth} AS (SELECT symbol, {lead} AS period_end, '{unit}' AS period_type, {nth} AS nth, unnest({lines}) AS line, unnest(v) AS value FROM ({g}) g)")
    return ", ".join(out)


@query(f"""WITH {_frames_sql()}, u AS ({" UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(6))}), l AS (SELECT symbol, period_end, period_type, line, arg_max(value, nth) AS value FROM u GROUP BY 1, 2, 3, 4),
a AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS announced FROM orders WHERE o_orderpriority = '1-URGENT'), p AS (SELECT DISTINCT symbol, period_end FROM l),
d AS (SELECT p.symbol, p.period_end, min(announced) AS report_date FROM p LEFT JOIN a ON a.symbol = p.symbol AND announced >= period_end AND announced <= period_end + 190 GROUP BY 1, 2)
SELECT symbol, period_end, period_type, report_date, max(value) FILTER (line = 'Total Revenue') AS revenue, max(value) FILTER (line = 'Orders') AS orders, max(value) FILTER (line = 'Largest') AS largest, count(*) AS lines FROM l JOIN d USING (symbol, period_end) GROUP BY 1, 2, 3, 4""")
def s21_merged_statements(spark, sf_dir):
    """Six frames; the weaker ones' period ends lie some days off, those of one of them too far to be snapped."""
    # One shuffle, of which all frames take their sums.
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority").repartition("o_custkey")
    frames = [(_frame(o, *f), NAMES, f[1]) for f in _FRAMES]
    announced = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("announced"))
    m = merged(frames, announced)
    return m.select("symbol", "period_end", "period_type", "report_date", *[F.try_element_at("metrics", F.lit(c)).alias(c) for c in NAMES.values()], F.size("raw").cast("long").alias("lines"))
