"""Tables with versions: sinks that replace, move and append, of which each change is seen whole or not at all (S22, S28, S30,
S31).

A version is a small list of folders with their partition's key. A change writes its rows to new folders first and then
puts the next list in place by one rename; where that list is there already, another change came first, and it fails. So a run that fails in between leaves
the table as it was, and readers of an older version keep their files. The list has a line for each folder and partition,
not for each row; rows never pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.registry import query, table


class Conflict(RuntimeError):
    """Another change came first."""


class Versions:
    """A table at ``path`` in parts by the column ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = spark.createDataFrame([], schema).schema
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the newest list; 0 before the first change."""
        if not self._fs.exists(self._path("lists")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("lists"))]
        return max((int(n) for n in names if n.isdecimal()), default=0)

    def folders(self, version: int | None = None) -> list[tuple[str, str]]:
        """(key of a part, folder) of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(f"{self.path}/lists/{version}").collect()  # a line for each folder and part
        return [tuple(json.loads(r.value)) for r in lines]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one."""
        where = [f"{self.path}/{folder}" for _, folder in self.folders(version)]
        return self.spark.read.schema(self.schema).parquet(*where) if where else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> list[tuple[str, str]]:
        """New folders with ``rows``, one for each part; they count once a list names them."""
        at = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema]
        kept = rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in names])
        kept.withColumn("_part", F.coalesce(F.col(self.by).cast("string"), F.lit(""))).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{at}")
        out = []
        for s in self._fs.listStatus(self._path(at)):
            name = s.getPath().getName()
            if name.startswith("_part="):
                key = unquote(name.removeprefix("_part="))  # Spark writes empty keys by a name of their own
                out.append(("" if key == "__HIVE_DEFAULT_PARTITION__" else key, f"{at}/{name}"))
        return out

    def commit(self, folders: list[tuple[str, str]], after: int) -> int:
        """Puts the list of version ``after`` + 1 in place; the last step of a change."""
        draft = f"drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(f),) for f in folders], "value string").coalesce(1).write.text(f"{self.path}/{draft}")
        self._fs.mkdirs(self._path("lists"))
        if self._fs.exists(self._path(f"lists/{after + 1}")) or not self._fs.rename(self._path(draft), self._path(f"lists/{after + 1}")):
            raise Conflict(f"version {after + 1} is there already")
        return after + 1

    def append(self, rows: DataFrame) -> int:
        now = self.version()
        return self.commit(self.folders(now) + self.write(rows), now)

    def replace_parts(self, rows: DataFrame) -> int:
        """Each part that ``rows`` has takes the place of the part there; others stay."""
        now = self.version()
        new = self.write(rows)
        keys = {k for k, _ in new}
        return self.commit([f for f in self.folders(now) if f[0] not in keys] + new, now)

    def replace_all(self, rows: DataFrame) -> int:
        now = self.version()
        return self.commit(self.write(rows), now)

    def move(self, rows: Column, to: str) -> int:
        """Rows for which ``rows`` holds go to the part ``to``, in one change: those parts that have any are written anew
        without them. Run again it finds none."""
        now = self.version()
        hit, changed = F.coalesce(rows, F.lit(False)), F.col(self.by).cast("string") != to
        old = self.folders(now)
        x = self.read(now)
        touched = {r[0] for r in x.where(hit & changed).select(F.coalesce(F.col(self.by).cast("string"), F.lit(""))).distinct().collect()}  # keys of parts
        if not touched:
            return now
        part = x.where(F.coalesce(F.col(self.by).cast("string"), F.lit("")).isin(sorted(touched)))
        moved = part.where(hit).withColumn(self.by, F.lit(to).cast(self.schema[self.by].dataType))
        new = self.write(part.where(~hit).unionByName(moved))
        return self.commit([f for f in old if f[0] not in touched] + new, now)


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``batch`` whose key is not stored, of one key that with the smallest ``order``."""
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*").select(*batch.columns)
    return first.join(stored.select(*keys), keys, "left_anti")


def newer_filings(stored: DataFrame, batch: DataFrame, unit: list[str], filing: str) -> DataFrame:
    """What replaces the parts of ``batch``: of each ``unit`` (a fund and quarter) all rows of its newest filing, stored or new."""
    both = stored.unionByName(batch)
    top = both.groupBy(*unit).agg(F.max(filing).alias(filing))
    return both.join(top, [*unit, filing], "left_semi")


# Queries: a table made in three changes and read back.


def _place(spark, name: str) -> str:
    from tidemark.streaming.stream import place

    return place(spark, None).replace("stream-", f"{name}-")


@query("""SELECT event_id, ts, event_type, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'cold' ELSE 'hot' END AS tier FROM events""")
def s22_tier_mover(spark, sf_dir):
    """All events come in as hot; those before one day are moved, then those before a later one; a third run moves none."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.lit("hot").alias("tier"))
    t = Versions(spark, _place(spark, "tiers"), e.schema, "tier")
    t.append(e)
    for day in ("2024-01-10", "2024-01-20", "2024-01-20"):
        t.move(F.col("ts") < F.lit(day).cast("timestamp_ntz"), "cold")
    return t.read()


@query("""WITH h AS (SELECT l_suppkey AS fund, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, l_partkey AS cusip, l_orderkey AS filing, sum(l_quantity)::DOUBLE AS shares FROM lineitem GROUP BY 1, 2, 3, 4),
m AS (SELECT fund, period, max(filing) AS filing FROM h GROUP BY 1, 2) SELECT fund, period, cusip, filing, shares FROM h JOIN m USING (fund, period, filing)""")
def s28_holdings_sink(spark, sf_dir):
    """Filings come in two batches by their number; a newer one takes the place of its fund's older one of the quarter."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fund"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("period"), F.col("l_partkey").alias("cusip"), F.col("l_orderkey").alias("filing")).agg(F.sum("l_quantity").cast("double").alias("shares"))
    t = Versions(spark, _place(spark, "holdings"), h.schema, "period")
    for part in (F.col("filing") % 3 > 0, F.col("filing") % 3 == 0):
        batch = h.where(part)
        stored = t.read().join(batch.select("period").distinct(), "period", "left_semi")
        t.replace_parts(newer_filings(stored, batch, ["fund", "period"], "filing"))
    return t.read()


@query("""SELECT n_nationkey AS id, upper(n_name) AS name, 2 AS loaded FROM nation WHERE n_regionkey > 0""")
def s31_replaced_dimension(spark, sf_dir):
    """A small dimension replaced wholesale: what the new load lacks is gone."""
    n = table(spark, sf_dir, "nation")
    load = lambda k, name: n.select(F.col("n_nationkey").alias("id"), name.alias("name"), F.lit(k).alias("loaded"), "n_regionkey")
    t = Versions(spark, _place(spark, "nations"), "id bigint, name string, loaded int", "loaded")
    t.replace_all(load(1, F.col("n_name")))
    t.replace_all(load(2, F.upper("n_name")).where("n_regionkey > 0"))
    return t.read()
