"""Line dedup (operator 6): DataFrame operations only.

A line's key is the line without white space at its ends and with A-Z in lower case. Of a key with at least ``least``
code points, only the smallest doc_id that holds it keeps its lines.

Keys are 128-bit hashes. Documents come in batches of ascending doc_id. Each batch is reduced to its distinct keys with
their smallest doc_id, merge-anti-joined with every run of the earlier batches, and what is new becomes a sorted run of
level 0; ``fan_out`` runs of a level are merged into one of the next. As a key's first batch holds its smallest doc_id,
the runs together are the owners of all keys. Lines whose owner is another document go. Only hashes are shuffled by key
(and reduced before), so a line that most documents share costs one row a task; texts are shuffled once, by document.

Null and empty texts are one empty line. Rows without a doc_id keep all their lines and own no key. Rows of one doc_id
count as one document, each row is judged by its own lines. Extra columns pass through; ``n_lines`` and ``n_dropped``
replace columns of these names. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, new_table, written

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line as it is compared. ``lower`` is right, and faster, for lines of ASCII alone."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class Runs:
    """Levels of sorted runs (h1, h2, owner), each a table in the shared folder."""

    def __init__(self, spark: SparkSession, fan_out: int):
        self.spark, self.fan_out = spark, fan_out
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _sorted(self, df: DataFrame) -> DataFrame:
        path = new_table(self.spark, "run")
        df.sortWithinPartitions(*_KEY).write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(path)

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, owner), each key once, none of them in a run."""
        self.levels[0].append(self._sorted(batch))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                merged = self._sorted(reduce(DataFrame.unionByName, level).repartition(*_KEY))
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)


def owners(lines: DataFrame, batches: int, fan_out: int) -> DataFrame:
    """(h1, h2, owner) of all keys of ``lines`` (batch, doc_id, h1, h2)."""
    runs = Runs(lines.sparkSession, fan_out)
    for k in range(batches):
        own = lines.where(F.col("batch") == k).groupBy(*_KEY).agg(F.min("doc_id").alias("owner"))
        for run in runs.all():
            own = own.join(run.hint("merge"), _KEY, "left_anti")
        runs.add(own)
    return reduce(DataFrame.unionByName, runs.all())


def line_dedup(docs: DataFrame, least: int = 10, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """``docs`` with dropped lines taken out of ``text``, and (n_lines, n_dropped)."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), doc.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    cuts = docs.agg(F.percentile_approx(doc, [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    lines = (
        rows.where(F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .select("doc_id", "text_key", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
        .select("doc_id", "text_key", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), reduce(Column.__add__, [(F.col("doc_id") > c).cast("int") for c in cuts], F.lit(0)).alias("batch"))
    )
    lines = written(lines, "lines", by="batch")
    drop = (
        lines.join(owners(lines, batches, fan_out).hint("merge"), _KEY).where(F.col("owner") < F.col("doc_id"))
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )
    whole = F.split("text", "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", F.get("edges", k) + 2, F.get("edges", k + 1) - F.get("edges", k) - 1)))
    out = (
        rows.join(drop, ["doc_id", "text_key"], "left").withColumn("lines", whole)
        .withColumn("edges", edges).withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    )
    extra = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return out.select(*extra, F.col("kept").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
f AS (SELECT k.doc_id, k.pos, k.line, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
