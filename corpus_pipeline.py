"""The corpus pipeline: language identification, line dedup, near-duplicate removal and packing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, near_dedup, packing
from tidemark.llm.shared import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that could be learned stay: rejected are ``und``, and texts that share next to nothing with
    the nearest profile (``fit`` under 0.02)."""
    found = language_id.identified(docs, language_id.learn(docs))
    return found.where((F.col("language.lang_pred") != "und") & (F.col("language.fit") >= 0.02)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    return line_dedup.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the rows of the smallest doc_id stay. Rows of one doc_id with one text are one
    row, that of the least other columns; with other texts each stays, as do all rows without a doc_id."""
    first = near_dedup.classes(docs).where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    same = [F.col("doc_id"), F.col("text").isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]
    row = F.struct("lang", "source", "n_chars", "text")
    kept = docs.join(first, "doc_id", "left_semi").groupBy(*same).agg(F.min(row).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", "lang", "source", "n_chars", "text")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizers, profiles and signatures have no SQL: tests/llm/test_pipeline.py holds the stages and run() against plain versions.
ORACLE_SQL = None
