"""Connected components of link tables, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(v, c) for each end of ``links`` (a, b): the smallest vertex that links lead to. Labels spread along links and
    then jump to the label of their label, so that the rounds needed grow with the logarithm of the longest path."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    pairs = written(both.distinct(), "links")
    labels = written(pairs.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")), "labels")
    while True:
        heard = pairs.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        spread = labels.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("beyond"))
        after = written(spread.join(jump, "c").select("v", "old", F.least("c", "beyond").alias("c")), "labels")
        labels = after.select("v", "c")
        if not after.where("c <> old").limit(1).count():
            return labels
