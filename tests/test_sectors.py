"""Phrases found in one pass against a plain search for each."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import sectors as se


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_the_pattern_takes_the_longest():
    p = re.compile(se.trie_pattern(["ab", "abc", "abcd x", "b", "a.c"]))
    assert [p.match(t).group() for t in ("abz", "abcz", "abcd x", "abcd y", "a.c", "b")] == ["ab", "abc", "abcd x", "abc", "a.c", "b"]
    assert p.match("axc") is None


def test_phrases_equal_plain_search(spark):
    rnd = random.Random(5)
    phrases = ["a", "ab", "abc", "b a", "ca", "cab", "c-a", "aa"]
    texts = ["".join(rnd.choice("aabc -") for _ in range(rnd.randrange(12))) for _ in range(300)] + ["", "ABC", "é a", "aé"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", se.phrases_in(F.col("t"), phrases).alias("any"), se.phrases_in(F.col("t"), phrases, True).alias("words"))
    for r in df.collect():
        t = r.t.lower()
        assert set(r["any"]) == {p for p in phrases if p in t}
        assert set(r.words) == {p for p in phrases if re.search(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", t)}
        assert len(r["any"]) == len(set(r["any"]))


def test_sectors(spark):
    text = "Tariffs on STEEL, semiconductors and natural gas; the FDA and real estate"
    got = one(spark, se.inferred_sectors(F.lit(text)))
    # Longest first: semiconductor, natural gas, real estate fill the four.
    assert got == ["US: Energy", "US: Information Technology", "US: Real Estate", "US: Utilities"]
    assert one(spark, se.inferred_sectors(F.lit(text), F.lit(" Labor Department "))) == ["US: Industrials"]
    assert one(spark, se.inferred_sectors(F.lit("none"), F.lit("Unknown"))) == []
    assert one(spark, se.sectors_named(F.lit("Are cruise lines, banks or oilfields better?"))) == ["Consumer Discretionary", "Financials"]
    assert one(spark, se.sectors_named(F.lit("embankment foods"))) == []
