"""Searches and questions against plain readings."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import search as se


def shape(text):
    return [[("-" if i.without else "") + " ".join(i.terms) for i in clause] for clause in se.parse_search(text)]


@pytest.mark.parametrize("text,want", [
    ("red wine", [["red", "wine"]]), ("red or wine", [["red"], ["wine"]]), ('"red wine" -white', [["red wine", "-white"]]), ('-"red wine" glass', [["-red wine", "glass"]]),
    ("a b or c -d", [["a", "b"], ["c", "-d"]]), ("or or red or", [["red"]]), ('"left open end', [["left open end"]]), ("- ! \" \"", []), ("", []), ("well-known -un-known", [["well known", "-un known"]]),
    ("OR", []), ("Ships 401(k) Parties", [["ship", "401k", "party"]]), ('x"y z"w', [["x", "y z", "w"]]), ("--double", [["-double"]]), ("cafés", [["café"]]),
])
def test_grammar(text, want):
    assert shape(text) == want


def test_searches_are_bounded():
    assert sum(len(i.terms) for c in se.parse_search("word " * 500 + '"' + "a b " * 300) for i in c) == se.MOST_WORDS
    assert [c[0].terms for c in se.any_of("What is the market for solar panels and SOLAR cells, in 2026?")] == [["solar"], ["panel"], ["cell"], ["2026"]]
    assert len(se.any_of(" ".join(f"word{k}" for k in range(40)))) == 12


def test_words_on_both_sides_are_alike(spark):
    texts = ["Analyses of 401 ( K ) plans; 10-K's", "cafés ÜBUNGEN buses gas's", "", "a_b c.d 3.5%", "中文 ٠١ x²"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", se.terms_of(F.col("t")).alias("w")).orderBy("k").collect()
    assert [r.w for r in rows] == [se.words_of(t) for t in texts]
    words = ["companies", "losses", "ties", "boxes", "glass", "focus", "basis", "as", "és", "matches"]
    assert [r.s for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k long, w string").select("k", tx.stem(F.col("w")).alias("s")).orderBy("k").collect()] == [se.stem_of(w) for w in words]


def test_random_searches(spark):
    rnd = random.Random(4)
    vocabulary = ["aa", "bb", "cc", "dd", "ee"]
    docs = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randrange(3))), " ".join(rnd.choices(vocabulary, k=rnd.randrange(9)))) for k in range(80)] + [(90, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, title string, body string")

    def one():
        return rnd.choice(["", "-"]) + (rnd.choice(vocabulary) if rnd.random() < 0.6 else '"' + " ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 4))) + '"')

    texts = {f"s{k}": " or ".join(" ".join(one() for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 3))) for k in range(25)}
    got = {(r.search, r.doc_id) for r in se.found(se.index(df, se.FIELDS), se.lengths(df, se.FIELDS), {k: se.parse_search(t) for k, t in texts.items()}).collect()}

    def holds(item, fields):
        n = len(item.terms)
        there = any(f[k : k + n] == item.terms for f in fields for k in range(len(f)))
        return there != item.without

    want = {(name, d) for name, t in texts.items() for d, a, b in docs if any(all(holds(i, [(a or "").split(), (b or "").split()]) for i in c) for c in se.parse_search(t))}
    assert got == want and want


def test_stored_index_gives_the_same(spark, sf_dir, tmp_path):
    from tidemark.operators.text_events import headlines

    docs = headlines(spark, sf_dir)
    found = se.stored(se.index(docs, se.FIELDS), str(tmp_path / "index"))
    searches = {k: se.parse_search(v) for k, v in se.SEARCHES.items()}
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(se.found(se.index(docs, se.FIELDS), se.lengths(docs, se.FIELDS), searches))
    assert key(se.found(found, se.lengths(docs, se.FIELDS), searches)) == want
    terms = {t for search in searches.values() for clause in search for i in clause for t in i.terms}
    assert key(se.found(se.index(docs, se.FIELDS, terms), se.lengths(docs, se.FIELDS), searches)) == want


def test_profiles():
    p = se.profile("best strategies for early career 401(k)")
    assert p.weights == {"best": 0.25, "strategy": 0.25, "early": 1, "career": 1, "401k": 3} and p.key == 5 and not p.loose
    p = se.profile("Is NVDA cheaper than Caterpillar was in 2024? $T")
    assert {t: w for t, w in p.weights.items() if w == 3} == {"nvda": 3, "caterpillar": 3, "2024": 3}
    assert se.profile("best stocks to buy now").loose


def test_evidence_of_subjects_and_without_any_relevant(spark):
    docs = spark.createDataFrame([(1, "solar cells", "solar solar panels"), (2, "wind", "panel"), (3, "none", "at all"), (4, "Solar", "")], "doc_id long, title string, body string")
    sources = spark.createDataFrame([(k, 75, 7) for k in (1, 2, 3, 4)], "doc_id long, trust int, age int")
    subjects = spark.createDataFrame([("q", 3)], "question string, doc_id long")
    got = {r.doc_id: tuple(r[2:]) for r in se.evidence(se.index(docs, se.FIELDS), sources, {"q": "solar panels cells"}, subjects).collect()}
    assert got == {1: (4 + 3 + 1, True, 83.5), 2: (1, False, 1.35), 3: (12, True, 123.5), 4: (3, False, 3.35)}
    only = {r.doc_id: tuple(r[2:]) for r in se.evidence(se.index(docs, se.FIELDS), sources, {"q": "wind turbines blades towers"}).collect()}
    assert only == {2: (3, False, 33.5)}
    ranked = spark.createDataFrame([("q", k, 100.0 - k) for k in range(12)] + [("q", 50, 9.0)], "question string, doc_id long, relevance double")
    hosts = spark.createDataFrame([(k, "a" if k < 8 else "b", 100 if k >= 8 else 50, k != 1) for k in range(12)] + [(50, "c", 50, True)], "doc_id long, host string, trust int, has_body boolean")
    assert [r.doc_id for r in se.picked(ranked, hosts, limit=6).orderBy("pick").collect()] == [0, 2, 3, 8, 9, 10]
    assert [tuple(r) for r in se.mentioned(ranked, hosts.select("doc_id", F.col("host").alias("symbol"))).orderBy("symbol").collect()] == [("q", "a", 8), ("q", "b", 4)]
