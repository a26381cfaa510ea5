"""Words of documents that meet the terms of a search: none is lost, and the others are neither folded nor placed."""

from pyspark.sql import functions as F

from tidemark.operators import search


def test_forms_hold_every_word_of_a_term():
    words = [a + b for a in ("", "a", "bus", "pi", "box", "dish", "match", "class", "toy", "story", "stor", "this", "glas") for b in ("", "s", "es", "ies", "y", "ys", "ss", "ches", "xes")]
    for w in words:
        assert w in search.forms_of({search.stem_of(w)})


def test_index_of_some_terms_is_that_of_all(spark):
    texts = [(1, "Stories, story's BOXES", "the 401 (k) plan\nplans"), (2, "", None), (3, " - ", "boxes!story..stories Box İstanbul stories"), (4, "xs ies s", "das dishes story")]
    docs = spark.createDataFrame(texts, "doc_id long, title string, body string")
    only = {"story", "box", "401k", "plan", "s", "dish"}
    rows = lambda df: sorted(map(repr, df.select("term", "doc_id", "field", "positions").collect()))
    want = rows(search.index(docs, ["title", "body"]).where(F.col("term").isin(sorted(only))))
    assert len(want) > 8 and rows(search.index(docs, ["title", "body"], only)) == want
    assert {r.doc_id: r.words for r in search.lengths(docs, ["title", "body"]).collect()} == {1: 8, 2: 0, 3: 7, 4: 6}


def test_only_words_that_count_are_folded(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, title string, body string")
    some = search.index(docs, ["title", "body"], {"story"})._jdf.queryExecution().optimizedPlan().toString()
    assert "stories" in some  # words are chosen by their forms before they are folded
    assert "ies$" not in search.lengths(docs, ["title", "body"])._jdf.queryExecution().optimizedPlan().toString()
