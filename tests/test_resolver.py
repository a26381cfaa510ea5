"""The resolver's ladder on texts with known companies."""

from tidemark.operators import resolver


def test_ladder(spark):
    texts = {
        1: "NVIDIA (NASDAQ: nvda) rose", 2: "an apple a day", 3: "Apple unveils", 4: "Delta fell", 5: "Delta Inc fell", 6: "Bank of North Star Bank Notes", 7: "United won", 8: "NVDA up on news",
        9: "NVDA UP ON NEWS TODAY ALL", 10: "$3M spent", 11: "3M spent", 12: "", 13: None, 14: "Big Blue and International Machines", 15: "nasdaq-nvda, Nvidia, NVDA", 16: "a b c d e f g h",
        17: "north star bank notes star bank notes",
    }
    names = [
        ("NVDA", "nvidia", False), ("APL", "apple", False), ("DLT", "delta", False), ("NSB", "north star bank", False), ("SBN", "star bank notes", False), ("U1", "united", False), ("U2", "united", False),
        ("MMM", "3m", False), ("IBM", "big blue", True), ("IBM", "international machines", False), ("LNG", "a b c d e f g h", False),
    ]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.symbol): (r.confidence, r.method) for r in resolver.resolved(docs, spark.createDataFrame(names, "symbol string, phrase string, alias boolean"), ["delta"], ["ALL"]).collect()}
    assert got == {
        (1, "NVDA"): (0.99, "explicit"), (3, "APL"): (0.92, "sole_name"), (5, "DLT"): (0.92, "sole_name"), (6, "NSB"): (0.97, "legal_name"), (8, "NVDA"): (0.9, "ticker"), (11, "MMM"): (0.92, "sole_name"),
        (14, "IBM"): (0.97, "legal_name"), (15, "NVDA"): (0.99, "explicit"), (16, "LNG"): (0.97, "legal_name"), (17, "NSB"): (0.97, "legal_name"), (17, "SBN"): (0.97, "legal_name"),
    }
    assert resolver.resolved(docs.limit(0), spark.createDataFrame(names, "symbol string, phrase string, alias boolean")).count() == 0


def test_texts_words_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "Acme Watch Group and Apple rose"), (2, "apple Inc, Apple")], "doc_id long, text string")
    names = spark.createDataFrame([("AWG", "acme watch group", False), ("APL", "apple", False)], "symbol string, phrase string, alias boolean")
    found = resolver.resolved(docs, names)
    assert {(r.doc_id, r.symbol, r.matched) for r in found.collect()} == {(1, "AWG", "acme watch group"), (1, "APL", "apple"), (2, "APL", "apple")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 4
