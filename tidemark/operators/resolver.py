"""Which companies a text names (T14): a ladder of evidence, the most certain first.

Phrases meet the dictionary in an equi-join; what a document consumes is decided inside short stretches of overlapping
phrases, so no step holds a document's matches in one growing array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.text_events import headlines
from tidemark.registry import query

# Exchanges, legal forms, the longest phrase and the confidence of each kind of evidence.
EXCHANGES = ["NASDAQ", "NYSE", "NYSEAMERICAN", "NYSEARCA", "AMEX", "OTC", "CBOE"]
LEGAL_FORMS = ["inc", "corp", "corporation", "incorporated", "ltd", "plc"]
LONGEST = 8
CONFIDENCE = {"explicit": 0.99, "legal_name": 0.97, "alias": 0.95, "sole_name": 0.92, "ticker": 0.9}

_QUALIFIED = r"(?i)\b(?:" + "|".join(EXCHANGES) + r")\s*[:\-]\s*([A-Z0-9.\-]{1,6})\b"
_OTHER = r"[^\p{L}\p{Nd}]+"
_RUN = r"[\p{L}\p{N}_$]+"
_SYMBOL = r"[\p{L}\p{N}_.\-]+"
# Runs of _RUN that don't begin with a small letter or $, and of _SYMBOL that may be tickers.
_CAPITAL = r"(?<![\p{L}\p{N}_$])[\p{L}\p{N}_&&[^a-z]][\p{L}\p{N}_$]*"
_BARE = r"(?<![\p{L}\p{N}_.\-])[A-Z0-9.\-]{3,6}(?![\p{L}\p{N}_.\-])"


def shouting(text: Column) -> Column:
    """At least 12 letters, of which two thirds are capitals."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (letters >= 12) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 3 >= letters * 2)


def _longest_first(runs: DataFrame) -> DataFrame:
    """From left to right, the longest run at each place; a run consumes its words."""
    at = Window.partitionBy("doc_id", "pos").orderBy(F.desc("len"))
    nodes = runs.withColumn("nth", F.row_number().over(at)).where("nth = 1").drop("nth")
    before = Window.partitionBy("doc_id").orderBy("pos")
    end = F.max(F.col("pos") + F.col("len")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    nodes = nodes.withColumn("opens", F.coalesce(F.col("pos") >= end, F.lit(True)).cast("int")).withColumn("stretch", F.sum("opens").over(before))
    one = F.struct("pos", "len", "symbol", "phrase", "alias")
    stretches = nodes.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list(one)).alias("all"))  # as long as phrases chain
    start = F.struct(F.lit(-1).alias("until"), F.slice("all", 1, 0).alias("kept"))
    step = lambda s, r: F.when(r["pos"] >= s["until"], F.struct((r["pos"] + r["len"]).alias("until"), F.concat(s["kept"], F.array(r)).alias("kept"))).otherwise(s)
    return stretches.select("doc_id", F.inline(F.aggregate("all", start, step, lambda s: s["kept"])))


def resolved(docs: DataFrame, names: DataFrame, common: list[str] = (), blocked: list[str] = (), longest: int = LONGEST) -> DataFrame:
    """(doc_id, symbol, confidence, method, matched), a row for each company that a document names, by its best evidence.

    ``docs``: doc_id, text; ``names``: symbol, phrase (lower-case words), alias. A phrase of two symbols names none. A single
    word counts only where the text has it with a capital or a digit in front, not as an amount, not if ``blocked``, and as
    one of the ``common`` words only if it is an alias or a legal form follows. Null and empty texts name nothing.
    """
    d = docs.where("text IS NOT NULL").select("doc_id", "text", F.regexp_replace("text", _QUALIFIED, " ").alias("x"))
    symbols = F.broadcast(names.select("symbol").distinct())  # the dictionary goes to the texts, never their words to it
    explicit = d.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_QUALIFIED), F.lit(1)), F.upper))).alias("symbol"))
    explicit = explicit.join(symbols, "symbol").select("doc_id", "symbol", F.lit("explicit").alias("method"), F.col("symbol").alias("matched"))

    phrases = names.groupBy("phrase").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("other"), F.max("alias").alias("alias")).where("symbol = other").drop("other")
    phrases = F.broadcast(phrases)
    # A row for each word with those that follow; only where a phrase begins are its runs put together.
    w = d.select("doc_id", F.split(F.trim(F.regexp_replace(F.lower("x"), _OTHER, " ")), " ").alias("w"))
    after = [F.slice("w", k, F.greatest(F.size("w") - (k - 1), F.lit(0))).alias(f"w{k}") for k in range(2, max(longest, 2) + 1)]
    at = w.select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("w1"), *after)).alias("pos", "r")).select("doc_id", (F.col("pos") + 1).alias("pos"), "r.*")
    heads = phrases.groupBy(F.substring_index("phrase", " ", 1).alias("w1")).agg(F.max(F.size(F.split("phrase", " "))).alias("most"))
    one = lambda k: F.struct(F.lit(k).alias("len"), F.concat_ws(" ", *[f"w{i}" for i in range(1, k + 1)]).alias("phrase"))
    runs = F.array_compact(F.array(*[F.when((F.col("most") >= k) & F.col(f"w{k}").isNotNull(), one(k)) for k in range(1, longest + 1)]))
    form = F.coalesce(F.col("w2").isin(*LEGAL_FORMS), F.lit(False)).alias("form")
    runs = at.join(F.broadcast(heads), "w1").select("doc_id", "pos", form, F.inline(runs)).join(phrases, "phrase")
    capital = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("x", F.lit(_CAPITAL), F.lit(0)))).alias("phrase")).select("doc_id", F.lower("phrase").alias("phrase")).join(phrases, "phrase", "left_semi")
    sound = ~F.upper("phrase").isin(*blocked) & (~F.col("phrase").isin(*common) | F.col("alias") | F.col("form"))
    runs = runs.where("len > 1").unionByName(runs.where((F.col("len") == 1) & sound).join(capital, ["doc_id", "phrase"], "left_semi"))
    method = F.when(F.col("alias"), "alias").when(F.col("len") == 1, "sole_name").otherwise("legal_name")
    named = _longest_first(runs).select("doc_id", "symbol", method.alias("method"), F.col("phrase").alias("matched"))

    bare = F.filter(F.array_distinct(F.regexp_extract_all("x", F.lit(_BARE), F.lit(0))), lambda v: ~v.isin(*blocked) & ~v.isin(*EXCHANGES))
    tickers = d.select("doc_id", "x", bare.alias("bare")).where((F.size("bare") > 0) & ~shouting(F.col("x"))).select("doc_id", F.explode("bare").alias("symbol")).join(symbols, "symbol")
    tickers = tickers.select("doc_id", "symbol", F.lit("ticker").alias("method"), F.col("symbol").alias("matched"))

    confidence = F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])
    found = explicit.unionByName(named).unionByName(tickers).withColumn("confidence", confidence[F.col("method")])
    best = found.groupBy("doc_id", "symbol").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "matched", "method", "confidence")).alias("b"))
    return best.select("doc_id", "symbol", "b.confidence", "b.method", "b.matched")


_ADDED = [
    " Shares of Acme Holdings (NYSE: ACM) rose, said acme holdings.",
    " Delta fell. APX would follow, as would Acme.",
    " an apple a day; Apple Watch Group sells north star bank notes to Delta Inc.",
    " OTC-ZZZ and $3M for United; Apple and 3M too.",
]
_NAMES = [
    ("ACM", "acme holdings", False), ("ACM", "acme", True), ("DLT", "delta", False), ("APL", "apple", False), ("AWG", "apple watch group", False), ("NSB", "north star bank", False),
    ("SBN", "star bank notes", False), ("UNA", "united", False), ("UNB", "united", False), ("APX", "apex", True), ("MMM", "3m", False), ("THE", "of the", False),
]
_COMMON, _BLOCKED = ["delta", "star", "the"], ["ALL", "THE"]
_SQL_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text || {_SQL_LIST(_ADDED)}[1 + doc_id % 4] AS text FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, text, regexp_replace(text, '{_QUALIFIED}', ' ', 'g') AS x FROM d),
names(symbol, phrase, alias) AS (VALUES {", ".join(f"('{s}', '{p}', {str(a).lower()})" for s, p, a in _NAMES)}), one AS (SELECT phrase, min(symbol) AS symbol, bool_or(alias) AS alias FROM names GROUP BY phrase HAVING count(DISTINCT symbol) = 1),
explicit AS (SELECT DISTINCT doc_id, upper(symbol) AS symbol FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_QUALIFIED}', 1)) AS symbol FROM x)),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(x), '{_OTHER}', ' ', 'g')), ' ') AS w FROM x), caps AS (SELECT DISTINCT doc_id, lower(v) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(x, '{_RUN}')) AS v FROM x) WHERE NOT regexp_matches(v, '^[a-z$]')),
p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM w), l AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, b, 1 AS len, a AS phrase FROM l UNION ALL SELECT doc_id, pos, b, 2, a || ' ' || b FROM l UNION ALL SELECT doc_id, pos, b, 3, a || ' ' || b || ' ' || c FROM l),
r AS (SELECT g.doc_id, pos, len, symbol, alias, g.phrase FROM g JOIN one USING (phrase) LEFT JOIN caps ON caps.doc_id = g.doc_id AND caps.v = g.phrase
WHERE len > 1 OR (caps.v IS NOT NULL AND NOT list_contains({_SQL_LIST(_BLOCKED)}, upper(g.phrase)) AND (NOT list_contains({_SQL_LIST(_COMMON)}, g.phrase) OR alias OR coalesce(list_contains({_SQL_LIST(LEGAL_FORMS)}, b), false)))),
n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY len DESC) = 1), nx AS (SELECT a.doc_id, a.pos, min(b.pos) AS nxt FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.pos >= a.pos + a.len GROUP BY 1, 2),
walk AS (SELECT doc_id, min(pos) AS pos FROM n GROUP BY 1 UNION ALL SELECT walk.doc_id, nx.nxt FROM walk JOIN nx ON nx.doc_id = walk.doc_id AND nx.pos = walk.pos),
named AS (SELECT n.* FROM n JOIN walk USING (doc_id, pos)),
calm AS (SELECT * FROM x WHERE NOT (length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 12 AND length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) * 3 >= length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) * 2)),
bare AS (SELECT DISTINCT doc_id, s AS symbol FROM (SELECT doc_id, unnest(regexp_extract_all(x, '{_SYMBOL}')) AS s FROM calm) WHERE regexp_matches(s, '^[A-Z0-9.\\-]{{3,6}}$') AND NOT list_contains({_SQL_LIST(_BLOCKED + EXCHANGES)}, s)),
f AS (SELECT doc_id, symbol, 0.99::DOUBLE AS confidence, 'explicit' AS method, symbol AS matched FROM explicit WHERE symbol IN (SELECT symbol FROM names)
UNION ALL SELECT doc_id, symbol, CASE WHEN alias THEN 0.95 WHEN len = 1 THEN 0.92 ELSE 0.97 END, CASE WHEN alias THEN 'alias' WHEN len = 1 THEN 'sole_name' ELSE 'legal_name' END, phrase FROM named
UNION ALL SELECT doc_id, symbol, 0.9, 'ticker', symbol FROM bare WHERE symbol IN (SELECT symbol FROM names))
SELECT doc_id, symbol, confidence, method, matched FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, symbol ORDER BY confidence DESC, matched) = 1""")
def t14_resolver_ladder(spark, sf_dir):
    """Whole texts, with a sentence of names behind each, as the table names no companies."""
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (1 + F.col("doc_id") % 4).cast("int"))
    docs = headlines(spark, sf_dir).select("doc_id", F.concat("body", added).alias("text"))
    longest = max(len(p.split()) for _, p, _ in _NAMES)  # no run of more words can meet the dictionary
    return resolved(docs, spark.createDataFrame(_NAMES, "symbol string, phrase string, alias boolean"), _COMMON, _BLOCKED, longest)
