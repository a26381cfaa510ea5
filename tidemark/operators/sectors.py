"""Sectors that texts bear on: many phrases found in one pass.

A table of phrases becomes a trie, and the trie one regular expression: at each place of a text it follows the letters down
and takes the longest phrase there, so the work per place is bounded by the longest phrase, not by the number of phrases.
Phrases that begin a longer one found at the same place are added from a table of beginnings. All of it stays a column
expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.text_events import _HEAD, headlines
from tidemark.registry import query, table

_FIN, _EST, _IND, _MAT, _DIS, _STA = "US: Financials", "US: Real Estate", "US: Industrials", "US: Materials", "US: Consumer Discretionary", "US: Consumer Staples"
_ENE, _UTI, _HEA, _TEC, _COM = "US: Energy", "US: Utilities", "US: Health Care", "US: Information Technology", "US: Communication Services"
#: Phrases of headlines and the sectors that they reach.
KEYWORDS = {
    "federal reserve": [_FIN], "fomc": [_FIN], "interest rate": [_FIN, _EST], "fed funds rate": [_FIN], "quantitative easing": [_FIN], "bank capital": [_FIN], "stress test": [_FIN], "basel": [_FIN],
    "insurance": [_FIN], "derivatives": [_FIN], "tariff": [_IND, _MAT, _DIS], "import duty": [_MAT, _IND], "anti-dumping": [_MAT, _IND], "section 301": [_IND, _MAT], "section 232": [_MAT, _IND],
    "export control": [_TEC, _IND], "entity list": [_TEC, _IND], "sanctions": [_ENE, _FIN], "crude oil": [_ENE], "brent": [_ENE], "opec": [_ENE], "gasoline": [_ENE], "natural gas": [_ENE, _UTI],
    "strategic petroleum reserve": [_ENE], "coal": [_ENE, _UTI], "renewable": [_UTI, _IND], "solar": [_UTI, _IND], "electricity": [_UTI], "grid": [_UTI], "steel": [_MAT], "iron ore": [_MAT],
    "aluminum": [_MAT], "aluminium": [_MAT], "copper": [_MAT], "mining": [_MAT], "fertilizer": [_MAT], "fda": [_HEA], "drug pricing": [_HEA], "pharmaceutical": [_HEA], "medicare": [_HEA],
    "clinical trial": [_HEA], "antitrust": [_TEC, _COM], "fcc": [_COM], "spectrum": [_COM], "telecom": [_COM], "semiconductor": [_TEC], "artificial intelligence": [_TEC], "data privacy": [_TEC, _COM],
    "h-1b": [_TEC], "faa": [_IND], "defense department": [_IND], "pentagon": [_IND], "infrastructure": [_IND, _MAT], "railroad": [_IND], "automaker": [_DIS], "emission standard": [_DIS, _IND],
    "mortgage rate": [_EST, _FIN], "housing starts": [_EST, _IND], "real estate": [_EST], "sec rule": [_FIN], "sec enforcement": [_FIN], "ipo": [_FIN], "buyback": [_FIN],
}
#: Agencies and the sectors that their publications reach, whatever the words.
AGENCIES = {
    "Office of the United States Trade Representative": [_IND, _MAT, _DIS], "International Trade Administration": [_IND, _MAT], "Federal Reserve System": [_FIN], "Securities and Exchange Commission": [_FIN],
    "Commodity Futures Trading Commission": [_FIN], "Federal Deposit Insurance Corporation": [_FIN], "Comptroller of the Currency": [_FIN], "Federal Communications Commission": [_COM],
    "Federal Aviation Administration": [_IND], "Federal Energy Regulatory Commission": [_UTI, _ENE], "Energy Department": [_ENE, _UTI], "Environmental Protection Agency": [_MAT, _IND, _UTI],
    "Food and Drug Administration": [_HEA], "Centers for Medicare & Medicaid Services": [_HEA], "Homeland Security Department": [_IND, _TEC], "Treasury Department": [_FIN], "Federal Trade Commission": [_TEC, _COM],
    "National Highway Traffic Safety Administration": [_DIS, _IND], "Federal Housing Finance Agency": [_EST], "Agriculture Department": [_STA, _MAT], "Interior Department": [_ENE, _MAT], "Labor Department": [_IND],
}
#: Words by which people name a sector in a question.
SECTOR_WORDS = {
    "Financials": ["bank", "banks", "banking", "lender", "lenders", "insurer", "insurers", "insurance", "brokerage", "asset manager", "asset managers"],
    "Information Technology": ["software", "semiconductor", "semiconductors", "chipmaker", "chipmakers", "chip stocks", "tech stocks", "cloud"],
    "Health Care": ["pharma", "pharmaceutical", "pharmaceuticals", "biotech", "drugmaker", "drugmakers", "healthcare", "health care", "hospital", "hospitals", "medical device", "medical devices"],
    "Energy": ["oil", "gas", "energy", "refiner", "refiners", "drillers", "shale"],
    "Utilities": ["utility", "utilities", "electricity"],
    "Consumer Discretionary": ["retailer", "retailers", "automaker", "automakers", "restaurant", "restaurants", "homebuilder", "homebuilders", "apparel", "hotels", "cruise", "cruise lines"],
    "Consumer Staples": ["food", "beverage", "beverages", "grocer", "grocers", "tobacco", "consumer staples"],
    "Communication Services": ["telecom", "telecoms", "media", "streaming", "advertising", "wireless carriers"],
    "Real Estate": ["reit", "reits", "real estate"],
    "Materials": ["steel", "metals", "mining", "miners", "chemical", "chemicals", "copper", "gold miners", "fertilizer"],
    "Industrials": ["defense", "defence", "aerospace", "airline", "airlines", "railroad", "railroads", "trucking", "machinery", "industrials", "construction"],
}
_SECTOR_OF = {w: s for s, words in SECTOR_WORDS.items() for w in words}


def trie_pattern(phrases: list[str]) -> str:
    """A regular expression for the longest of the phrases at a place, without alternatives that begin alike."""
    root: dict = {}
    for p in phrases:
        node = root
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        arms = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        if not arms:
            return ""
        if "" in node:
            return "(?:" + "|".join(arms) + ")?"
        return arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"

    return written(root)


def phrases_in(text: Column, phrases: list[str], words_only: bool = False) -> Column:
    """The distinct phrases of a list that a text holds, in lower case and without order. With ``words_only`` letters and
    digits must not stand beside them."""
    pattern = trie_pattern(phrases)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{Nd}}])(?=({pattern})(?![\p{{L}}\p{{Nd}}]))" if words_only else f"(?=({pattern}))"), F.lit(1))
    inside = {p: [q for q in phrases if q != p and p.startswith(q) and (not words_only or not p[len(q)].isalnum())] for p in phrases}
    inside = {p: q for p, q in inside.items() if q}
    if inside:
        more = F.create_map(*[x for p, q in inside.items() for x in (F.lit(p), F.array(*map(F.lit, q)))])
        found = F.concat(found, F.flatten(F.transform(found, lambda p: F.coalesce(F.try_element_at(more, p), F.array().cast("array<string>")))))
    return F.array_distinct(found)


def _mapping(of: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def inferred_sectors(text: Column, agency: Column | None = None, most: int = 4) -> Column:
    """Sorted sectors: those of a known agency; else those of the phrases in the text, longer phrases first, ``most`` at most."""
    ordered = F.transform(F.array_sort(F.transform(phrases_in(text, list(KEYWORDS)), lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])
    of = _mapping(KEYWORDS)
    sectors = F.array_sort(F.slice(F.array_distinct(F.flatten(F.transform(ordered, lambda p: F.element_at(of, p)))), 1, most))
    return sectors if agency is None else F.coalesce(F.array_sort(F.try_element_at(_mapping(AGENCIES), F.trim(agency))), sectors)


def sectors_named(text: Column, most: int = 2) -> Column:
    """The first ``most`` sectors, by name, that a question's words name."""
    of = F.create_map(*[F.lit(x) for kv in _SECTOR_OF.items() for x in kv])
    return F.slice(F.array_sort(F.array_distinct(F.transform(phrases_in(text, list(_SECTOR_OF), True), lambda p: F.element_at(of, p)))), 1, most)


# Queries: documents hold none of the phrases, so some are put behind a part of them, in SQL alike.

_KEYS, _WORDS, _NAMES = list(KEYWORDS), list(_SECTOR_OF), [*AGENCIES, "Unknown Bureau", "", " Labor Department "]


def _behind(column: Column, values: list[str], step: int) -> Column:
    k = F.col("doc_id")
    pick = lambda x: F.get(F.array(*map(F.lit, values)), F.pmod(x, F.lit(len(values))).cast("int"))
    return F.concat(column, F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper(pick(k)), F.lit(", "), pick(k * step), F.lit("s x"), pick(k + 1))).otherwise(""))


def _behind_sql(column: str, values: list[str], step: int) -> str:
    pick = lambda x: f"{values!r}[1 + ({x}) % {len(values)}]"
    return f"{column} || CASE WHEN doc_id % 3 = 0 THEN ' ' || upper({pick('doc_id')}) || ', ' || {pick(f'doc_id * {step}')} || 's x' || {pick('doc_id + 1')} ELSE '' END"


_SORTED = sorted(KEYWORDS, key=lambda k: (-len(k), k))
_KEY_ROWS = ", ".join(f"('{k}', {n * 10 + j}, '{s}')" for n, k in enumerate(_SORTED) for j, s in enumerate(KEYWORDS[k]))
_AGENCY_ROWS = ", ".join(f"('{k}', {sorted(v)!r})" for k, v in AGENCIES.items())
_WORD_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in _SECTOR_OF.items())


@query(f"""WITH {_HEAD}, x AS (SELECT doc_id, lower({_behind_sql('body', _KEYS, 7)}) AS x, CASE WHEN doc_id % 5 = 0 THEN {_NAMES!r}[1 + doc_id % {len(_NAMES)}] END AS agency FROM h),
k(phrase, place, sector) AS (VALUES {_KEY_ROWS}), a(agency, sectors) AS (VALUES {_AGENCY_ROWS}), m AS (SELECT doc_id, sector, min(place) AS place FROM x JOIN k ON contains(x.x, phrase) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM m), s AS (SELECT doc_id, list_sort(list(sector)) AS sectors FROM r WHERE nth <= 4 GROUP BY 1)
SELECT x.doc_id, coalesce(a.sectors, s.sectors, []) AS sectors FROM x LEFT JOIN a ON a.agency = trim(x.agency) LEFT JOIN s ON s.doc_id = x.doc_id""")
def t11_inferred_sectors(spark, sf_dir):
    """Whole documents; every fifth was published by an agency, some of them unknown."""
    agency = F.when(F.col("doc_id") % 5 == 0, F.get(F.array(*map(F.lit, _NAMES)), F.pmod(F.col("doc_id"), F.lit(len(_NAMES))).cast("int")))
    return headlines(spark, sf_dir).select("doc_id", inferred_sectors(_behind(F.col("body"), _KEYS, 7), agency).alias("sectors"))


@query(f"""WITH {_HEAD}, x AS (SELECT doc_id, lower({_behind_sql('body', _WORDS, 11)}) AS x FROM h), k(phrase, sector) AS (VALUES {_WORD_ROWS}),
m AS (SELECT DISTINCT doc_id, sector FROM x JOIN k ON contains(x.x, phrase) WHERE regexp_matches(x.x, '(^|[^\\p{{L}}\\p{{Nd}}])' || phrase || '($|[^\\p{{L}}\\p{{Nd}}])'))
SELECT x.doc_id, coalesce(list_slice(list_sort(list(sector) FILTER (sector IS NOT NULL)), 1, 2), []) AS sectors FROM x LEFT JOIN m USING (doc_id) GROUP BY 1""")
def t30_sectors_named(spark, sf_dir):
    return headlines(spark, sf_dir).select("doc_id", sectors_named(_behind(F.col("body"), _WORDS, 11)).alias("sectors"))


def symbols_in_sector(members: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """(question, sector, symbol, place): the ``most`` largest members of the sectors that each question names. ``members``:
    (symbol, sector, size)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("size"), "symbol"))
    top = members.withColumn("place", nth).where(F.col("place") <= most)
    return questions.select("question", F.explode(sectors_named(F.col("text"))).alias("sector")).join(top, "sector").select("question", "sector", "symbol", "place")


@query(f"""WITH m AS (SELECT c_custkey AS symbol, {list(SECTOR_WORDS)!r}[1 + c_nationkey % 11] AS sector, c_acctbal AS size FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY size DESC, symbol) AS place FROM m),
q AS (SELECT item_id AS question, lower('Which ' || {_WORDS!r}[1 + item_id % {len(_WORDS)}] || ' or ' || {_WORDS!r}[1 + (item_id * 13) % {len(_WORDS)}] || ' are cheap?') AS x FROM benchmark), k(phrase, sector) AS (VALUES {_WORD_ROWS}),
s AS (SELECT DISTINCT question, sector FROM q JOIN k ON regexp_matches(q.x, '(^|[^a-z0-9])' || phrase || '($|[^a-z0-9])')), n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sector) AS nth FROM s)
SELECT question, sector, symbol, place FROM n JOIN r USING (sector) WHERE nth <= 2 AND place <= 10""")
def t30_sector_members(spark, sf_dir):
    """The ten largest members of each sector that a question names."""
    pick = lambda x: F.get(F.array(*map(F.lit, _WORDS)), (x % len(_WORDS)).cast("int"))
    k = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select(k.alias("question"), F.concat(F.lit("Which "), pick(k), F.lit(" or "), pick(k * 13), F.lit(" are cheap?")).alias("text"))
    sector = F.get(F.array(*map(F.lit, SECTOR_WORDS)), (F.col("c_nationkey") % 11).cast("int"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), sector.alias("sector"), F.col("c_acctbal").alias("size"))
    return symbols_in_sector(members, q, 10).withColumn("place", F.col("place").cast("long"))
