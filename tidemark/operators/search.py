"""Full-text search and evidence for questions over a positional index.

The index is a table with a row for each term, document and field: the positions of the term. Terms are words of letters
and digits, in lower case, plurals folded. Searches and questions are compiled on the driver to a few rows of terms, which
meet the index in a broadcast join (``MOST_WORDS`` bounds them); what they hit is brought together by document once, and
phrases, clauses, weights and ranks follow without another exchange. A frequent term is spread over its documents.

A search reads as typed: words must all be there, ``or`` parts alternatives, ``-`` excludes a word or phrase, quotes make a
phrase. Nothing is an error: a quote left open ends with the text, lone marks and empty alternatives go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.indicators import r6
from tidemark.operators.text_events import _HEAD, headlines
from tidemark.registry import query

#: Words of a search or question beyond which the rest is left out, so that compiled rows can be broadcast.
MOST_WORDS = 64
#: Words that carry no meaning in a search of any-word kind.
SEARCH_STOP = [
    "which", "what", "who", "when", "where", "why", "how", "is", "are", "was", "were", "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "by", "with", "about", "from", "at", "as",
    "that", "this", "it", "its", "do", "does", "did", "has", "have", "had", "can", "could", "any", "all", "there", "their", "them", "companies", "company", "stock", "stocks", "share", "shares", "market",
]
#: Words that only hold a question together.
QUESTION_STOP = (
    "a an the and or of in on at to for from by with is are was were be been what which who when where how why does do did has have had can could would should this that these those it its their "
    "about please explain research tell me latest recent today company companies news my i we our you your"
).split()
#: Words that nearly every text on money has.
GENERIC = (
    "best top good great new old strategy tip guide way thing need know vs versus right make more most much many share stock market price invest investing investor buy sell doing going happen "
    "happening now year quarter week month day time ever"
).split()


# The index


def words_in(text: Column) -> Column:
    """The words of a text in order, in lower case."""
    return F.array_remove(F.split(F.lower(tx.joined_plans(text)), r"[^\p{L}\p{Nd}]+"), "")


def terms_of(text: Column) -> Column:
    """The terms of a text in order."""
    return F.transform(words_in(text), tx.stem)


def forms_of(terms: set[str]) -> list[str]:
    """All words that ``text.stem`` may turn into one of some terms, so that other words needn't be folded."""
    return sorted({w for t in terms for w in (t, t + "s", t + "es", *([t[:-1] + "ies"] if t.endswith("y") else []))})


def index(docs: DataFrame, fields: list[str], only: set[str] | None = None) -> DataFrame:
    """(term, doc_id, field, positions): positions count from 0 in each field. ``only``: the rows of these terms, which is all
    that searches of documents without a stored index need; the other words stay where they are read."""
    if only is None:
        each = [F.struct(F.lit(c).alias("field"), terms_of(F.coalesce(F.col(c), F.lit(""))).alias("w")) for c in fields]
        words = docs.select("doc_id", F.inline(F.array(*each))).select("doc_id", "field", F.posexplode("w").alias("pos", "term"))
    else:
        forms = forms_of(only)
        each = [F.struct(F.lit(c).alias("field"), words_in(F.coalesce(F.col(c), F.lit(""))).alias("w")) for c in fields]
        placed = F.transform("w", lambda w, k: F.when(w.isin(forms), F.struct(k.alias("pos"), w.alias("word"))))
        words = docs.select("doc_id", F.inline(F.array(*each))).select("doc_id", "field", F.inline(F.array_compact(placed)))
        words = words.select("doc_id", "field", "pos", tx.stem(F.col("word")).alias("term")).where(F.col("term").isin(sorted(only)))
    return words.groupBy("term", "doc_id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def lengths(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, words) of all fields together."""
    return docs.select("doc_id", sum((F.size(words_in(F.coalesce(F.col(c), F.lit("")))) for c in fields), F.lit(0)).alias("words"))


def stored(found: DataFrame, path: str) -> DataFrame:
    """The index as a table sorted by term and document, so that a search reads the parts that hold its terms. A frequent
    term takes several parts."""
    found.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
    return found.sparkSession.read.parquet(path)


# Searches


@dataclass
class Item:
    terms: list[str]
    without: bool = False


def stem_of(w: str) -> str:
    """What ``text.stem`` gives for a word."""
    n = len(w.encode())
    if n > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    if n > 4 and w.endswith(("ches", "shes", "sses", "xes")):
        return w[:-2]
    return w[:-1] if n > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")) else w


def words_of(text: str) -> list[str]:
    """What ``terms_of`` gives for a text."""
    joined = re.sub(r"(?i)\b(\d{3})\s?\(\s?([a-z])\s?\)", r"\1\2", text)
    return [stem_of(w) for w in "".join(c if c.isalpha() or c.isdecimal() else " " for c in joined.lower()).split()]


def parse_search(text: str) -> list[list[Item]]:
    """Alternatives, each a list of items that must all be there (or be missing). A word with signs inside is a phrase."""
    out: list[list[Item]] = [[]]
    left = MOST_WORDS
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)(?:"|\Z)|([^\s"]+)', text):
        if word.lower() == "or":
            out.append([])
            continue
        item = Item(words_of(phrase or word)[:left], bool(minus) or word.startswith("-"))
        if item.terms:
            out[-1].append(item)
            left -= len(item.terms)
    return [clause for clause in out if clause]


def any_of(question: str, most: int = 12) -> list[list[Item]]:
    """An alternative for each of the first ``most`` words of a question that carry meaning: three letters or digits at
    least, none of ``SEARCH_STOP``."""
    words = [re.sub("[^a-z0-9]", "", w) for w in question.lower().split()]
    kept = list(dict.fromkeys(w for w in words if len(w) >= 3 and w not in SEARCH_STOP))[:most]
    return [[Item([stem_of(w)])] for w in kept]


def compiled(spark: SparkSession, searches: dict[str, list[list[Item]]]) -> tuple[DataFrame, DataFrame]:
    """Searches as rows: the words of their items, and their alternatives with how many items must be there."""
    words, clauses = [], []
    for name, search in searches.items():
        seen: set[str] = set()
        for c, clause in enumerate(search):
            clauses.append((name, c, sum(not i.without for i in clause)))
            for k, item in enumerate(clause):
                for offset, term in enumerate(item.terms):
                    counts = not item.without and term not in seen
                    words.append((term, name, c, k, item.without, offset, len(item.terms), counts))
                    if counts:
                        seen.add(term)
    return (
        spark.createDataFrame(words, "term string, search string, clause int, item int, without boolean, offset int, size int, counts boolean"),
        spark.createDataFrame(clauses, "search string, clause int, needed int"),
    )


def found(postings: DataFrame, sizes: DataFrame, searches: dict[str, list[list[Item]]], title: str = "title", body_weight: float = 0.4) -> DataFrame:
    """(search, doc_id, rank) of all documents that a search finds. The rank is a weighted frequency: 1 for each place of a
    wanted term in the title, ``body_weight`` for one elsewhere, by the logarithm of the document's words."""
    spark = postings.sparkSession
    words, clauses = compiled(spark, searches)
    hits = postings.join(F.broadcast(words), "term").repartition("search", "doc_id")
    parts = hits.groupBy("search", "doc_id", "clause", "item", "without", "size", "field").agg(F.collect_list(F.transform("positions", lambda p: p - F.col("offset"))).alias("starts"))
    # A phrase begins where all its words, moved back by their place in it, meet.
    meet = F.aggregate(F.slice("starts", F.lit(2), F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    there = parts.where((F.size("starts") == F.col("size")) & (F.size(meet) > 0)).select("search", "doc_id", "clause", "item", "without").distinct()
    judged = there.groupBy("search", "doc_id", "clause").agg(F.count_if(~F.col("without")).alias("n"), F.count_if("without").alias("bad")).join(F.broadcast(clauses), ["search", "clause"])
    held = judged.where("needed > 0 AND n = needed AND bad = 0").select("search", "doc_id")
    # An alternative that only excludes holds for every other document.
    only = clauses.where("needed = 0")
    rest = sizes.select("doc_id").join(F.broadcast(only), F.lit(True)).join(judged.where("needed = 0 AND bad > 0").select("search", "clause", "doc_id"), ["search", "clause", "doc_id"], "left_anti")
    matched = held.unionByName(rest.select("search", "doc_id")).distinct()
    n = F.size("positions")
    weight = hits.where("counts").groupBy("search", "doc_id").agg(F.sum(F.when(F.col("field") == title, n).otherwise(0)).alias("a"), F.sum(F.when(F.col("field") != title, n).otherwise(0)).alias("b"))
    x = matched.join(weight, ["search", "doc_id"], "left").join(sizes, "doc_id")
    return x.select("search", "doc_id", r6("rank", (F.coalesce("a", F.lit(0)) + body_weight * F.coalesce("b", F.lit(0))) / F.ln(F.col("words") + 2.0)))


def best(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each search, with their place."""
    nth = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("rank"), "doc_id"))
    return matches.withColumn("nth", nth).where(F.col("nth") <= k)


# Questions


@dataclass
class Profile:
    """A question's terms with their weights: 3 for what names its subject (a word with a digit, in capitals, or with a
    capital inside the sentence; a year), 0.25 for generic words, else 1. ``key`` adds up the specific ones; a question
    without any is ``loose``, and all its terms count."""

    weights: dict[str, float] = field(default_factory=dict)
    specific: set[str] = field(default_factory=set)
    loose: bool = False

    @property
    def key(self) -> float:
        return sum(w for t, w in self.weights.items() if self.loose or t in self.specific)


def profile(question: str) -> Profile:
    joined = re.sub(r"(?i)\b(\d{3})\s?\(\s?([a-z])\s?\)", r"\1\2", question)
    named = set()
    for k, raw in enumerate("".join(c if c.isalpha() or c.isdecimal() or c == "$" else " " for c in joined).split()):
        w = raw.removeprefix("$")
        letters, digits = any(c.isalpha() for c in w), any(c.isdecimal() for c in w)
        if w and (letters and digits or w.upper() == w and letters and 2 <= len(w) <= 5 or w[0].isupper() and k):
            named.add(stem_of(w.lower()))
    out = Profile()
    for t in dict.fromkeys(words_of(question)):
        if len(t.encode()) < 2 or t in QUESTION_STOP or len(out.weights) >= MOST_WORDS:
            continue
        strong = t in named
        out.weights[t] = 3.0 if strong or len(t) == 4 and t.isdecimal() else 0.25 if t in GENERIC else 1.0
        if t not in GENERIC or strong:
            out.specific.add(t)
    out.loose = not out.specific
    return out


def evidence(postings: DataFrame, sources: DataFrame, questions: dict[str, str], subjects: DataFrame | None = None) -> DataFrame:
    """(question, doc_id, raw, relevant, relevance) of documents with a term of a question, or about its subject. A term
    counts three times in the title, once in the snippet and once in the body; the subject of the question, as told by
    ``subjects`` (question, doc_id), adds 12 and half the key. A document with half the key is relevant; others stay below
    10, unless the question has no relevant document at all. ``sources``: (doc_id, trust, age in days)."""
    spark = postings.sparkSession
    profiles = {name: profile(q) for name, q in questions.items()}
    terms = [(t, name, w, w if t in p.specific or p.loose else 0.0) for name, p in profiles.items() for t, w in p.weights.items()]
    words = spark.createDataFrame(terms, "term string, question string, weight double, counts double")
    keys = spark.createDataFrame([(name, p.key) for name, p in profiles.items()], "question string, key double")
    times = F.when(F.col("field") == "title", 3).otherwise(1)
    each = postings.join(F.broadcast(words), "term").select("question", "doc_id", "term", (times * F.col("weight")).alias("s"), "counts")
    hits = each.repartition("question", "doc_id").groupBy("question", "doc_id", "term").agg(F.sum("s").alias("s"), F.max("counts").alias("counts"))
    x = hits.groupBy("question", "doc_id").agg(F.sum("s").alias("s"), F.sum("counts").alias("matched"))
    if subjects is not None:
        x = x.join(subjects.select("question", "doc_id").distinct().withColumn("subject", F.lit(True)), ["question", "doc_id"], "full")
    else:
        x = x.withColumn("subject", F.lit(False))
    x = x.join(F.broadcast(keys), "question")
    about = F.coalesce("subject", F.lit(False))
    s, matched = F.coalesce("s", F.lit(0.0)) + F.when(about, 12.0).otherwise(0.0), F.coalesce("matched", F.lit(0.0))
    x = x.select("question", "doc_id", s.alias("raw"), (F.greatest(matched, F.when(about, F.col("key") / 2).otherwise(0.0)) * 2 >= F.col("key")).alias("relevant"))
    some = F.broadcast(x.groupBy("question").agg(F.max("relevant").alias("some")))  # one row a question
    full = F.col("raw") * 10 + F.col("trust") / 25 + F.when(F.col("age") >= 0, 1 / (1 + F.col("age") / 7)).otherwise(0.0)
    scored = x.join(some, "question").join(sources.select("doc_id", "trust", "age"), "doc_id")
    low = ~(F.col("relevant") | (~F.col("some") & (F.col("raw") > 0)))
    return scored.select("question", "doc_id", "raw", "relevant", F.round(F.when(low, F.least(full / 10, F.lit(9.9))).otherwise(full), 2).alias("relevance"))


def picked(ranked: DataFrame, hosts: DataFrame, cap: int = 3, official: int = 6, limit: int = 20) -> DataFrame:
    """(question, pick, doc_id): the best ``limit`` of a question with a relevance of 10 and a body, at most ``cap`` of a host
    (``official`` of one with a trust of 100). ``hosts``: (doc_id, host, trust, has_body)."""
    order = [F.desc("relevance"), "doc_id"]
    x = ranked.where("relevance >= 10").join(hosts.where("has_body"), "doc_id")
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("question", "host").orderBy(*order))).where(F.col("nth") <= max(cap, official))
    x = x.where(F.col("nth") <= F.when(F.col("trust") >= 100, official).otherwise(cap))
    x = x.withColumn("pick", F.row_number().over(Window.partitionBy("question").orderBy(*order))).where(F.col("pick") <= limit)
    return x.select("question", "pick", "doc_id", "host", "relevance")


def mentioned(ranked: DataFrame, entities: DataFrame, top: int = 15) -> DataFrame:
    """(question, symbol, mentions): entities (doc_id, symbol) of three and a fifth of the question's ``top`` relevant
    documents at least."""
    nth = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("relevance"), "doc_id"))
    first = ranked.where("relevance >= 10").withColumn("nth", nth).where(F.col("nth") <= top)
    x = first.join(entities.select("doc_id", "symbol").distinct(), "doc_id").groupBy("question", "symbol").agg(F.count("*").alias("mentions"))
    size = first.groupBy("question").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(size), "question").where("mentions >= 3 AND mentions >= 0.2 * n").select("question", "symbol", "mentions")


# Queries

SEARCHES = {
    "all": "licensed under",
    "any": "idiot or moron or clowns",
    "phrase": '"with and" -clown',
    "minus": "the -license",
    "mixed": '"in the" trash or "of the" scum -"to the" or under-cc',
    "only": "-the -de -die",
}
QUESTIONS = {
    "license": "Which licenses cover worthless trash or CC texts?",
    "plan": "What does a 401(k) cost a pathetic CLOWN in 2026",
    "loose": "best stocks to buy now",
}
FIELDS = ["title", "body"]



def _terms_sql(column: str) -> str:
    plain = rf"trim(regexp_replace(lower({tx.plans_sql(column)}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
    return f"list_transform(list_filter(string_split({plain}, ' '), lambda w: w <> ''), lambda w: {tx.stem_sql('w')})"


_TERMS = f"{_HEAD}, w AS (SELECT doc_id, source, {_terms_sql('title')} AS title, {_terms_sql('body')} AS body FROM h), j AS (SELECT *, ' ' || array_to_string(title, ' ') || ' ' AS t, ' ' || array_to_string(body, ' ') || ' ' AS b FROM w)"


def _search_sql() -> str:
    parts = []
    for name, text in SEARCHES.items():
        clauses = parse_search(text)
        has = lambda i: f"{'NOT ' if i.without else ''}(contains(t, ' {' '.join(i.terms)} ') OR contains(b, ' {' '.join(i.terms)} '))"
        wanted = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(t for c in clauses for i in c if not i.without for t in i.terms)) + "]::VARCHAR[]"
        count = lambda f: f"len(list_filter({f}, lambda w: list_contains({wanted}, w)))"
        parts.append(f"SELECT '{name}' AS search, doc_id, round(({count('title')} + 0.4::DOUBLE * {count('body')}) / ln(len(title) + len(body) + 2.0::DOUBLE), 6) AS rank FROM j WHERE {' OR '.join('(' + ' AND '.join(map(has, c)) + ')' for c in clauses)}")
    return f"WITH {_TERMS} " + " UNION ALL ".join(parts)


@query(_search_sql())
def t12_search_forms(spark, sf_dir):
    """All documents that searches of each form find: all words, any word, phrases, exclusions, alternatives of them."""
    docs, searches = headlines(spark, sf_dir), {k: parse_search(v) for k, v in SEARCHES.items()}
    terms = {t for search in searches.values() for clause in search for i in clause for t in i.terms}
    return found(index(docs, FIELDS, terms), lengths(docs, FIELDS), searches)


@query(f"""WITH m AS ({_search_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY rank DESC, doc_id) AS nth FROM m) SELECT search, doc_id, rank, nth FROM r WHERE nth <= 20""")
def t12_best_matches(spark, sf_dir):
    """The twenty best of each."""
    return best(t12_search_forms(spark, sf_dir), 20).select("search", "doc_id", "rank", F.col("nth").cast("long").alias("nth"))


def _evidence_sql() -> str:
    parts = []
    for name, text in QUESTIONS.items():
        p = profile(text)
        hit = lambda f, t: f"list_contains({f}, '{t}')"
        raw = " + ".join(f"{w} * (CASE WHEN {hit('title', t)} THEN 3 ELSE 0 END + CASE WHEN {hit('body', t)} THEN 1 ELSE 0 END)" for t, w in p.weights.items())
        matched = " + ".join(["0", *(f"CASE WHEN {hit('title', t)} OR {hit('body', t)} THEN {w} ELSE 0 END" for t, w in p.weights.items() if p.loose or t in p.specific)])
        subject = f"source = 'src{len(text) % 20}'"
        parts.append(f"SELECT '{name}' AS question, doc_id, source, ({raw} + CASE WHEN {subject} THEN 12 ELSE 0 END)::DOUBLE AS raw, greatest({matched}, CASE WHEN {subject} THEN {p.key} / 2 ELSE 0 END) * 2 >= {p.key} AS relevant FROM w")
    return f"""WITH {_TERMS}, q AS ({" UNION ALL ".join(parts)}), v AS (SELECT *, bool_or(relevant) OVER (PARTITION BY question) AS any_relevant,
 raw * 10 + CASE WHEN source = 'src0' THEN 100 WHEN right(source, 1) IN ('1', '2', '3') THEN 75 ELSE 50 END / 25 + 1 / (1 + (doc_id % 30) / 7.0::DOUBLE) AS whole FROM q WHERE raw > 0),
e AS (SELECT question, doc_id, source, raw, relevant, round(CASE WHEN relevant OR NOT any_relevant THEN whole ELSE least(whole / 10, 9.9) END, 2) AS relevance FROM v)"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(evidence, documents with trust and age); a document's source stands for the company it is about."""
    docs = headlines(spark, sf_dir)
    trust = F.when(F.col("source") == "src0", 100).when(F.substring("source", -1, 1).isin("1", "2", "3"), 75).otherwise(50)
    sources = docs.select("doc_id", F.col("source").alias("host"), trust.alias("trust"), (F.col("doc_id") % 30).alias("age"), (F.trim("body") != "").alias("has_body"))
    names = F.create_map(*[F.lit(x) for name, text in QUESTIONS.items() for x in (f"src{len(text) % 20}", name)])
    subjects = docs.select(F.try_element_at(names, F.col("source")).alias("question"), "doc_id").where("question IS NOT NULL")
    terms = {t for q in QUESTIONS.values() for t in profile(q).weights}
    return evidence(index(docs, FIELDS, terms), sources, QUESTIONS, subjects), sources


@query(f"{_evidence_sql()} SELECT question, doc_id, raw, relevant, relevance FROM e")
def t20_question_evidence(spark, sf_dir):
    """Three questions over all documents: one with a proper subject, one with a plan, a name and a year, one of generic words."""
    return _asked(spark, sf_dir)[0]


@query(f"""{_evidence_sql()}, r AS (SELECT e.*, row_number() OVER (PARTITION BY question, e.source ORDER BY relevance DESC, doc_id) AS nth FROM e JOIN h USING (doc_id) WHERE relevance >= 10 AND trim(body) <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY relevance DESC, doc_id) AS pick FROM r WHERE nth <= CASE WHEN source = 'src0' THEN 6 ELSE 3 END) SELECT question, pick, doc_id, source AS host, relevance FROM p WHERE pick <= 20""")
def t22_question_picks(spark, sf_dir):
    ranked, sources = _asked(spark, sf_dir)
    return picked(ranked, sources).withColumn("pick", F.col("pick").cast("long"))


@query(f"""{_evidence_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY relevance DESC, doc_id) AS nth FROM e WHERE relevance >= 10), t AS (SELECT *, count(*) OVER (PARTITION BY question) AS n FROM r WHERE nth <= 15)
SELECT question, source AS symbol, count(*) AS mentions FROM t GROUP BY question, source HAVING count(*) >= 3 AND count(*) >= 0.2 * any_value(n)""")
def t23_question_subjects(spark, sf_dir):
    ranked, sources = _asked(spark, sf_dir)
    return mentioned(ranked, sources.select("doc_id", F.col("host").alias("symbol")))
