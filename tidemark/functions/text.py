"""Text functions as columns (T1-T3, T5, T10, T13, S11, S12, string, hash and URL groups of the scalar functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a title's key leaves out.
STOP_WORDS = [
    "a", "after", "amid", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "cent", "could", "down", "for", "from", "had", "has", "have", "in", "into", "is", "it",
    "its", "may", "might", "more", "new", "of", "on", "or", "over", "per", "said", "says", "should", "than", "that", "the", "these", "this", "those", "to", "up", "was", "were",
    "will", "with", "would",
]
#: Query parameters that only track.
TRACKING = [
    "__twitter_impression", "at_campaign", "at_medium", "campaign_id", "cmpid", "dclid", "fbclid", "feature", "gclid", "guccounter", "igshid", "mc_cid", "mc_eid", "msclkid", "ncid",
    "partner", "ref", "ref_src", "referrer", "s", "smid", "source", "spm", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_name", "utm_source", "utm_term", "yptr",
]


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, without stop words and single characters."""
    # Letter by letter, as DuckDB lowers: without the dot that a capital I with one would keep, and without final sigma.
    low = F.lower(F.translate(text, "\u0130\u03a3", "i\u03c3"))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{Nd}]+", " ")), " ")
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def title_key(text: Column) -> Column:
    """24 hexadecimal digits for the set of a title's tokens; empty without any."""
    x = F.array_sort(F.array_distinct(tokens(text)))
    return F.when(F.size(x) == 0, "").otherwise(F.substring(F.sha2(F.array_join(x, " "), 256), 1, 24))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def digest(parts: list[Column], digits: int = 32) -> Column:
    """The first digits of a hash of parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits)


def canonical_url(url: Column) -> Column:
    """https, host in lower case without www and the ports 80 and 443, no fragment or tracking parameters, parameters sorted, no slash at
    the end. Null for what is no http URL."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^https?://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    out = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(url).rlike(r"(?i)^https?://[^/?#]"), out)


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def clean_html(html: Column) -> Column:
    """Text of HTML: tags dropped, common entities resolved, white space collapsed."""
    x = F.regexp_replace(html, r"<[^>]*>", " ")
    x = reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), _ENTITIES.items(), x)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_sentences(text: Column, n: int) -> Column:
    """A text up to its n-th full stop before a space or line feed; all of it where there are fewer."""
    head = F.regexp_extract(text, sentence_pattern(n), 1)
    return F.when(head == "", text).otherwise(head)


def sentence_pattern(n: int) -> str:
    """For both engines: n times as little as possible up to a full stop, of which a space or line feed follows."""
    return r"(?s)^(" + r".*?\.[ \n]" * (n - 1) + r".*?\.)[ \n]"


def stem(word: Column) -> Column:
    """Singular of a plural: ies to y and ches, shes, sses, xes without es in words of over four bytes; without s in words of
    over three, but for ss, us and is."""
    n = F.octet_length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when((n > 4) & word.rlike("(ch|sh|ss|x)es$"), F.regexp_replace(word, "es$", ""))
        .when((n > 3) & word.rlike("[^sui]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def stem_sql(word: str) -> str:
    """The same in DuckDB."""
    return (
        f"CASE WHEN strlen({word}) > 4 AND {word} LIKE '%ies' THEN regexp_replace({word}, 'ies$', 'y') WHEN strlen({word}) > 4 AND regexp_matches({word}, '(ch|sh|ss|x)es$') THEN regexp_replace({word}, 'es$', '') "
        f"WHEN strlen({word}) > 3 AND regexp_matches({word}, '[^sui]s$') THEN regexp_replace({word}, 's$', '') ELSE {word} END"
    )


def joined_plans(text: Column) -> Column:
    """A text with "401(k)" and its like as one word; only texts with a bracket are looked through."""
    return F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, r"(?i)\b(\d{3})\s?\(\s?([a-z])\s?\)", "$1$2")).otherwise(text)


def plans_sql(text: str) -> str:
    """The same in DuckDB."""
    return rf"regexp_replace({text}, '(?i)\b(\d{{3}})\s?\(\s?([a-z])\s?\)', '\1\2', 'g')"


def strip_publisher(title: Column, publisher: Column) -> Column:
    """A title without " - Publisher" at its end, in any of four separators."""
    tail = F.regexp_extract(title, r"^.*( - | \| | – | — )(.*)$", 2)
    head = F.regexp_extract(title, r"^(.*)( - | \| | – | — ).*$", 1)
    return F.when((tail != "") & (F.lower(tail) == F.lower(publisher)), head).otherwise(title)


def feed_time(text: Column) -> Column:
    """A feed's time in UTC by the first layout that fits; null if none does, never the present."""
    layouts = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "d MMM yyyy"]
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")  # without the day of the week
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(x)) for x in layouts])


def pipe_facts(text: Column) -> Column:
    """A map of "KEY: value | KEY: value", keys in upper case."""
    raw = F.filter(F.split(text, r"\|"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(raw, lambda p: F.struct(F.upper(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    return F.map_from_entries(entries)


def loose_number(text: Column) -> Column:
    """A number in text with thousands separators or a percent sign; null for anything else."""
    return F.regexp_replace(text, r"[,%\s]", "").try_cast("double")


def company_key(name: Column) -> Column:
    """A company's name without case, possessives, legal forms and a leading article."""
    x = F.trim(F.regexp_replace(F.replace(F.lower(F.regexp_replace(name, r"/[A-Z]{2}/?$", "")), F.lit("&"), F.lit(" and ")), r"'s\b", ""))
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{Nd}]+", " "))
    for _ in range(4):
        x = F.regexp_replace(x, r" (inc|corp|corporation|co|company|ltd|limited|plc|llc|lp|holdings|group|the|com|sa|nv|ag|trust)$", "")
    return F.regexp_replace(x, "^the ", "")


def latin_share(text: Column) -> Column:
    """The share of Latin letters among letters; null without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{IsLatin}]", "")), letters)


def script_readable(text: Column) -> Column:
    """Whether at most half of the letters are of another script than Latin."""
    return F.coalesce(latin_share(text) >= 0.5, F.lit(True))
