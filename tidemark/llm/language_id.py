"""Language identification by rank-order profiles (operator 4).

A profile lists the most frequent 1- to 3-byte n-grams of a language's texts by rank. A document's own list is compared
with each profile: every n-gram adds the distance of its two ranks, or ``top`` if the profile lacks it. The nearest
profile names the language; ties go to the name that sorts first.

Profiles learn from labelled rows outside the held-out fold; of a language with more than ``sample`` such rows, a share
of about ``sample`` rows is taken by a hash of doc_id, which bounds the work of learning, and whole texts count. Only the
profiles, ``top`` rows a language, and the languages' counts reach the driver. Prediction reads whole texts and shuffles nothing.

Very long texts are read whole, in time n log n of their length. ``und`` with score 0: null and empty texts, texts without a letter, and all rows if nothing could be learned. Repeated rows each
get their row. Columns beside doc_id, text and lang are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import documents

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, fit double"
#: A-Z to a-z, other ASCII but letters to space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(folds: int = 5):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The 1- to 3-byte n-grams of a folded text, as numbers, and how often each occurs; words keep a space around."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    all_ = np.concatenate([b[b != 32], two, two[:-1] << 8 | b[2:]])
    all_.sort()
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]]))
    return all_[first], np.diff(first, append=len(all_))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, ties by number."""
    if len(codes) > 2 * top:
        keep = counts >= np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Ranks of n-grams in each language's profile."""

    def __init__(self, by_lang: dict[str, list[int]], top: int):
        self.names, self.top = sorted(by_lang), top
        self.codes = np.unique(np.array([c for x in by_lang.values() for c in x], np.uint32))
        self.rank = np.full((len(self.names), len(self.codes)), -1, np.int32)
        for k, name in enumerate(self.names):
            mine = np.array(by_lang[name], np.uint32)
            self.rank[k, np.searchsorted(self.codes, mine)] = np.arange(len(mine))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """The out-of-place distance to each profile and the largest possible one, None for a text without n-grams."""
        mine = ranked(*grams(text), self.top)
        if not len(mine):
            return None
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == mine
        rank = self.rank[:, at[known]]
        out = np.abs(rank - np.flatnonzero(known))
        out[rank < 0] = self.top
        return np.minimum(out, self.top).sum(1) + self.top * int((~known).sum()), self.top * len(mine)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, fit): the share by which the best distance is under the second best, and under the largest."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        if (found := self.distances(text)) is None:
            return "und", 0.0, 0.0
        d, most = found
        best = int(d.argmin())
        second = int(np.delete(d, best).min()) if len(d) > 1 else most
        return self.names[best], 1 - d[best] / second if second else 0.0, 1 - d[best] / most


def learn(docs: DataFrame, top: int = 300, sample: int = 2000, folds: int = 5) -> Profiles:
    """Profiles of all languages of the rows outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(folds) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    # One number for each language: no join, and no shuffle of texts.
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in rows.groupBy("lang").count().collect()}
    if not share:
        return Profiles({}, top)
    of_lang = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.try_element_at(of_lang, F.col("lang"))).select("lang", "text")

    def counted(batches):
        for b in batches:
            sums: dict = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                codes, counts = grams(text.as_py())
                sums.setdefault(lang, ([], []))
                sums[lang][0].append(codes)
                sums[lang][1].append(counts)
            for lang, (codes, counts) in sums.items():
                c, inverse = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(inverse, np.concatenate(counts), len(c)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    totals = chosen.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_lang: dict[str, list[int]] = {}
    for r in totals.withColumn("rank", first).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_lang, top)


def predict(docs: DataFrame, profiles: Profiles, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, fit) of every row of ``docs`` (doc_id, text)."""

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = [profiles.predict(t.as_py()) for t in part.column(2)]
                cols = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "fit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(folds), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, SCHEMA)


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with (lang_pred, score, fit), by an Arrow function on the text alone."""

    @F.pandas_udf("lang_pred string, score double, fit double")
    def guess(text):
        import pandas as pd

        return pd.DataFrame([profiles.predict(t) for t in text], columns=["lang_pred", "score", "fit"])

    return docs.withColumn("language", guess("text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
