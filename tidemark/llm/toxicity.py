"""Toxicity scores (operator 12).

Logistic regression by FTRL-proximal over hashed features of a text: its words, the beginnings of longer words (which stand
for inflected forms), word pairs, and skip-grams that leave one word out. Each coordinate has its own learning rate
``alpha / (beta + sqrt(n))``, where n sums its squared gradients; a coordinate whose sum stays within ``l1`` weighs nothing,
so that of 2^``bits`` coordinates few remain. They are broadcast; their number is bounded by 2^``bits``.

A text's value of a feature is its count, divided by the length of the text's vector of counts and multiplied by ``scale``.
The model learns from a bounded sample of labelled rows, ``sample`` in all, dealt over shards of ``shard`` rows. Each shard
is one task, which passes ``epochs`` times over its rows in an order fixed by a hash; the weights of the shards are averaged.

Null and empty texts, and texts without a word, have no features: their score is that of the intercept. Rows without a
doc_id are held out. Repeated rows get their row each; of several labels of a doc_id the highest counts. Without any
labelled row every score is 0.5. Whole texts are read, in blocks of about ``block_bytes``; a very long text is a block of
its own. Columns beside doc_id and text are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, texts
from tidemark.llm.words import gathered, one, white_space_words

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_U = np.uint64
#: Lengths of the word beginnings that count as features of longer words.
PREFIXES = (3, 4, 5, 6)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Features:
    """Hashed features of many texts at once, as (starts, coordinates, values) of a sparse matrix with a row for each."""

    def __init__(self, bits: int = 20, scale: float = 8.0):
        self.bits, self.scale = bits, scale

    def _hashes(self, words: list[str]) -> np.ndarray:
        """A row of hashes for each word: of itself and of its beginnings, 0 where the word is no longer than that."""
        import xxhash

        out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
        for k, w in enumerate(words):
            out[k, 0] = xxhash.xxh3_64_intdigest(w, 1)
            for j, n in enumerate(PREFIXES):
                if len(w) > n:
                    out[k, 1 + j] = xxhash.xxh3_64_intdigest(w[:n], 10 + n)
        return out

    def __call__(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(batch, "")), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ")
        codes, lengths, words = white_space_words(plain)
        rows = np.repeat(np.arange(len(batch), dtype=np.uint64), lengths)
        table = self._hashes(words.to_pylist())
        one_, many = table[codes, 0], _U(0x9E3779B97F4A7C15)
        found, of = [one_], [rows]
        for gap, salt in ((1, _U(0x4D)), (2, _U(0x3DF))):
            same = rows[gap:] == rows[:-gap]
            found.append(((one_[:-gap] * many + one_[gap:]) ^ salt)[same] * (_U(2) * _U(gap) - _U(1)))
            of.append(rows[gap:][same])
        for j in range(len(PREFIXES)):
            part = table[codes, 1 + j]
            found.append(part[part != 0])
            of.append(rows[part != 0])
        key = np.concatenate(found)
        key *= _U(0xD6E8FEB86659FD93)
        key >>= _U(64 - self.bits)
        key |= np.concatenate(of) << _U(self.bits)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(key))).astype(float)
        key = key[first]
        row = (key >> _U(self.bits)).astype(np.int64)
        norm = np.sqrt(np.bincount(row, counts * counts, len(batch)))
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
        return start, (key & _U((1 << self.bits) - 1)).astype(np.int64), counts * self.scale / np.maximum(norm[row], 1e-300)


def chance(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal: z and n of each coordinate, the last one being the intercept, which has no penalty."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1.5, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, last = self.z[at], at == len(self.z) - 1
        l1, l2 = np.where(last, 0, self.l1), np.where(last, 0, self.l2)
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (chance(w @ x) - label) * x
        n = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(n) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = n

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.z)
        w = self.weights(at)
        return at[w != 0], w[w != 0]


def learn(docs: DataFrame, labels: DataFrame, bits: int = 20, sample: int = 16_384, shard: int = 4_096, epochs: int = 4, **rates) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from the labelled rows that are not held out; the coordinate 2^bits is the intercept."""
    labelled = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out())
    labelled = labelled.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    size = labelled.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003))
    # At most about ``sample`` rows of two numbers, whatever the table's size: small enough to broadcast.
    chosen = F.broadcast(labelled.where(place < math.ceil(1_000_003 * min(1.0, sample / max(size, 1)))))
    shards = max(1, math.ceil(min(size, sample) / shard))
    rows = texts(docs).join(chosen, "doc_id").select("doc_id", "text", "toxic", (place % shards).cast("int").alias("shard"), F.xxhash64(F.lit("order"), "doc_id").alias("nth"))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("nth", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        model, end = Ftrl(1 << bits, **rates), np.array([1 << bits])
        start, at, x = Features(bits)(one(group.column("text")))
        toxic = group.column("toxic").to_pylist()
        for _ in range(epochs):
            for k, (a, z) in enumerate(zip(start, start[1:])):
                model.learn(np.concatenate([at[a:z], end]), np.append(x[a:z], 1.0), toxic[k])
        found, w = model.nonzero()
        return pa.table([pa.array(found, pa.int64()), pa.array(w, pa.float64())], ["coordinate", "weight"])

    fitted = rows.groupBy("shard").applyInArrow(fit, "coordinate long, weight double")
    mean = fitted.groupBy("coordinate").agg((F.sum("weight") / shards).alias("weight")).orderBy("coordinate").toPandas()
    return mean["coordinate"].to_numpy(np.int64), mean["weight"].to_numpy(np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = 20, cut: float = 0.7, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), columns as in ``SCHEMA``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def score(batches):
        weights = np.zeros((1 << bits) + 1)
        weights[shared.value[0]] = shared.value[1]
        features = Features(bits)
        for block in gathered(batches, 2, block_bytes):
            start, at, x = features(one(block.column(2)))
            row = np.repeat(np.arange(block.num_rows), np.diff(start))
            s = chance(np.bincount(row, weights[at] * x, block.num_rows) + weights[-1])
            yield pa.RecordBatch.from_arrays([one(block.column(0)), one(block.column(1)), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, SCHEMA)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
