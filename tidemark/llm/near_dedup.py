"""Near-duplicate classes by BagMinHash (operator 9).

A text's features are its runs of five words (white space apart, A-Z in lower case; fewer words: all of them as one),
each with the number of its occurrences as weight. Two texts are linked if the weighted Jaccard similarity of these
multisets is at least 0.8; classes are what links connect.

1. Texts of the same features are one representative, the smallest doc_id.
2. Each representative gets a signature: every feature starts Poisson processes over the levels of its weight, cut at
   powers of two, and each of the signature's registers keeps the earliest point under the weight. The chance that a
   register agrees is the weighted Jaccard similarity. Points are drawn up to a time by which registers are filled, and
   further where one is still empty, so the cost hardly depends on weights.
3. Registers are banded into buckets. In each bucket every member is compared with the smallest, which connects most of a
   large class at about one pair a member. Then, in buckets that still hold several components, members of different
   components are compared. So no pair of a bucket that could connect two classes stays unseen.
4. Two tests inside the join leave candidate pairs out before texts are fetched. Features fall into 1024 cells, of which a
   bit each tells whether it is taken; a cell that only one text has taken is a feature the other lacks, so the cells
   bound the similarity from above, and no linked pair is lost. Of each register three bits are kept, and pairs that
   differ in over seven standard errors more registers than texts of similarity 0.8 would go too, which a linked pair does
   with probability 3e-10, next to 6e-6 for the bands (``errors=None`` goes without this test). All others are verified
   on whole texts by exact overlap of their multisets.

At similarity 0.8 the default 40 bands of 6 miss a pair with probability 6e-6. Null texts and texts without a word are
classes of their own; so are rows without a doc_id, whose class is null. Repeated rows get their row each; rows of one
doc_id with other texts are one document to its links, of which the first text in order is compared. Columns beside doc_id
and text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import documents, texts, written
from tidemark.llm.words import white_space_words

_U = np.uint64
CELLS = 1024
SKETCH = "struct<weight: long, taken: int, cells: array<long>, planes: array<long>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input turns each bit of the result half of the time."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Features:
    """Runs of ``run`` words of texts, as sorted 64-bit numbers with weights."""

    def __init__(self, run: int = 5):
        self.run = run

    def of(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The features of each text; empty ones for texts without words."""
        codes, lengths, words = white_space_words(texts)
        hashes = np.fromiter((int.from_bytes(hashlib.blake2b(w.as_buffer(), digest_size=8).digest(), "little") for w in words), np.uint64, len(words))
        h, begin = hashes[codes], np.concatenate([[0], np.cumsum(lengths)])
        # Runs of all texts in a row: those that reach over the end of a text are left out below.
        runs = np.full(max(0, len(h) - self.run + 1), self.run, np.uint64)
        for k in range(self.run):
            runs = mixed(runs * _U(0x9E3779B97F4A7C15) + h[k : len(h) - self.run + 1 + k])
        return [self._one(h, runs, a, z) for a, z in zip(begin.tolist(), begin[1:].tolist())]

    def _one(self, h: np.ndarray, runs: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        if z - a >= self.run:
            x = np.sort(runs[a : z - self.run + 1])
        elif z > a:
            x = np.array([z - a], np.uint64)
            for k in range(a, z):
                x = mixed(x * _U(0x9E3779B97F4A7C15) + h[k : k + 1])
        else:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[first], np.diff(first, append=len(x))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x = np.concatenate([a[0], b[0]])
    order = np.argsort(x, kind="stable")
    x, w = x[order], np.concatenate([a[1], b[1]])[order]
    both = np.flatnonzero(x[1:] == x[:-1])
    common = int(np.minimum(w[both], w[both + 1]).sum())
    return common / (int(w.sum()) - common)


def signatures(features: list[tuple[np.ndarray, np.ndarray]], size: int, points: float = 8.0) -> np.ndarray:
    """(texts, size) earliest times. ``points``: how many points a register gets on average before the first look."""
    n = len(features)
    total = np.array([w.sum() for _, w in features], float)
    text = np.repeat(np.arange(n), [len(w) for _, w in features])
    key = np.concatenate([x for x, _ in features])
    weight = np.concatenate([w for _, w in features]).astype(np.int64)
    # Levels 0, 1, 2, 3-4 .. of a weight: level k > 0 covers [2^(k-1), 2^k), level 0 covers [0, 1).
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    wide = np.maximum(low, 1)
    seed = mixed(key[at] + mixed(level.astype(np.uint64) + _U(1)))
    text, weight = text[at], weight[at]
    out = np.full(n * size, np.inf)
    until, todo = points / total, np.ones(n, bool)
    while todo.any():
        live = np.flatnonzero(todo[text])
        time, turn = np.zeros(len(live)), 0
        while len(live):
            step = seed[live] + _U((2 * turn * 0x9E3779B97F4A7C15) & (2**64 - 1))
            gap = (mixed(step + _U(0x9E3779B97F4A7C15)) >> _U(11)).astype(float) * 2.0**-53
            time = time - np.log1p(-gap) / (wide[live] * size)
            early = time < until[text[live]]
            live, time, step = live[early], time[early], step[early]
            draw = mixed(step + _U(0x3C6EF372FE94F82A))
            register = ((draw >> _U(32)) * _U(size)) >> _U(32)
            height = low[live] + wide[live] * ((draw & _U(0xFFFFFFFF)).astype(float) * 2.0**-32)
            under = height < weight[live]
            np.minimum.at(out, text[live][under] * size + register[under].astype(np.int64), time[under])
            turn += 1
        todo = np.isinf(out.reshape(n, size)).any(1)
        until = until * 2
    return out.reshape(n, size)


def banded(registers: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) bucket numbers."""
    x = registers.view(np.uint64).reshape(len(registers), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), x.shape[:2]).copy()
    for k in range(x.shape[2]):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + x[:, :, k])
    return out.view(np.int64)


def planes_of(registers: np.ndarray) -> np.ndarray:
    """(texts, longs) the three lowest bits of each register's hash, a plane of longs for each bit."""
    low = mixed(registers.view(np.uint64))
    pad = -registers.shape[1] % 64
    bits = [np.pad(np.packbits(((low >> _U(k)) & _U(1)).astype(np.uint8), axis=1), ((0, 0), (0, pad // 8))) for k in range(3)]
    return np.concatenate(bits, axis=1).view(np.int64)


def cells_of(features: np.ndarray) -> np.ndarray:
    """Which of the ``CELLS`` cells the features take, as longs."""
    taken = np.zeros(CELLS, np.uint8)
    taken[features >> _U(64 - CELLS.bit_length() + 1)] = 1
    return np.packbits(taken).view(np.int64)


def differing(x: Column, y: Column, size: int) -> Column:
    """In how many registers two columns of planes differ."""
    longs = -(-size // 64)
    bit = lambda k, p: F.get(x, p * longs + k).bitwiseXOR(F.get(y, p * longs + k))
    return reduce(Column.__add__, [F.bit_count(bit(k, 0).bitwiseOR(bit(k, 1)).bitwiseOR(bit(k, 2))) for k in range(longs)])


def profiles(docs: DataFrame, run: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, d1, d2, sketch, buckets): digests of the features, their weight, cells and bits of the registers; all but
    doc_id null for texts without a word."""
    size = bands * rows
    kind = pa.struct([("weight", pa.int64()), ("taken", pa.int32()), ("cells", pa.list_(pa.int64())), ("planes", pa.list_(pa.int64()))])

    def work(batches):
        features = Features(run)
        for b in batches:
            at = 0
            while at < b.num_rows:
                start, chars = at, 0
                while at < b.num_rows and (at == start or chars < 2 << 20):
                    chars += len(b.column(1)[at].as_py())
                    at += 1
                part = b.slice(start, at - start)
                mine = features.of(part.column(1))
                some = [k for k, (x, _) in enumerate(mine) if len(x)]
                d1, d2, sketch, buckets = ([None] * len(mine) for _ in range(4))
                if some:
                    registers = signatures([mine[k] for k in some], size)
                    for k, plane, bucket in zip(some, planes_of(registers), banded(registers, bands)):
                        digest = hashlib.blake2b(mine[k][0].tobytes() + mine[k][1].tobytes(), digest_size=16).digest()
                        d1[k], d2[k] = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                        cells = cells_of(mine[k][0])
                        sketch[k], buckets[k] = {"weight": int(mine[k][1].sum()), "taken": int(np.bitwise_count(cells.view(np.uint64)).sum()), "cells": cells, "planes": plane}, bucket
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, kind), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "sketch", "buckets"])

    return texts(docs).mapInArrow(work, f"doc_id long, d1 long, d2 long, sketch {SKETCH}, buckets array<long>")


def most_differing(least: float, size: int, errors: float) -> int:
    """In how many of ``size`` registers, of three bits each, two texts of similarity ``least`` differ at most, but for
    what lies over ``errors`` standard errors."""
    p = (1 - least) * 7 / 8
    return min(size, int(size * p + errors * (size * p * (1 - p)) ** 0.5))


class Links:
    """Verifies candidate pairs of representatives."""

    def __init__(self, docs: DataFrame, reps: DataFrame, run: int, least: float, size: int, errors: float | None):
        self.docs, self.run, self.least, self.size, self.errors = texts(docs), run, least, size, errors
        self.sketch = reps.select("rep", "sketch")

    def sketched(self, rows: DataFrame, v: str, name: str) -> DataFrame:
        """``rows`` with the sketch of the representative in column ``v``."""
        return rows.join(self.sketch.select(F.col("rep").alias(v), F.col("sketch").alias(name)).hint("merge"), v)

    def likely(self) -> Column:
        """Whether sketches ``x`` and ``y`` leave it open that a pair is linked."""
        x, y = F.col("x"), F.col("y")
        either = reduce(Column.__add__, [F.bit_count(F.get(x["cells"], k).bitwiseOR(F.get(y["cells"], k))) for k in range(CELLS // 64)])
        common = F.least(x["weight"] - either + y["taken"], y["weight"] - either + x["taken"])
        # least * (weight of both - common) <= common, at the most that common can be; the last term is for rounding.
        open_ = common * (1 + self.least) >= self.least * (x["weight"] + y["weight"]) - 1e-6
        if self.errors is None:
            return open_
        return open_ & (differing(x["planes"], y["planes"], self.size) <= most_differing(self.least, self.size, self.errors))

    def verify(self, close: DataFrame) -> DataFrame:
        """(a, b) of those pairs of ``close`` (a, b) that are linked."""
        run, least = self.run, self.least
        ends = close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        needed = written(self.docs.join(ends.hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "needed")

        def exact(batches):
            features, kept = Features(run), {}

            def of(doc, text):
                if doc not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    kept[doc] = features.of(pa.array([text.as_py()], pa.string()))[0]
                return kept[doc]

            for b in batches:
                a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
                keep = [similarity(of(x, t), of(y, u)) >= least for x, y, t, u in zip(a, c, b.column(2), b.column(3))]
                part = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

        left = needed.select(F.col("doc_id").alias("a"), F.col("text").alias("t"))
        right = needed.select(F.col("doc_id").alias("b"), F.col("text").alias("u"))
        return written(close.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "t", "u").mapInArrow(exact, "a long, b long"), "found")


def classes(docs: DataFrame, run: int = 5, least: float = 0.8, bands: int = 40, rows: int = 6, errors: float | None = 7.0, block: int = 256) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text): the smallest doc_id of the row's class. ``errors``: the
    standard errors of the test on registers, None to go without it; ``block``: members of a bucket in a task's block."""
    profile = written(profiles(docs, run, bands, rows), "profiles")
    known = profile.where(F.col("doc_id").isNotNull() & F.col("d1").isNotNull())
    reps = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets")), "reps")
    members = reps.select(F.col("rep").alias("v"), F.explode("buckets").alias("bucket")).repartition("bucket")
    heads = members.groupBy("bucket").agg(F.min("v").alias("head"), F.max("v").alias("tail")).where("head < tail").select("bucket", "head")
    shared = written(members.join(heads.hint("merge"), "bucket"), "buckets")
    links = Links(docs, reps, run, least, bands * rows, errors)

    # Each member with the smallest of its buckets.
    star = shared.where("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b")).distinct()
    both = links.sketched(links.sketched(star, "a", "x"), "b", "y")
    found = links.verify(written(both.where(links.likely()).select("a", "b"), "close"))
    label = components(found)

    # Members of different components of a bucket with each other; the smallest has been compared with all. A bucket's
    # members are dealt into blocks, and each two blocks of a bucket are a key of their own, so no task gets a whole bucket.
    named = shared.join(label.hint("merge"), "v", "left").withColumn("c", F.coalesce("c", "v")).where("v <> head")
    mixed_up = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("low < high").select("bucket", "blocks")
    rest = written(links.sketched(named.join(mixed_up.hint("merge"), "bucket").select("bucket", "v", "c", "blocks"), "v", "x"), "rest")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    one = rest.select("bucket", F.col("v").alias("a"), "c", "x", F.col("mine").alias("i"), F.explode(F.sequence("mine", F.col("blocks") - 1)).alias("j"))
    other = rest.select("bucket", F.col("v").alias("b"), F.col("c").alias("d"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), "mine")).alias("i"), F.col("mine").alias("j"))
    open_pairs = one.join(other.hint("merge"), ["bucket", "i", "j"]).where((F.col("c") != F.col("d")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & links.likely())
    pairs = open_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = found.union(links.verify(written(pairs.select("a", "b").distinct(), "close")))
    label = components(found)
    named = reps.select("d1", "d2", "rep").join(label.withColumnRenamed("v", "rep").hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("c", "rep").alias("class"))
    return profile.select("doc_id", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
