"""Language-model scores (operator 8).

The model is a weighted backoff automaton over words, of order n. A state is a history of up to n - 1 words seen in
training (texts begin with n - 1 start marks); its arcs are the words that followed it, its failure arc leads to the state
without the oldest word, and the root's arcs are single words. Smoothed probabilities come from counts c:

    p(w | h) = (c(h, w) + mu * p(w | h')) / (c(h) + mu)       p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

where h' is h without its oldest word. So an arc weighs its p, the failure arc of h weighs mu / (c(h) + mu), and the
probabilities of a state add up to 1. A text is traversed once from left to right: the state is carried from word to word,
failure arcs are followed until the state has an arc for the word, and logarithms of the weights add up.

Counts cover all training texts, and neither words nor histories are cut off. Consecutive texts form a block, which numbers
its own words. The distinct-word table sums the words of all blocks; n-grams travel as ranges of a 64-bit hash, sorted and
as differences, whose number follows the number of tokens. Both come back to their blocks as the part of the automaton that
the block's texts can reach. A block names a word or n-gram once, so frequent ones are no hot keys.

Null and empty texts are the end token alone. Rows without a doc_id are held out. Repeated rows get their row each. A very
long text is a block of its own. Without training texts every token is unknown, and the score is that of the base formula
at N = 0. Columns beside doc_id and text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, written
from tidemark.llm.words import by_block, by_frequency, from_packed, from_planes, gathered, hashes_of, one, to_packed, to_planes, white_space_words

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, codes binary, size int, words binary, counts binary, train long, tokens long"
ANSWER = "block long, part int, size int, body binary, new long"
_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


class Grams:
    """The n-grams of a block of texts, for n from 2 to ``order``, by their place: the token they end with. Each text has
    its words and an end token, and start marks before. One n is held at a time."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int):
        self.order, self.codes, self.lengths, self.hashes = order, codes, lengths, hashes
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.ends = np.zeros(self.begin[-1], bool)
        self.ends[self.begin[1:] - 1] = True

    def keys(self) -> Iterator[np.ndarray]:
        """63-bit keys of all places, for each n."""
        h = np.empty(len(self.ends), np.uint64)
        h[~self.ends], h[self.ends] = self.hashes[self.codes], _END
        key = h
        for k in range(1, self.order):
            # The word k places before, a start mark where the text doesn't reach so far.
            before = np.full_like(h, _START)
            before[k:] = h[:-k]
            for j in range(k):
                at = self.begin[:-1] + j
                before[at[at < self.begin[1:]]] = _START
            before *= _U(0x9E3779B97F4A7C15)
            before += key * _U(0xD1342543DE82EF95)
            before += _U(k)
            before ^= before >> _U(32)
            before *= _U(0xD6E8FEB86659FD93)
            before ^= before >> _U(32)
            key = before
            yield key >> _U(1)

    def distinct(self, training: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sorted distinct keys, how often each occurs in texts for which ``training`` holds), for each n."""
        flags = np.repeat(training, self.lengths + 1)
        for marked in self.keys():
            marked <<= _U(1)
            marked |= flags
            marked.sort()
            known = (marked & _U(1)).astype(np.uint8)
            marked >>= _U(1)
            first = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]])) if len(marked) else np.empty(0, np.int64)
            yield marked[first], np.add.reduceat(known, first, dtype=np.int64) if len(first) else first

    def spread(self, totals: list[np.ndarray]) -> list[np.ndarray]:
        """``totals`` of the distinct keys at the place of each n-gram, an array for each n."""
        out = []
        for keys, total in zip(self.keys(), totals):
            order = np.argsort(keys)
            keys = keys[order]
            new = np.zeros(len(keys), bool)
            np.not_equal(keys[1:], keys[:-1], out=new[1:])
            del keys
            number = np.cumsum(new, dtype=np.int32)
            if len(number) and number[-1] + 1 != len(total):
                raise ValueError("a block and its counts do not fit together")
            at = np.empty(len(order), np.int64)
            at[order] = total[number]
            out.append(at)
        return out

    def slices(self, tokens: int = 1 << 17) -> Iterator[tuple[slice, slice]]:
        """Consecutive texts with about so many tokens, one text at least, and the places of their tokens."""
        a, n = 0, len(self.lengths)
        while a < n:
            z = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + tokens, "right")) - 1)
            yield slice(a, z), slice(int(self.begin[a]), int(self.begin[z]))
            a = z


class Automaton:
    """The states and arcs that some texts can reach, held by the token at which they are looked up."""

    def __init__(self, begin: np.ndarray, single: np.ndarray, more: list[np.ndarray], train: int, whole: float, mu: float):
        """``begin``: where each text begins, and the last one ends; ``single``: counts of each token; ``more``: counts of the
        n-grams that end with it, by n."""
        self.begin, p = begin, (single + 0.1) / whole
        self.root = np.log10(p)
        #: For each n from 2: whether the state of n - 1 words has an arc for the token, its weight, the failure weight.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shorter = single
        for count in more:
            history = np.empty_like(count)
            history[1:], history[begin[:-1]] = shorter[:-1], train
            p = (count + mu * p) / (history + mu)
            self.levels.append((count > 0, np.log10(p), np.log10(mu / (history + mu))))
            shorter = count

    def traverse(self) -> np.ndarray:
        """The score of each text, from left to right."""
        out = np.empty(len(self.begin) - 1)
        top = len(self.levels)
        for k, (a, z) in enumerate(zip(self.begin.tolist(), self.begin[1:].tolist())):
            root = self.root[a:z].tolist()
            levels = [tuple(x[a:z].tolist() for x in level) for level in self.levels]
            state, score = top, 0.0
            for i, weight in enumerate(root):
                while state:
                    arc, arc_weight, failure = levels[state - 1]
                    if arc[i]:
                        weight = arc_weight[i]
                        break
                    score += failure[i]
                    state -= 1
                score += weight
                if state < top:
                    state += 1
            out[k] = score
        return out


def judged(grams: Grams, single: np.ndarray, more: list[np.ndarray], train: int, whole: float, mu: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(known tokens, base score, score) of a block's texts, some texts at a time, so that only counts are held of a block."""
    for texts, at in grams.slices():
        begin = grams.begin[texts.start : texts.stop + 1] - at.start
        automaton = Automaton(begin, single[at], [c[at] for c in more], train, whole, mu)
        yield np.add.reduceat((single[at] > 0).astype(np.int64), begin[:-1]), np.add.reduceat(automaton.root, begin[:-1]), automaton.traverse()


def scores(docs: DataFrame, folds: int = 10, mu: float = 20.0, order: int = 2, block_bytes: int = 40 << 20, range_tokens: int = 4_000_000) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), columns as in ``SCHEMA``; ``order``: the n of the longest n-grams,
    1 at least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds).alias("held"), F.col("text"))

    def read(batches):
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for block in gathered(batches, 2, block_bytes):
            ids, held = block.column(0).to_pylist(), block.column(1).to_pylist()
            flat, lengths, words = white_space_words(one(block.column(2)))
            flat, words = by_frequency(flat, words)
            counts = np.bincount(flat[np.repeat(~np.array(held), lengths)], minlength=len(words))
            train = len(held) - sum(held)
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 24 | nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([to_planes(flat, "<i4")], pa.binary()), pa.array([len(words)], pa.int32()), pa.array([to_packed(words)], pa.binary()), pa.array([to_planes(counts, "<i8")], pa.binary()),
                pa.array([train], pa.int64()), pa.array([int(counts.sum()) + train], pa.int64()),
            ], [f.split()[0] for f in BLOCK.split(", ")])
            del block, flat, words, counts
            pa.default_memory_pool().release_unused()
            nth += 1

    table = written(rows.mapInArrow(read, BLOCK), "blocks")
    train, tokens, entries = table.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()
    ranges = max(1, math.ceil((tokens + entries) / range_tokens))  # of each n

    # The distinct-word table, and its counts back at the words' places. A block has a word once, so the first of a word's
    # blocks tells one of its rows. Both sides ask for all columns, so that one exchange serves the two.
    def words_out(batches):
        for b in batches:
            for block, size, body, counts in zip(*(c.to_pylist() for c in b.columns)):
                words, n = from_packed(body), pa.array(from_planes(counts, size, "<i8"))
                order = pc.cast(pc.sort_indices(words), pa.int32())  # neighbours share their beginnings, which packs well
                for k in range(0, size, 1 << 16):
                    part = order.slice(k, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), part, words.take(part), n.take(part)], ["block", "at", "word", "n"])

    at = table.select("block", "size", "words", "counts").mapInArrow(words_out, "block long, at int, word string, n long").where(F.col("word").isNotNull()).repartition("word")
    distinct = at.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("first"), F.max("at").alias("last"))
    new = (F.col("block") == F.col("first")) & (F.col("c") > 0)
    summed = at.join(distinct.hint("merge"), "word").select("block", "at", "c", new.alias("new"), "n", "last")

    def pack(batches):
        for block, mine in by_block(batches):
            body = mine[1].astype("<i4").tobytes() + mine[2].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([len(mine[1])], pa.int32()), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary()), pa.array([int(mine[3].sum())], pa.int64())], ["block", "part", "size", "body", "new"])

    words = written(summed.mapInArrow(pack, ANSWER), "words")
    known = (words.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0] or 0) + (1 if train else 0)

    def grams_of(lengths, codes, words) -> Grams:
        n = np.array(lengths, np.int64)
        return Grams(from_planes(codes, int(n.sum())), n, hashes_of(from_packed(words)), order)

    def send(batches):
        edge = np.array([(k << 63) // ranges for k in range(ranges)], np.uint64)
        for b in batches:
            for block, held, lengths, codes, words in zip(*b.columns):
                grams = grams_of(lengths.as_py(), codes.as_py(), words.as_py())
                for n, (keys, counts) in enumerate(grams.distinct(~np.array(held.as_py(), bool))):
                    edges = [*np.searchsorted(keys, edge), len(keys)]
                    for k, (a, z) in enumerate(zip(edges, edges[1:])):
                        if z > a:
                            steps = np.diff(keys[a:z], prepend=_U(0))
                            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([n * ranges + k], pa.int32()), pa.array([z - a], pa.int32()), pa.array([to_planes(steps)], pa.binary()), pa.array([to_planes(counts[a:z].astype("<u4"))], pa.binary())], ["block", "part", "size", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        sizes = group.column("size").to_pylist()
        keys = [np.cumsum(from_planes(x, n, "<u8"), dtype=np.uint64) for x, n in zip(group.column("keys").to_pylist(), sizes)]
        counts = [from_planes(x, n, "<u4") for x, n in zip(group.column("counts").to_pylist(), sizes)]
        all_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.zeros(len(all_), "<i8")
        for x, c in zip(np.split(inverse, np.cumsum(sizes)[:-1]), counts):
            total[x] += c  # a block has a key once
        back = [to_planes(total[x]) for x in np.split(inverse, np.cumsum(sizes)[:-1])]
        return pa.table([group.column("block"), group.column("part"), group.column("size"), pa.array(back, pa.binary()), pa.array([0] * len(back), pa.int64())], ["block", "part", "size", "body", "new"])

    answers = words
    if order > 1:
        sent = table.select("block", "held", "lengths", "codes", "words").mapInArrow(send, "block long, part int, size int, keys binary, counts binary")
        answers = words.unionByName(sent.groupBy("part").applyInArrow(add_up, ANSWER))
    whole = tokens + 0.1 * (known + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # Bodies are opened one after another, and texts judged some at a time: of a block only codes and counts are held.
        place = np.argsort(right.column("part").to_numpy(), kind="stable").tolist()
        out: list = [[] for _ in range(7)]
        for row in range(left.num_rows):
            ids, held, lengths, codes, size, words = (left.column(c)[row].as_py() for c in ("doc_ids", "held", "lengths", "codes", "size", "words"))
            grams = grams_of(lengths, codes, words)
            del codes, words
            count, found, totals = np.zeros(size, np.int64), 0, [[np.empty(0, np.int64)] for _ in range(order - 1)]
            for k in place:
                part, n, body = (right.column(c)[k].as_py() for c in ("part", "size", "body"))
                if part < 0:
                    raw = pa.decompress(body, 12 * n, "zstd", asbytes=True)
                    count[np.frombuffer(raw, "<i4", n)] = np.frombuffer(raw, "<i8", n, 4 * n)
                    found += n
                else:
                    totals[part // ranges].append(from_planes(body, n, "<i8"))
            if found != len(count):
                raise ValueError("a block and its words do not fit together")
            single = np.empty(len(grams.ends), np.int64)
            single[~grams.ends], single[grams.ends] = count[grams.codes], train
            more = grams.spread([np.concatenate(t) for t in totals])
            del totals, count
            out[0] += ids
            out[1] += held
            out[2] += (grams.lengths + 1).tolist()
            out[4] += [tokens] * len(ids)
            for columns in judged(grams, single, more, train, whole, mu):
                for c, values in zip((3, 5, 6), columns):
                    out[c] += values.tolist()
        pa.default_memory_pool().release_unused()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = table.select("block", "doc_ids", "held", "lengths", "codes", "size", "words")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCHEMA)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
