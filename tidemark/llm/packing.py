"""Best-fit packing (operator 7).

Texts become ids with an end id 0; a longer one is cut into pieces of ``size``, of which the first may be shorter. Whole
pieces are sequences of their own. The others are dealt out to partitions of bounded size, each packed by best-fit
decreasing, and lower bounds from dual feasible functions certify the bins of each partition. A partition that meets its
bound is closed but for its emptiest bin, as each partition's bound rounds up; one with a gap opens all its bins that have
room. What is open is exchanged: it is dealt out to fewer partitions, which rerun best-fit decreasing, until the total
meets the bound over the lengths of all pieces, one partition is left, or a rerun of the same pieces gains no bin, where
the packing before stays. A gap that is left is logged; the bound is a column of the result.

A null or empty text is one piece of the end id alone. Repeated rows are packed each. Columns beside doc_id and text are
ignored. A very long text is cut, whole, into as many pieces as it needs; of equal lengths the order in the partition
decides. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import logging
import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.shared import documents, texts, written

log = logging.getLogger(__name__)

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
PLACED = PIECE + ", bin long, offset long, open boolean"


def pieces_of(docs: DataFrame, size: int, path: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot) of all texts; ``slot`` numbers the pieces of a task."""

    def cut(batches):
        ids_of, slot = bpe.loaded(path).ids, 0
        end = np.zeros(1, "<u4")
        for b in batches:
            out: list = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([ids_of(text.as_py()), end]).astype("<u4", copy=False)
                first = (len(ids) - 1) % size + 1
                starts = [0, *range(first, len(ids), size)]
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for into, value in zip(out, (doc, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), slot)):
                        into.append(value)
                    slot += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return texts(docs).mapInArrow(cut, PIECE)


def bound(lengths: np.ndarray, size: int, counts: np.ndarray | None = None) -> int:
    """A number of bins that no packing goes under: the largest of sums of dual feasible functions. Below a threshold t,
    lengths over size - t count a whole bin and those under t nothing; lengths over size / k count by k + 1 parts.
    ``counts``: how often each length comes, once by default."""
    if not len(lengths):
        return 0
    order = np.argsort(lengths, kind="stable")
    x = lengths.astype(np.int64)[order]
    c = np.ones(len(x), np.int64) if counts is None else counts.astype(np.int64)[order]
    total, number = np.concatenate([[0], np.cumsum(x * c)]), np.concatenate([[0], np.cumsum(c)])
    best = -(-int(total[-1]) // size)
    for t in np.unique(x[x <= size // 2]):
        big = np.searchsorted(x, size - t, "right")
        low = np.searchsorted(x, t, "left")
        best = max(best, int(number[-1] - number[big]) - (-(int(total[big] - total[low])) // size))
    for k in range(1, 20):
        # u(k): whole multiples of size / (k + 1) stay, others round down to a multiple of size / k.
        scaled = x * (k + 1)
        exact = scaled % size == 0
        value = np.where(exact, x * k, scaled // size * size)
        best = max(best, -(-int((value * c).sum()) // (size * k)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and the room left in each bin, by best-fit decreasing. Bins are kept by room left, of
    which there are at most ``size`` values."""
    order = np.argsort(-lengths, kind="stable")
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    room: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, b = size, len(room)
            room.append(size)
        where[k], offset[k] = b, size - r
        room[b] = r = r - n
        by_room[r].append(b)
        if r:
            rooms |= 1 << r
    return where, offset, np.array(room, np.int64)


def packed_once(items: DataFrame, parts: int, size: int, slack: int) -> DataFrame:
    """``items`` in ``parts`` partitions, each packed by itself. ``open``: the bin takes part in the exchange. Of a
    partition whose bins meet its own bound that is the emptiest bin alone, as bounds of partitions round up; of one with
    a gap it is each bin with more than ``slack`` left."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        where, offset, room = best_fit(lengths, size)
        opened = np.full(len(room), False) if len(room) == bound(lengths, size) else room > slack
        opened[room.argmax()] |= room.max() > 0
        more = [pa.array(where), pa.array(offset), pa.array(opened[where])]
        for name, column in zip(("bin", "offset", "open"), more):
            table = table.append_column(name, column)
        return table.select([f.split()[0] for f in PLACED.split(", ")] + ["part"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "slot", F.lit(parts)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(pack, PLACED + ", part long")


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, part_items: int = 50_000, slack: int = 0) -> DataFrame:
    """Each piece of each row of ``docs`` with its sequence and its place there, and ``least_sequences``, the certified
    bound of all: no packing has fewer; see the module's text."""
    items = written(pieces_of(docs, size, path), "pieces")
    whole = items.where(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 60)).withColumn("offset", F.lit(0).cast("long"))
    rest, done = items.where(F.col("length") < size), [whole]
    tally = items.groupBy("length").count().toPandas()  # at most ``size`` rows
    full = tally["length"] == size
    wholes, tally = int(tally["count"][full].sum()), tally[~full]
    certified = bound(tally["length"].to_numpy(), size, tally["count"].to_numpy())
    count, closed, opened, last = int(tally["count"].sum()), 0, None, None
    for k in itertools.count():
        if not count:
            break
        parts = max(1, math.ceil(count / part_items))
        placed = written(packed_once(rest, parts, size, slack), f"packed-{k}")
        numbered = placed.withColumn("sequence_id", (F.lit(k) * (1 << 32) + F.col("part")) * (1 << 24) + F.col("bin"))
        each = placed.groupBy("part", "bin").agg(F.first("open").alias("open"), F.count("*").alias("n"))
        bins, again, count = (int(v or 0) for v in each.agg(F.count("*"), F.sum(F.col("open").cast("long")), F.sum(F.when(F.col("open"), F.col("n")))).first())
        gained = opened is None or bins < opened
        if not gained or parts == 1 or closed + bins <= certified or not again:
            done.append(numbered if gained else last)
            gap = closed + (bins if gained else opened) - certified
            if gap > 0:
                log.warning("%d sequences of pieces, %d over the certified bound of %d", certified + gap, gap, certified)
            break
        done.append(numbered.where(~F.col("open")))
        last = numbered.where(F.col("open"))
        rest = placed.where(F.col("open")).select(*[f.split()[0] for f in PIECE.split(", ")])
        closed, opened = closed + bins - again, again
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done]).withColumn("least_sequences", F.lit(certified + wholes).cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
