"""Alignment of two tokenizers (operator 11): byte-level BPE (A) and SentencePiece (B).

Texts are cut into chunks at single spaces between other characters, where both tokenizers cut too: B because no piece of
its vocabulary goes on behind a letter over a space. Each distinct chunk of a block of texts is encoded once by both.
Byte-owner arrays align them: token numbers repeated over their bytes for A and for B. Where the pair of owners changes, an
overlap begins; where both change at once, both cut, and a group ends. A group links all its A tokens to all its B tokens.

The links of a chunk are pairs of ids with how often they occur. A block counts for each pair how many of its documents
hold it; Spark sums these over the blocks, takes the highest count of each A id, and joins both back to the blocks, which
add them up over the chunks of each document. A block names a pair once, so frequent pairs are no hot keys.

A text whose tokens don't join to a space and the text has no tokens; null and empty texts have none. Such texts are found
by their chunks: where a chunk's tokens don't join to it, the whole text is encoded by itself and decides. Repeated rows
count as documents of their own. A very long text is a block of its own, and one without cuts is one chunk: its links are
counted by distinct ids and never listed pair by pair. Columns beside doc_id and text are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm import bpe
from tidemark.llm.shared import documents, texts, written
from tidemark.llm.words import BpeWords, from_planes, gathered, one, to_planes

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"
#: Spaces where both tokenizers cut: alone, and not beside a sign that some engine takes for white space.
_CUT = re.compile(rf"(?<=[^\s{bpe._ODD}]) (?=[^\s{bpe._ODD}])")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TokenizerA:
    """Ids and bytes of byte-level BPE. Strings of special tokens are plain text."""

    def __init__(self, path: str | None):
        self.bpe = bpe.Bpe(path)
        self.bpe.tok.encode_special_tokens = True
        back = bpe.byte_of_char()
        of = {k: bytes(back[c] for c in v) if all(c in back for c in v) else v.encode() for v, k in self.bpe.tok.get_vocab(with_added_tokens=True).items()}
        self.of = [of.get(k, b"") for k in range(max(of) + 1)]
        self.table = _table(self.of)

    def ids(self, chunks: list[str]) -> list[list[int]]:
        fast, sure = self.bpe.fast, bpe._SURE.fullmatch
        # One by one: the engine's own batches hand each text to a thread.
        out = [fast.encode_ordinary(t) if fast is not None and (t.isascii() or sure(t)) else None for t in chunks]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.bpe.tok.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False) if rest else []):
            out[k] = e.ids
        return out


class TokenizerB:
    """Ids and bytes of SentencePiece, which puts a space before what it encodes."""

    def __init__(self, path: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or piece_path())
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.table = _table(self.of)
        self.space = self.model.piece_to_id("▁")
        closed = not any(re.search("[^▁]▁", p) or "\n" in p for p in pieces)
        probes = ("a b", "one two", "Some words\nhere", "the quick, Brown")
        self.safe = closed and all(self.model.encode(x) == [i for c in re.split("(?= )", f" {x}")[1:] for i in self.model.encode(c[1:])] for x in probes)

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """For chunks that begin with a space, or with a line feed behind something else."""
        found = self.model.encode([c[1:] if c[:1] == " " else c for c in chunks], num_threads=1)
        return [x if c[:1] == " " else x[1:] if x[:1] == [self.space] else [] for c, x in zip(chunks, found)]


class Chunks:
    """Cuts texts with a space before them into chunks that both tokenizers encode by themselves."""

    specials = ()

    def __init__(self, safe: bool):
        self.safe = safe

    def careful(self, text: str) -> list[str]:
        at = [m.start() for m in _CUT.finditer(text)] if self.safe else []
        return [text[a:z] for a, z in zip([0, *at], [*at, len(text)])]


@lru_cache(4)
def tokenizers(a: str | None, b: str | None) -> tuple[TokenizerA, TokenizerB]:
    """One pair for each pair of files and Python process."""
    return TokenizerA(a), TokenizerB(b)


class Tokens:
    """Ids of many chunks one behind another, with their bytes: ``at`` tells where each chunk's bytes begin."""

    def __init__(self, ids: list[list[int]], table: tuple[np.ndarray, np.ndarray]):
        all_bytes, offsets = table
        self.ids = np.array(list(chain.from_iterable(ids)), np.int64)
        self.lengths = offsets[self.ids + 1] - offsets[self.ids]
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = all_bytes[np.arange(ends[-1]) + np.repeat(offsets[self.ids] - ends[:-1], self.lengths)]
        self.at = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])]

    def differ(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a chunk's bytes are others than ``raw`` has for it."""
        if len(self.bytes) == len(raw) and np.array_equal(self.at, at) and np.array_equal(self.bytes, raw):
            return np.zeros(len(at) - 1, bool)
        same = [np.array_equal(self.bytes[p:q], raw[r:s]) for p, q, r, s in zip(self.at, self.at[1:], at, at[1:])]
        return ~np.array(same, bool)


def _table(of: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids of a vocabulary, and where each begins."""
    return np.frombuffer(b"".join(of), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in of])])


def _lists(values: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Consecutive strings, so many for each list, joined."""
    import pyarrow.compute as pc

    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(by, pa.large_string()))


class Aligned:
    """Tokens of chunks by both tokenizers, their groups, overlaps and links. Chunks whose tokens don't join to them are
    not ``fine`` and have no tokens here."""

    def __init__(self, chunks: list[str], a: TokenizerA, b: TokenizerB):
        ids_a, ids_b = a.ids(chunks), b.ids(chunks)
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        x, y, raw = Tokens(ids_a, a.table), Tokens(ids_b, b.table), np.frombuffer(b"".join(raw), np.uint8)
        self.fine = ~(x.differ(raw, at) | y.differ(raw, at))
        if not self.fine.all():
            for k in np.flatnonzero(~self.fine).tolist():
                ids_a[k], ids_b[k] = [], []
            x, y = Tokens(ids_a, a.table), Tokens(ids_b, b.table)
        flat_a, len_a, bytes_a, at_a, flat_b, len_b = x.ids, x.lengths, x.bytes, x.at, y.ids, y.lengths
        self.a, self.b, self.n_bytes = flat_a, flat_b, len(bytes_a)
        owner_a, owner_b = np.repeat(np.arange(len(flat_a)), len_a), np.repeat(np.arange(len(flat_b)), len_b)
        new_a, new_b = (np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool) for x in (owner_a, owner_b))
        begins = np.flatnonzero(new_a & new_b)
        overlaps = np.flatnonzero(new_a | new_b)
        #: Overlapping (A token, B token) by number, and the first byte of each overlap.
        self.overlaps = np.stack([owner_a[overlaps], owner_b[overlaps], overlaps], 1)
        self.group_start = begins
        self.group_a = np.cumsum(new_a & new_b)[np.flatnonzero(new_a)] - 1
        self.group_b = np.cumsum(new_a & new_b)[np.flatnonzero(new_b)] - 1
        #: The chunk of each group: chunks always begin a group.
        self.chunk = np.searchsorted(at_a, begins, "right") - 1
        n = len(chunks)
        self.n_groups = np.bincount(self.chunk, minlength=n)
        self.n_overlaps = np.bincount(np.searchsorted(at_a, overlaps, "right") - 1, minlength=n)
        self.n_a, self.n_b = np.bincount(self.chunk[self.group_a], minlength=n), np.bincount(self.chunk[self.group_b], minlength=n)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, A id, B id, how often the chunk links them), sorted by the first three."""
        keys_a, times_a = np.unique(self.group_a << 20 | self.a, return_counts=True)
        keys_b, times_b = np.unique(self.group_b << 20 | self.b, return_counts=True)
        size_b = np.bincount(keys_b >> 20, minlength=len(self.chunk))
        first_b = np.concatenate([[0], np.cumsum(size_b)])
        many = size_b[keys_a >> 20]
        left = np.repeat(np.arange(len(keys_a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_b[keys_a >> 20], many)
        low = (1 << 20) - 1
        chunk, a, b, times = self.chunk[keys_a[left] >> 20], keys_a[left] & low, keys_b[right] & low, times_a[left] * times_b[right]
        order = np.lexsort((b, a, chunk))
        chunk, a, b, times = chunk[order], a[order], b[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(chunk) else np.empty(0, np.int64)
        return chunk[first], a[first], b[first], np.add.reduceat(times, first) if len(first) else times

    def strings(self) -> pa.Array:
        """The groups of each chunk as ``a1,a2|b1;a3|b2,b3``."""
        import pyarrow.compute as pc

        n = len(self.chunk)
        sides = (_lists(pc.cast(pa.array(ids), pa.large_string()), np.bincount(of, minlength=n), ",") for ids, of in ((self.a, self.group_a), (self.b, self.group_b)))
        return _lists(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), self.n_groups, ";")


class Sums:
    """What Aligned finds in chunks, found some chunks at a time: counts by chunk, links and group strings, without tokens,
    owners and overlaps."""

    def __init__(self, chunks: list[str], a: TokenizerA, b: TokenizerB, size: int = 1 << 17):
        self.found, self.texts, kept = [], [], []
        for part in _slices(np.fromiter(map(len, chunks), np.int64, len(chunks)), size):
            x = Aligned(chunks[part], a, b)
            chunk, *link = x.links()
            self.found.append([c.astype(np.int32) for c in (chunk + part.start, *link[:2])] + [link[2]])
            self.texts.append(x.strings())
            kept.append((x.fine, x.n_groups, x.n_overlaps, x.n_a, x.n_b))
            del x, chunk, link
        empty = [(np.empty(0, bool), *[np.empty(0, np.int64)] * 4)]
        self.fine, self.n_groups, self.n_overlaps, self.n_a, self.n_b = (np.concatenate(c) for c in zip(*(kept or empty)))

    def links(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return (*[np.empty(0, np.int32)] * 3, np.empty(0, np.int64))
        return tuple(np.concatenate(c) for c in zip(*self.found))

    def strings(self) -> pa.Array:
        return pa.concat_arrays(self.texts) if self.texts else pa.array([], pa.large_string())


def _slices(sizes: np.ndarray, most: int):
    """Consecutive slices whose sizes add up to about ``most``, one item at least."""
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
        yield slice(k, z)
        k = z


class Block:
    """Texts cut into chunks: ``chunks`` distinct ones, ``codes`` of all, ``lengths`` by text; and what ``of`` (Aligned or
    Sums) finds in them."""

    def __init__(self, column: pa.Array, a: TokenizerA, b: TokenizerB, of: type = Aligned):
        import pyarrow.compute as pc

        filled = pc.fill_null(column, "")
        empty = pc.equal(filled, "").to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise("", filled, " ")
        if b.safe:
            codes, lengths, words = BpeWords(Chunks(True))(spaced)
        else:
            coded = pc.dictionary_encode(spaced)
            codes, lengths, words = coded.indices.to_numpy(zero_copy_only=False), np.ones(len(column), np.int64), coded.dictionary
        chunks = words.to_pylist()
        row = np.repeat(np.arange(len(column)), lengths)
        keep = np.array([c != "" for c in chunks] or [True])[codes] & ~empty[row]
        row, codes = row[keep], codes[keep].astype(np.int64)
        self.aligned = of(chunks, a, b)
        # Texts with a chunk that doesn't fit are encoded whole.
        odd = np.unique(row[~self.aligned.fine[codes]])
        if len(odd):
            whole = [" " + filled[int(k)].as_py() for k in odd]
            keep = ~np.isin(row, odd)
            row, codes = np.concatenate([row[keep], odd]), np.concatenate([codes[keep], len(chunks) + np.arange(len(odd))])
            self.aligned = of(chunks + whole, a, b)
            keep = self.aligned.fine[codes]
            row, codes = row[keep], codes[keep]
            order = np.argsort(row, kind="stable")
            row, codes = row[order], codes[order]
        self.codes, self.lengths = codes, np.bincount(row, minlength=len(column))
        self.row, self.start = row, np.concatenate([[0], np.cumsum(self.lengths)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """``values`` of the chunks added up by text."""
        total = np.concatenate([[0], np.cumsum(values[self.codes])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def digests(self) -> list[str]:
        strings, out = self.aligned.strings(), []
        for part in _slices(self.lengths, 1 << 16):
            whole = _lists(strings.take(pa.array(self.codes[self.start[part.start] : self.start[part.stop]])), self.lengths[part], ";")
            out += [hashlib.sha256(x.as_py().encode()).hexdigest() if n else "" for x, n in zip(whole, self.lengths[part].tolist())]
        return out


STORED = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("n_links", pa.int32()), ("n_pairs", pa.int32()), ("n_chunks", pa.int32()),
    ("sizes", pa.binary()), ("numbers", pa.binary()), ("times", pa.binary()), ("pair_a", pa.binary()), ("pair_b", pa.binary()), ("pair_docs", pa.binary()),
    *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_overlaps")), ("groups_sha256", pa.list_(pa.string())),
])
OUT = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in SCHEMA.split(", ")])
GROUPS = pa.schema([("doc_id", pa.int64()), ("nth", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def groups(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """The groups of each text: (doc_id, nth, start, end, a, b), bytes counted in a space and the text, ids of both."""

    def find(batches):
        for block in gathered(batches, 1, block_bytes):
            ids, found = block.column(0).to_pylist(), Block(one(block.column(1)), *tokenizers(a, b))
            x = found.aligned
            of_a, of_b = (np.searchsorted(y, np.arange(len(x.chunk) + 1)) for y in (x.group_a, x.group_b))
            edges, size = np.concatenate([[0], np.cumsum(x.n_groups)]), np.diff(np.append(x.group_start, x.n_bytes))
            for k, doc_id in enumerate(ids):
                rows, at, nth = [], 0, 0
                for c in found.codes[found.start[k] : found.start[k + 1]].tolist():
                    for g in range(edges[c], edges[c + 1]):
                        rows.append((doc_id, nth, at, at + int(size[g]), x.a[of_a[g] : of_a[g + 1]], x.b[of_b[g] : of_b[g + 1]]))
                        at, nth = at + int(size[g]), nth + 1
                for p in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[p : p + (1 << 14)]), GROUPS.types)], GROUPS.names)

    return texts(docs).mapInArrow(find, from_arrow_schema(GROUPS))


def documents_of_pairs(found: Block, sizes: np.ndarray, number: np.ndarray, pairs: int) -> np.ndarray:
    """How many documents of a block hold each pair, some documents at a time. ``sizes``: links of each chunk, ``number``:
    the pair of each link."""
    count, first = np.zeros(pairs, np.int64), np.cumsum(sizes) - sizes
    total = np.concatenate([[0], np.cumsum(sizes[found.codes])])
    for part in _slices(np.diff(total[found.start]), 1 << 18):
        own = slice(found.start[part.start], found.start[part.stop])
        # Distinct chunks of a document, then distinct pairs.
        seen = np.unique(found.row[own] * len(sizes) + found.codes[own])
        of = seen % max(len(sizes), 1)
        many = sizes[of]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[of], many)
        held = np.unique(np.repeat(seen // max(len(sizes), 1), many) * pairs + number[at])
        count += np.bincount(held % max(pairs, 1), minlength=pairs)
    return count


def blocks(docs: DataFrame, a: str | None, b: str | None, block_bytes: int) -> DataFrame:
    """Blocks of texts, aligned: what of a text needs no counts of all texts, and its links as pairs of the block."""

    def read(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for nth, block in enumerate(gathered(batches, 1, block_bytes)):
            found = Block(one(block.column(1)), *tokenizers(a, b), Sums)
            x = found.aligned
            chunk, link_a, link_b, times = x.links()
            pairs, number = np.unique(link_a.astype(np.int64) << 20 | link_b, return_inverse=True)
            del link_a, link_b
            sizes = np.bincount(chunk, minlength=len(x.fine))
            count = documents_of_pairs(found, sizes, number, len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((
                part << 24 | nth, block.column(0).to_pylist(), found.lengths, to_planes(found.codes, "<i4"), len(chunk), len(pairs), len(x.fine), to_planes(sizes, "<i4"),
                to_planes(number, "<i4"), to_planes(times, "<i8"), to_planes(pairs >> 20, "<i4"), to_planes(pairs & 0xFFFFF, "<i4"), to_planes(count, "<i4"),
                *(found.sums(v) for v in (x.n_a, x.n_b, x.n_groups, x.n_overlaps)), found.digests(),
            ), STORED.types)], STORED.names)
            del found, x, chunk, times, pairs, number, count
            pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(read, from_arrow_schema(STORED))


def pair_rows(table: DataFrame) -> DataFrame:
    """(block, at, a, b, n): the distinct pairs of each block, and how many of its documents hold them."""

    def out(batches):
        for batch in batches:
            for block, n, a, b, docs in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, docs = (from_planes(x, n) for x in (a, b, docs))
                for k in range(0, n, 1 << 16):
                    part = slice(k, min(n, k + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.stop - k, block)), pa.array(np.arange(k, part.stop, dtype=np.int32)), pa.array(a[part]), pa.array(b[part]), pa.array(docs[part].astype(np.int64))], ["block", "at", "a", "b", "n"])

    return table.select("block", "n_pairs", "pair_a", "pair_b", "pair_docs").mapInArrow(out, "block long, at int, a int, b int, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that link two ids, and whether none links its A id to another more often."""
    count = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return count.join(count.groupBy("a").agg(F.max("count").alias("top")), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), columns as in ``SCHEMA``. ``a`` and ``b`` are the tokenizers' files."""
    table = written(blocks(docs, a, b, block_bytes), "aligned")
    pairs = pair_rows(table)
    known = written(pair_counts(pairs), "pairs")
    back = pairs.drop("n").join(known.hint("merge"), ["a", "b"]).select("block", "at", "count", "best")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("at").to_numpy())
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        parts = []
        for row in left.to_pylist():
            if len(count) != row["n_pairs"]:
                raise ValueError("a block and its pairs do not fit together")
            lengths = np.array(row["lengths"], np.int64)
            codes = from_planes(row["codes"], int(lengths.sum()))
            sizes, numbers, times = from_planes(row["sizes"], row["n_chunks"]), from_planes(row["numbers"], row["n_links"]), from_planes(row["times"], row["n_links"], "<i8")
            edges = np.concatenate([[0], np.cumsum(sizes)])
            start = np.concatenate([[0], np.cumsum(lengths)])

            def by_text(values: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(values)])
                chunk = total[edges[1:]] - total[edges[:-1]]
                total = np.concatenate([[0], np.cumsum(chunk[codes])])
                return total[start[1:]] - total[start[:-1]]

            columns = (row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], by_text(times), by_text(times * best[numbers]), by_text(times * count[numbers]), row["groups_sha256"], row["n_overlaps"])
            parts.append(pa.table([pa.array(c, t) for c, t in zip(columns, OUT.types)], OUT.names))
        return pa.concat_tables(parts) if parts else OUT.empty_table()

    left = table.select("block", "doc_ids", "lengths", "codes", "n_links", "n_pairs", "n_chunks", "sizes", "numbers", "times", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256")
    return left.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(add_up, SCHEMA)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(documents(spark, sf_dir))
