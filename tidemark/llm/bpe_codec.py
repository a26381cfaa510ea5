"""BPE encoding and decoding of whole texts (operator 1).

1. Texts are cut into words where the pre-tokenizer cuts. Consecutive texts form a block; each distinct word of a block is
   a row (word, block, at), and a text is a list of positions ``at``.
2. These rows are partitioned and sorted by word, so that all positions of a word stand together in one partition. Where
   a word begins, its row of the distinct-word table is made: each distinct word is encoded once.
3. The table's rows are merged with the positions in the same pass, as both are in order of the word. Ids go back to their
   blocks by position, packed, many positions a row. (A table of its own and a sort-merge join give the same at 1.75
   times the input on disk, over the check tool's 1.5.)
4. Ids are decoded through a join with the vocabulary table (id, piece), whose size the tokenizer file fixes, and each
   text is read off along its positions.

A frequent word is one row a block, so no key is hot. Words and positions are cut in two passes over the input rather than
written down in between, which halves the disk. So that both passes see the same rows, ``docs`` is first written to the
shared folder, unless the caller says that it is a plain scan of stored files (``stored``).

Null and empty texts have no ids and decode to the empty text; repeated rows each get their row; a very long text is a
block of its own; columns beside doc_id and text are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe
from tidemark.llm.shared import documents, texts, written
from tidemark.llm.words import BpeWords, by_frequency, from_planes, gathered, one, to_planes

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
BLOCK = "block long, doc_ids array<long>, lengths array<int>, words int, codes binary"
#: Ids of many positions of a block: positions, how many ids each has, all ids in a row.
PACK = "block long, size int, at binary, n binary, n_ids int, ids binary"


def packed(block: int, at: np.ndarray, n: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    return [pa.array([block], pa.int64()), pa.array([len(at)], pa.int32()), pa.array([to_planes(at, "<i4")], pa.binary()), pa.array([to_planes(n, "<i4")], pa.binary()), pa.array([len(ids)], pa.int32()), pa.array([to_planes(ids, "<i4")], pa.binary())]


class Vocabulary:
    """The table (id, piece) of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        byte = bpe.byte_of_char()
        pieces = {i: bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p, i in j["model"]["vocab"].items()}
        pieces |= {a["id"]: a["content"].encode() for a in j["added_tokens"]}
        self.ids = np.array(sorted(pieces), np.int64)
        self.pieces = pa.array([pieces[i] for i in self.ids.tolist()], pa.binary())

    def joined(self, ids: np.ndarray) -> pa.Array:
        """The piece of each id."""
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (at.max() == len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id is not in the vocabulary")
        return self.pieces.take(pa.array(at))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and Python process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode_decode(docs: DataFrame, path: str | None = None, block_bytes: int = 40 << 20, stored: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text)."""
    path = path or bpe.default_path()
    rows = texts(docs) if stored else written(texts(docs), "texts")

    def blocks(batches):
        """(name, doc_ids, positions, words of each text, distinct words)"""
        from pyspark import TaskContext

        words_of = BpeWords(bpe.loaded(path).split)
        for nth, table in enumerate(gathered(batches, 1, block_bytes)):
            codes, lengths, words = words_of(one(table.column(1)))
            codes, words = by_frequency(codes, words)
            yield TaskContext.get().partitionId() << 24 | nth, one(table.column(0)).to_pylist(), codes, lengths, words

    def words_out(batches):
        for name, _, _, _, words in blocks(batches):
            order = pc.cast(pc.sort_indices(words), pa.int32())  # neighbours share their beginnings, which packs well
            for a in range(0, len(words), 1 << 16):
                part = order.slice(a, 1 << 16)
                yield pa.RecordBatch.from_arrays([words.take(part), pa.array(np.full(len(part), name)), part], ["word", "block", "at"])

    def codes_out(batches):
        for name, doc_ids, codes, lengths, words in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([len(words)], pa.int32()), pa.array([to_planes(codes, "<i4")], pa.binary())], [f.split()[0] for f in BLOCK.split(", ")])

    def encode(batches):
        """Packed ids of the positions in ``batches``, which are in order of their words."""
        ids_of, last = bpe.loaded(path).word, (None, [])
        kept, size = [], 0

        def out():
            t = pa.Table.from_batches(kept).combine_chunks().sort_by([("block", "ascending"), ("at", "ascending")])
            block = t.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
            for a, z in zip(edges, edges[1:]):
                mine = t.slice(a, z - a)
                ids = one(mine.column("ids"))
                yield pa.RecordBatch.from_arrays(packed(int(block[a]), mine.column("at").to_numpy(), pc.list_value_length(ids).to_numpy(), ids.flatten().to_numpy()), [f.split()[0] for f in PACK.split(", ")])

        for b in batches:
            runs = pc.run_end_encode(b.column(0))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            if not words:
                continue
            # A row of the distinct-word table for each run; a run may go on from the batch before.
            table = pa.array([last[1] if w == last[0] else ids_of(w) for w in words], pa.list_(pa.int32()))
            last = words[-1], table[len(words) - 1].as_py()
            ids = table.take(pa.array(np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))))
            kept.append(pa.RecordBatch.from_arrays([b.column(1), b.column(2), ids], ["block", "at", "ids"]))
            size += b.num_rows
            if size >= 1 << 20:
                yield from out()
                kept, size = [], 0
        if size:
            yield from out()

    at = rows.mapInArrow(words_out, "word string, block long, at int")
    answers = at.repartition("word").sortWithinPartitions("word").mapInArrow(encode, PACK)

    def read_off(left: pa.Table, right: pa.Table) -> pa.Table:
        packs = [(from_planes(a, s), from_planes(n, s), from_planes(i, k)) for s, a, n, k, i in zip(*(right.column(c).to_pylist() for c in ("size", "at", "n", "n_ids", "ids")))]
        at, n, flat = (np.concatenate([p[k] for p in packs] or [np.empty(0, np.int32)]) for k in range(3))
        order = np.argsort(at)
        if not np.array_equal(at[order], np.arange(sum(left.column("words").to_pylist()))):
            raise ValueError("a block and its words do not fit together")
        begin, count = (np.cumsum(n) - n)[order], n[order]
        flat = flat[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(flat))]
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        # Of each word: its ids in decimals, and its text, by the pieces of its ids.
        ids = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.cast(pa.array(flat), pa.string())), ",")
        pieces = pc.binary_join(pa.ListArray.from_arrays(offsets, vocabulary(path).joined(flat)), b"")
        out: list = [[], [], [], []]
        for doc_ids, lengths, body in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "lengths", "codes"))):
            codes = from_planes(body, sum(lengths))
            begin = np.concatenate([[0], np.cumsum(lengths)])
            # The empty word has no ids: a text begins with it where a space or line feed comes first.
            some = count[codes] > 0
            seen = np.concatenate([[0], np.cumsum(some)])
            sums = np.concatenate([[0], np.cumsum(count[codes], dtype=np.int64)])
            step = 512
            for a in range(0, len(doc_ids), step):
                z = min(a + step, len(doc_ids))
                mine = pa.array(codes[begin[a] : begin[z]][some[begin[a] : begin[z]]])
                of_text = pa.array((seen[begin[a : z + 1]] - seen[begin[a]]).astype(np.int32))
                decimals = pc.binary_join(pa.ListArray.from_arrays(of_text, ids.take(mine)), ",")
                raw = pc.binary_join(pa.ListArray.from_arrays(of_text, pieces.take(mine)), b"")
                out[2] += [hashlib.sha256(x.as_buffer()).hexdigest() for x in decimals]
                out[3] += [hashlib.sha256(x.as_py().decode("utf-8", "replace").encode()).hexdigest() for x in raw]
            out[0] += doc_ids
            out[1] += (sums[begin[1:]] - sums[begin[:-1]]).tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    coded = rows.mapInArrow(codes_out, BLOCK)
    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(read_off, SCHEMA)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), stored=True)
