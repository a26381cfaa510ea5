"""Token counts of whole texts (operator 2).

Arrow functions encode batches of pieces and return lengths only. A text of over ``piece_bytes`` is cut into pieces at
safe boundaries, where the encodings of the pieces join to the text's; consecutive pieces form batches of about
``batch_bytes``, each encoded in one call; the lengths of a text's pieces are added up, so neither a long text nor a run of
long texts makes a batch large, and no text's ids are ever held together. Nothing is shuffled: the reader deals out splits
of equal bytes.

Null and empty texts have 0 bytes and 0 tokens; repeated rows and ties each get their row; columns beside doc_id and text
are ignored; an empty table gives an empty table. A very long text without any safe boundary is one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe
from tidemark.llm.shared import documents, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A single space between two ASCII letters.
_SPACE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class PieceCounter:
    """Tokens of texts through a SentencePiece model. Where no piece of its vocabulary goes on behind a letter over a
    space, and a text's start counts as a space, a single space between two letters is a safe boundary: the space goes,
    as the next piece's start stands for it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        closed = not any(re.search("[A-Za-z]\u2581", p) for p in pieces)
        probes = ("a b", "one two", "Some words", "the quick Brown")
        self.safe = closed and all(self.model.encode(x) == [i for w in x.split(" ") for i in self.model.encode(w)] for x in probes)

    def cut(self, text: str, most: int) -> list[str]:
        if len(text) <= most or not self.safe:
            return [text]
        out, start = [], 0
        while len(text) - start > most and (m := _SPACE.search(text, start + most)):
            out.append(text[start : m.start()])
            start = m.end()
        return [*out, text[start:]]

    def lengths(self, batch: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(batch, num_threads=1)]


class BpeCounter:
    def __init__(self, path: str):
        self.bpe = bpe.loaded(path)

    def cut(self, text: str, most: int) -> list[str]:
        """Pieces between added special tokens, and of long ones pieces between two letters."""
        return [p for part in self.bpe.parts(text) for p in bpe.cut_long(part, most)]

    def lengths(self, batch: list[str]) -> list[int]:
        return self.bpe.lengths(batch)


_COUNTERS: dict = {}


def counter(path: str):
    """One counter for each file and Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path) if path.endswith(".model") else BpeCounter(path)
    return _COUNTERS[path]


def batches_of(pieces: Iterable[tuple[int, str]], most: int) -> Iterator[tuple[list[int], list[str]]]:
    """Consecutive (row, piece) pairs, in lists of about ``most`` bytes of UTF-8."""
    rows, kept, size = [], [], 0
    for row, piece in pieces:
        rows.append(row)
        kept.append(piece)
        size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
        if size >= most:
            yield rows, kept
            rows, kept, size = [], [], 0
    if kept:
        yield rows, kept


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, batch_bytes: int = 1 << 20, piece_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text)."""

    def count(batches):
        c = counter(path or bpe.default_path())
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            pieces = ((row, p) for row, t in enumerate(b.column(1)) for p in c.cut(t.as_py(), piece_bytes))
            for rows, batch in batches_of(pieces, batch_bytes):
                np.add.at(n, rows, c.lengths(batch))
            size = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
