"""Words of many texts at once, as numbers into the list of their distinct words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.bpe import Splitter


def gathered(batches, column: int, most: int):
    """Consecutive record batches joined to tables with about ``most`` bytes in a string column; no row is cut."""
    kept, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            kept.append(part)
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if size >= most:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def to_planes(values: np.ndarray, kind: str | None = None) -> bytes:
    """Whole numbers as compressed bytes, first all lowest bytes, then all next ones."""
    x = np.ascontiguousarray(values, kind or ("<i4" if values.dtype.kind == "i" and values.dtype.itemsize <= 4 else None))
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def from_planes(data: bytes, size: int, kind: str = "<i4") -> np.ndarray:
    """The ``size`` numbers of a kind that ``to_planes`` made ``data`` of."""
    wide = np.dtype(kind).itemsize
    raw = pa.decompress(data, wide * size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, size).T).view(kind).ravel()


def to_packed(words: pa.Array) -> bytes:
    """A string array as compressed bytes."""
    sink = pa.BufferOutputStream()
    table = pa.table({"word": words})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_packed(data: bytes) -> pa.Array:
    return one(pa.ipc.open_stream(data).read_all().column("word"))


def by_frequency(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Positions and words once more, the most frequent words first, so that positions are small numbers."""
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[codes], words.take(pa.array(order))


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    out = np.empty(len(words), np.uint64)
    for k in range(0, len(words), 1 << 16):
        part = words.slice(k, 1 << 16)
        out[k : k + len(part)] = np.fromiter(map(xxhash.xxh3_64_intdigest, part.to_pylist()), np.uint64, len(part))
    return out


def by_block(batches, rows: int = 1 << 20):
    """(block, columns of its rows as arrays), for the first column of record batches, gathered over about ``rows`` rows."""
    kept, size = [], 0

    def groups():
        columns = [np.concatenate(c) for c in zip(*kept)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        edges = np.flatnonzero(np.concatenate([[True], np.diff(columns[0]) != 0, [True]]))
        for a, z in zip(edges, edges[1:]):
            yield int(columns[0][a]), [c[a:z] for c in columns]

    for b in batches:
        if b.num_rows:
            kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
        if size >= rows:
            yield from groups()
            kept, size = [], 0
    if kept:
        yield from groups()


def one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list array without nulls."""
    return values.offsets.to_numpy(), values.values


def white_space_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(numbers, words of each text, distinct words): runs without ASCII white space, A-Z in lower case. Null texts have
    no words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets, values = _lists(parts)
    some = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
    seen = np.concatenate([[0], np.cumsum(some)])
    coded = pc.dictionary_encode(values.filter(pa.array(some)))
    return coded.indices.to_numpy(zero_copy_only=False), np.diff(seen[offsets]), coded.dictionary


class BpeWords:
    """Cuts texts into words that encode by themselves; the cheap way at single spaces, the careful way elsewhere."""

    def __init__(self, split: Splitter):
        self.split = split
        # Texts that need care: two white-space characters in a row, a sign that some engines take for white space, NUL.
        care = r"[ \n]{2}|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
        self.care = "|".join([care, *map(re.escape, split.specials)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(numbers, words of each text, distinct words) of a string array without nulls."""
        slow = pc.match_substring_regex(texts, self.care).to_numpy(zero_copy_only=False)
        marked = pc.binary_join_element_wise(pa.scalar("\0"), pc.if_else(pa.array(slow), "", texts), "")
        offsets, values = _lists(pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " "))
        coded = pc.dictionary_encode(values)
        # A part stands for itself behind the mark of a text's start or before a line feed, else for a space and itself.
        kind = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        words = pc.if_else(pc.equal(kind, "\0"), pc.utf8_slice_codeunits(coded.dictionary, 1), pc.if_else(pc.equal(kind, "\n"), coded.dictionary, pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, "")))
        numbers, lengths = coded.indices.to_numpy(zero_copy_only=False), np.diff(offsets)
        if slow.any():
            units = [self.split.careful(t) for t in texts.filter(pa.array(slow)).to_pylist()]
            more = pc.dictionary_encode(pa.array([u for x in units for u in x], pa.string()))
            at, keep = np.flatnonzero(slow), np.repeat(~slow, lengths)
            begin = np.concatenate([[0], np.cumsum(lengths * ~slow)])[at]
            lengths = lengths.copy()
            lengths[at] = [len(x) for x in units]
            numbers = np.insert(numbers[keep].astype(np.int64), np.repeat(begin, lengths[at]), more.indices.to_numpy(zero_copy_only=False) + len(words))
            words = pa.concat_arrays([words, more.dictionary])
        coded = pc.dictionary_encode(words)  # the empty word, and words that both ways know
        return coded.indices.to_numpy(zero_copy_only=False)[numbers], lengths, coded.dictionary
