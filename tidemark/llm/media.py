"""Media columns (operator 5).

Texts become payloads of bytes, payloads 8-bit grey images 64 samples wide, images PNG files in a binary column. Reading
goes the way back: chunks with their checksums, zlib, numpy unfiltering. Features come from the samples read back: the
image is averaged down to 32 x 32, and the signs of its low-frequency cosine-transform terms against their median make a
64-bit hash. All of it is per row; nothing is shuffled.

Null and empty texts are a payload of 64 zero bytes. Equal texts give equal values, repeated rows a row each. Very long
texts are stored whole, in as many rows of samples as they need. Terms that tie with the median count as not over it.
Columns beside doc_id and text are ignored; an empty table gives an empty table. A damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import documents, texts

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter byte: of none, left and up, that of the least sum of absolute differences."""
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = (rows, left, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in tried])
    # Text packs best unfiltered, so a filter has to win by far.
    cost[0] //= 4
    kind = cost.argmin(0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.choose(kind[:, None], tried)
    return out


def to_png(payload: bytes, level: int = 4, part: int = 1 << 20) -> bytes:
    """An 8-bit grey PNG of ``WIDTH`` samples a row; image data in chunks of at most ``part`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    data = zlib.compress(_filtered(rows).tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))
    return _SIGNATURE + head + b"".join(_chunk(b"IDAT", data[k : k + part]) for k in range(0, len(data), part)) + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, data) of each chunk, its checksum tested."""
    if png[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png) or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"damaged chunk {kind!r}")
        yield kind, data
        at += 12 + n


def _unfilter(kinds: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Samples of filtered rows, one byte a sample. Runs of rows of one kind go together, but for kinds 3 and 4."""
    out = np.empty_like(data)
    above = np.zeros(data.shape[1], np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind, rows = kinds[a], data[a:b]
        if kind == 0:
            out[a:b] = rows
        elif kind == 1:
            np.cumsum(rows, axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            np.cumsum(rows, axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        elif kind in (3, 4):
            for k in range(a, b):
                out[k] = _one_row(kind, data[k].tolist(), above.tolist())
                above = out[k]
        else:
            raise ValueError(f"no filter {kind}")
        above = out[b - 1]
    return out


def _one_row(kind: int, row: list[int], above: list[int]) -> list[int]:
    """Average (3) and nearest-of-three (4) need each sample before the next."""
    left = corner = 0
    for k, (x, up) in enumerate(zip(row, above)):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, up
        row[k] = left
    return row


def from_png(png: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG without interlacing."""
    parts = list(chunks(png))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("no whole PNG")
    width, height, *kind = struct.unpack(">IIBBBBB", parts[0][1])
    if kind != [8, 0, 0, 0, 0]:
        raise ValueError("not 8-bit grey")
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("image data of another size")
    raw = raw.reshape(height, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:])


def _cosines(n: int, keep: int) -> np.ndarray:
    k = np.arange(keep)[:, None]
    return np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))


_SIDE, _KEEP = 32, 8
_BASE = _cosines(_SIDE, _KEEP)


def cosine_hash(rows: np.ndarray) -> str:
    """16 hexadecimal digits: which of the 64 low terms of the cosine transform lie over their median."""
    height = len(rows)
    wide = rows.reshape(height, _SIDE, -1).sum(2, dtype=np.int64)
    at = np.arange(_SIDE) * height // _SIDE
    if height >= _SIDE:
        small = np.add.reduceat(wide, at, axis=0) / np.diff(at, append=height)[:, None]
    else:
        small = wide[at].astype(float)
    low = np.rint((_BASE @ small @ _BASE.T).ravel() * 16)  # whole numbers, so that the order of sums can't turn a bit
    return np.packbits(low > np.median(low)).tobytes().hex()


def media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): digests of the payload read back and of the stored form, and the
    hash; with ``keep_media`` also the file itself as the binary column ``media``."""

    def rows_of(batches):
        for b in batches:
            out: list = [[] for _ in range(8)]
            for text in b.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                payload = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
                png = to_png(payload)
                rows = from_png(png)
                back = rows.tobytes()
                for into, value in zip(out, (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(rows), png if keep_media else b"")):
                    into.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            cols = [pa.array(c, t) for c, t in zip(out, kinds)][: 8 if keep_media else 7]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names[: len(cols)]])

    return texts(docs).mapInArrow(rows_of, SCHEMA + ", media binary" * keep_media)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(documents(spark, sf_dir))
