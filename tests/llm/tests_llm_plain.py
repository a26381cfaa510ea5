"""Plain versions that several tests use."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import bpe, near_dedup

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_lines(rows):
    keyed = [(i, [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOW)) for x in (t or "").split("\n")]) for i, t in rows]
    owner = {}
    for i, lines in keyed:
        for _, k in lines:
            if i is not None and len(k) >= 10:
                owner[k] = min(i, owner.get(k, i))
    out = []
    for i, lines in keyed:
        kept = [x for x, k in lines if i is None or owner.get(k, i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def check_packing(rows, docs, size):
    """docs: (doc_id, text) of each row."""
    tok = bpe.tokenizer()
    ids = sorted([(i if i is not None else -1, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs])
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id if r.doc_id is not None else -1].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for i, x in ids:
        first = (len(x) - 1) % size + 1
        for k, a in enumerate([0, *range(first, len(x), size)]):
            part = x[a : first if k == 0 else a + size]
            want[i].append((k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    least = -(-sum(len(x) for _, x in ids) // size)
    return len(bins), least


def plain_classes(rows):
    f = near_dedup.Features()
    sets = {i: x for (i, _), x in zip(rows, f.of(pa.array([t for _, t in rows], pa.string()))) if len(x[0])}
    names, parent = sorted(sets), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i in names:
        for x in sets[i][0].tolist():
            holders[x].add(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in sorted(pairs):
        if root(a) != root(b) and near_dedup.similarity(sets[a], sets[b]) >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in rows}
