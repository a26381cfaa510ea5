import hashlib
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import licences, media
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(text):
    w = WORD.findall((text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def of(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_licences_against_a_plain_scan(spark, sf01_dir, docs01, odd):
    got = QUERIES["op3_licence_scan"](spark, sf01_dir).collect()
    assert len(got) == len(docs01)
    for r in got:
        assert of(r) == plain(docs01[r.doc_id][0])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    key = str
    assert sorted(map(of, licences.licence_scan(odd).collect()), key=key) == sorted((plain(r.text) for r in odd.collect()), key=key)
    assert licences.licence_scan(odd.limit(0)).count() == 0


def ways(expression):
    """All ways to meet an expression, by a plain recursive reading of a well-formed one."""
    tokens = re.findall(r"[()]|[^\s()]+", expression)

    def level(binds):
        if binds == 3:
            if tokens[0] == "(":
                tokens.pop(0)
                out = level(0)
                tokens.pop(0)
            else:
                out = [frozenset([tokens.pop(0).lower().rstrip("+")])]
            return out
        out = level(binds + 1)
        while tokens and tokens[0].lower() == ("or", "and", "with")[binds]:
            tokens.pop(0)
            right = level(binds + 1)
            out = out + right if binds == 0 else [a | b for a in out for b in right] if binds == 1 else out
        return out

    return level(0)


@pytest.mark.parametrize(
    "text",
    ["MIT", "MIT OR Apache-2.0", "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "MIT AND BSD-3-Clause OR ISC", "a OR b AND (c OR d AND (e OR f)) OR g WITH h", " AND ".join(["(a OR b)"] * 7), "(a or (b)) with (c or d)"],
)
def test_expressions(text):
    number, named, _ = licences.evaluate(licences.postfix(text + " . and more (prose)"))
    assert number == len(ways(text)) and named == frozenset().union(*ways(text))


def test_expressions_end_where_they_stop_being_well_formed():
    assert licences.postfix("") is None and licences.postfix("AND MIT") is None and licences.postfix("(MIT") is None
    assert licences.evaluate(licences.postfix("MIT OR ("))[:2] == (1, {"mit"})


def test_as_many_choices_as_there_are(spark):
    many = [" AND ".join(["(a OR b)"] * n) for n in (7, 40, 2000)]
    df = spark.createDataFrame([(k, "x SPDX-License-Identifier: " + t + "\nnext") for k, t in enumerate(many)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licence_scan(df).collect()}
    assert [got[k].n_choices for k in range(3)] == [128.0, 2.0**40, float("inf")]
    assert all(r.labels == "a,b" and r.score == 1.0 for r in got.values())


def plain_findings(text):
    """(labels, score, notices, tags, choices) of a text by regular expressions."""
    t = (text or "").translate(LOW)
    line = " ".join(WORD.findall(t))
    count = lambda phrase: len(re.findall(f"(?<!\\S)(?={re.escape(phrase)}(?!\\S))", line))
    labels, rest, notices, choices = set(), 1.0, 0, 0
    for phrase, label in licences.BASE.items():
        labels |= {label} if count(phrase) else set()
        rest *= 0.1 ** count(phrase)
    for phrase, (label, weight) in licences.NOTICES.items():
        labels |= {label} if count(phrase) else set()
        rest *= (1 - weight) ** count(phrase)
        notices += count(phrase)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for m in re.finditer(rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])spdx{gap}license{gap}identifier(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])[ \t]*:?([^\n]*)", t):
        if whole := re.match(r"[\w.+() -]+", m[1].strip()):
            expression = whole[0].strip()
            labels |= {licences.family(x) for w in ways(expression) for x in w}
            choices, rest = choices + len(ways(expression)), 0.0
    return ",".join(sorted(labels)), 1 - rest, notices, count(licences.TAG), choices


def test_labels_and_score_against_a_plain_version(spark, sf01_dir, docs01, odd):
    own = [
        "SPDX-License-Identifier: MIT OR Apache-2.0\nMIT license", "spdx license\nidentifier GPL-2.0-or-later WITH Classpath-exception-2.0", "CC BY-NC-SA 4.0 and CC0; all rights reserved.",
        "Permission is hereby granted, free of charge, MIT License, mit license", "SPDX-License-Identifier:\tBSD-3-Clause AND ISC\nSPDX-License-Identifier: (MIT)", "creative commons attribution licensed under Boost Software License", None, "",
    ]
    rows = list(enumerate(own)) + [(1000 + i, t) for i, (t, _) in docs01.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text").where("doc_id is null"))
    for r in licences.licence_scan(df).where("doc_id is not null").collect():
        want = plain_findings(dict(rows)[r.doc_id])
        assert (r.labels, r.n_notices, r.n_tags, r.n_choices) == (want[0], *want[2:]), dict(rows)[r.doc_id]
        assert abs(r.score - want[1]) < 1e-9


def test_media_round_trip(spark, sf_dir, odd):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in QUERIES["op5_media"](spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    for r in media.media(odd, keep_media=True).collect():
        assert hashlib.sha256(media.from_png(r.media).tobytes()).hexdigest() == r.payload_sha256
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert media.media(odd.limit(0)).count() == 0


def test_all_filters_are_undone():
    rows = np.random.default_rng(3).integers(0, 256, (40, 64)).astype(np.uint8)
    kinds = np.arange(40) % 5
    above, coded = np.zeros(64, int), np.empty((40, 64), np.uint8)
    for k, row in enumerate(rows.astype(int)):
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kinds[k]]
        coded[k], above = (row - guess) % 256, row
    assert np.array_equal(media._unfilter(kinds, coded), rows)


def test_damage_is_found():
    png = bytearray(media.to_png(bytes(range(64)) * 4))
    png[-20] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_hash_against_a_plain_transform():
    """The signs of the low terms against their median, from sums written out."""
    pick = np.random.default_rng(8)
    for height in (1, 5, 32, 50):
        rows = pick.integers(0, 256, (height, 64)).astype(np.uint8)
        small = np.empty((32, 32))
        for i in range(32):
            a = i * height // 32
            z = ((i + 1) * height // 32 if i < 31 else height) if height >= 32 else a + 1
            for j in range(32):
                small[i, j] = rows[a:z, 2 * j : 2 * j + 2].sum() / (z - a)
        low = [[sum(small[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
        whole = np.rint(np.array(low).ravel() * 16)
        bits = "".join(str(int(x > np.median(whole))) for x in whole)
        assert media.cosine_hash(rows) == f"{int(bits, 2):016x}"


def test_feature_of_the_query_comes_from_the_text(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op5_media"](spark, sf_dir).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r.feature == media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))


def test_hash_of_near_images_is_near():
    x = np.random.default_rng(5).integers(32, 122, 64 * 64).astype(np.uint8)
    y = x.copy()
    y[100] += 1
    bits = lambda h: np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8))
    assert (bits(media.cosine_hash(x.reshape(-1, 64))) != bits(media.cosine_hash(y.reshape(-1, 64)))).sum() <= 4
