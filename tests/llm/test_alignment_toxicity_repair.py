"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import alignment, bpe, conversation_repair, toxicity

STRANGE = [
    None, "", " ", "a", "  a b", "a ", "a\n", "\nWord x\n\ny", "x▁y and more", " a <|endoftext|> b<s> <0x0A>", "中文 x don't  y", "x" * 5000, "½ ²  ",
    "été Übung über", "a\x00b c", "tab\there and 　 wide", " lead", "a b " * 3000, "x▁y", "ok words here", "!!! ... (a) [b]", "café \U0001f600\U0001f468‍\U0001f469 done",
    "﻿ab cd", "a᠎b ​ c", "a \x1c b\x85 c",
]


def by_id(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def plain_alignments(rows):
    """Whole texts through both libraries, every pair of a group listed."""
    import public_tokenizers
    import sentencepiece

    t = bpe.tokenizer()
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back, of = bpe.byte_of_char(), {v: k for k, v in t.get_vocab().items()}
    found, docs = [], collections.Counter()
    for doc_id, text in rows:
        text = text or ""
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        bytes_a = [bytes(back[c] for c in of[i]) for i in a]
        bytes_b = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc_id, 0, 0, []))
            continue
        cuts = set(np.cumsum([*map(len, bytes_a)]).tolist()) & set(np.cumsum([*map(len, bytes_b)]).tolist())

        def grouped(ids, parts):
            out, at = [[]], 0
            for i, part in zip(ids, parts):
                out[-1].append(i)
                at += len(part)
                if at in cuts:
                    out.append([])
            return out[:-1]

        groups = list(zip(grouped(a, bytes_a), grouped(b, bytes_b)))
        docs.update({(p, q) for u, v in groups for p in u for q in v})
        found.append((doc_id, len(a), len(b), groups))
    top = collections.Counter()
    for (p, _), n in docs.items():
        top[p] = max(top[p], n)
    out = []
    for doc_id, n_a, n_b, groups in found:
        links = [(p, q) for u, v in groups for p in u for q in v]
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(docs[x] == top[x[0]] for x in links), sum(docs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=by_id)


def test_alignments_of_all_documents(spark, sf_dir):
    got = alignment.op11_token_alignment(spark, sf_dir).drop("n_overlaps").collect()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(map(tuple, got), key=by_id) == plain_alignments(rows)


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_alignments_of_strange_texts(spark, block):
    rows = [*enumerate(STRANGE), (3, "a"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, a int")
    got = alignment.alignments(df, block_bytes=block).drop("n_overlaps").collect()
    assert sorted(map(tuple, got), key=by_id) == plain_alignments(rows)
    assert alignment.alignments(df.limit(0)).count() == 0


def test_groups_cover_the_bytes(spark):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(STRANGE)], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in alignment.groups(df).orderBy("doc_id", "nth").collect():
        got[r.doc_id].append(r)
    assert not {0, 1, 8, 18} & set(got)
    for doc_id, groups in got.items():
        assert [r.start for r in groups] == [0, *(r.end for r in groups[:-1])]
        assert groups[-1].end == len(STRANGE[doc_id].encode()) + 1
        assert [i for r in groups for i in r.b] == m.encode(STRANGE[doc_id])


def test_chunks_aligned_some_at_a_time():
    """A block's chunks give the same by parts, and its documents the same counts, without all tokens at once."""
    a, b = alignment.tokenizers(None, None)
    chunks = [f" word{k} unbelievable{k * k}" for k in range(300)] + [" Straßenbahn" * 40, " naïveté"]
    whole, parts = alignment.Aligned(chunks, a, b), alignment.Sums(chunks, a, b, 64)
    assert len(parts.found) > 100
    for x, y in zip(whole.links(), parts.links()):
        assert np.array_equal(x, y)
    assert whole.strings().to_pylist() == parts.strings().to_pylist()
    for name in ("fine", "n_a", "n_b", "n_groups", "n_overlaps"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name))
    texts = pa.array(["one two two", None, "", "two three", "one  two\nthree", "two three"])
    found = alignment.Block(texts, a, b, alignment.Sums)
    assert found.digests() == alignment.Block(texts, a, b).digests()
    chunk, link_a, link_b, _ = found.aligned.links()
    pairs, number = np.unique(link_a.astype(np.int64) << 20 | link_b, return_inverse=True)
    count = alignment.documents_of_pairs(found, np.bincount(chunk, minlength=len(found.aligned.fine)), number, len(pairs))
    held = [{p for c in found.codes[found.start[k] : found.start[k + 1]] for p in number[chunk == c].tolist()} for k in range(len(texts))]
    assert count.tolist() == [sum(p in h for h in held) for p in range(len(pairs))]


def test_overlaps_are_all_pairs_that_share_a_byte():
    a, b = alignment.tokenizers(None, None)
    found = alignment.Aligned([" unbelievable", " Straßenbahn", " naïveté"], a, b)

    def spans(ids, of):
        ends = np.cumsum([len(of[i]) for i in ids]).tolist()
        return list(zip([0, *ends], ends))

    x, y = spans(found.a, a.of), spans(found.b, b.of)
    want = {(i, j, max(p, r)) for i, (p, q) in enumerate(x) for j, (r, s) in enumerate(y) if max(p, r) < min(q, s)}
    assert set(map(tuple, found.overlaps.tolist())) == want


def plain_ftrl(rows, epochs, alpha=2.0, beta=1.0, l1=1.5, l2=0.01):
    """FTRL-proximal over dictionaries, one coordinate at a time; rows: ({coordinate: value}, label)."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        a, b = (0, 0) if k == "bias" else (l1, l2)
        return 0.0 if abs(z[k]) <= a else -(z[k] - math.copysign(a, z[k])) / ((beta + math.sqrt(n[k])) / alpha + b)

    for _ in range(epochs):
        for x, label in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z) if weight(k)}


def plain_features(text, bits):
    import xxhash

    out, M = collections.Counter(), (1 << 64) - 1
    words = re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text.lower()).split(" ")
    words = [w for w in words if w]
    h = [xxhash.xxh3_64_intdigest(w, 1) for w in words]
    found = list(h)
    for gap, salt in ((1, 0x4D), (2, 0x3DF)):
        found += [(((a * 0x9E3779B97F4A7C15 + b) & M) ^ salt) * (2 * gap - 1) & M for a, b in zip(h, h[gap:])]
    found += [xxhash.xxh3_64_intdigest(w[:n], 10 + n) for w in words for n in toxicity.PREFIXES if len(w) > n]
    out.update((x * 0xD6E8FEB86659FD93 & M) >> (64 - bits) for x in found)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {k: v * 8 / norm for k, v in out.items()} | {"bias": 1.0}


def test_features_and_learning_equal_the_plain_ones():
    import pyarrow as pa

    rnd = random.Random(3)
    words = ["good", "awful", "thing", "people", "really", "trash", "übel", "so-so", "Nice,", "x"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(12))) for _ in range(60)]
    labels = [int("trash" in t) for t in texts]
    start, at, x = toxicity.Features(12)(pa.array(texts))
    model = toxicity.Ftrl(1 << 12)
    for _ in range(3):
        for k, y in enumerate(labels):
            model.learn(np.append(at[start[k] : start[k + 1]], 1 << 12), np.append(x[start[k] : start[k + 1]], 1.0), y)
    want = plain_ftrl([(plain_features(t, 12), y) for t, y in zip(texts, labels)], 3)
    got = dict(zip(*(v.tolist() for v in model.nonzero())))
    got["bias"] = got.pop(1 << 12)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) < 200  # sparse


def test_toxicity_of_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels, shard=1500)  # two shards
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").toPandas()
    rank, toxic = rows.score.rank(), rows.toxic == 1
    area = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert area > 0.95 and rows.toxic[rows.predicted == 1].mean() > 0.95 and rows.predicted[toxic].mean() > 0.8
    assert (rows.predicted == (rows.score >= 0.7)).all()
    assert len(model[0]) < 1 << 14


def test_toxicity_of_strange_texts_and_tables(spark):
    rows = [*enumerate(STRANGE), (3, "a"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(k, None, k % 2 if k % 5 else None) for k in range(12)] + [(2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(df, toxicity.learn(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert {r.score for r in toxicity.scored(df, toxicity.learn(df, labels.limit(0))).collect()} == {0.5}
    assert toxicity.scored(df.limit(0), toxicity.learn(df.limit(0), labels)).count() == 0


def plain_repairs(rows):
    """A search by cost and letters over all edits, roles tried one by one."""
    out, conversations = {}, {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            conversations[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, left in conversations.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, faults = {r[0] for r in left} - {None}, set(), []
        for _, role, text in left:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        heap, cheapest, best = [(0, "", 0, "", ())], {}, None
        while heap:
            cost, audit, i, made, lines = heapq.heappop(heap)
            if best and cost > best[0]:
                break
            if i == len(left) and re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
            if cheapest.setdefault((i, made[-1:]), cost) < cost:
                continue
            more = [(cost + 2, audit + "I", i, made + r[0], (*lines, r + ":")) for r in ("user", "assistant")]
            if i < len(left):
                _, role, text = left[i]
                more.append((cost + 3, audit + "D", i + 1, made, lines))
                if faults[i] not in ("b", "d"):
                    cut = int(faults[i] == "t")
                    more.append((cost + cut, audit + "K", i + 1, made + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                    more += [(cost + 2 + cut, audit + "R", i + 1, made + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for x in more:
                if re.fullmatch("s?(ua)*u?", x[3]):
                    heapq.heappush(heap, x)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in "bdt"), illegal, *best[:2], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())
    return out


def odd_turns(seed=1, n=60):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", None, "tool", ""], ["a.", "b", "c!", "", " ", None, "d.\t", "e?\n"]
    return [(rnd.choice([None, *range(1, 8)]), rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("span", [1, 2, 1024])
def test_repair_of_odd_conversations(spark, span):
    rows = odd_turns(span)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, fault string, segment int")
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df, conversation_repair.damaged(df), span).collect()}
    assert got == plain_repairs(rows)
    assert conversation_repair.repair(df.limit(0), conversation_repair.damaged(df.limit(0))).count() == 0


def test_repair_of_all_conversations_and_of_one_long_one(spark, sf01_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf01_dir}/conversations.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.op13_conversation_repair(spark, sf01_dir).collect()}
    assert got == plain_repairs(rows)
    rows = [(1, k, ("user", "assistant", "system")[k * k % 3 if k % 7 == 0 else k % 2], f"text {k % 150}" + "." * (k % 5 > 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df, conversation_repair.damaged(df), 64).collect()}
    assert got == by_sql(rows)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return {r[0]: tuple(r[1:]) for r in con.execute(conversation_repair.ORACLE).fetchall()}


def test_repaired_rows_read_as_conversations(spark, sf01_dir):
    table = spark.read.parquet(f"{sf01_dir}/conversations.parquet")
    rows = conversation_repair.faults(conversation_repair.damaged(table), 1024).cache()
    whole = conversation_repair.repaired(conversation_repair.segments(rows))
    found = collections.defaultdict(list)
    for r in conversation_repair.edited(rows, whole).orderBy("conv_id", "step").collect():
        found[r.conv_id].append(r)
    for r in whole.collect():
        steps = found[r.conv_id]
        assert "".join(s.edit for s in steps) == r.audit
        assert re.fullmatch("(s?(ua)+)?", "".join(s.role[0] for s in steps if s.role))
    rows.unpersist()


def test_repair_sql_on_odd_conversations():
    rows = odd_turns(9, 80)
    assert by_sql(rows) == plain_repairs(rows)
