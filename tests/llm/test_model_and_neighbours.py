import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests_llm_plain import plain_classes

from tidemark.llm import lm_score, near_dedup, nearest
from tidemark.llm.queries import QUERIES

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_scores(rows, mu, order=2):
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    seen, history = Counter(), Counter()
    for (_, x), out in zip(tokens, held):
        padded = ["<s>"] * (order - 1) + x
        for at in range(order - 1, 0 if out else len(padded)):
            for n in range(order):
                seen[tuple(padded[at - n : at + 1])] += 1
                history[tuple(padded[at - n : at])] += 1
    n, v = history[()], sum(len(g) == 1 for g in seen)

    def p(h, w):
        if not h:
            return (seen[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (seen[(*h, w)] + mu * p(h[1:], w)) / (history[h] + mu)

    out = []
    for (i, x), h in zip(tokens, held):
        padded = ["<s>"] * (order - 1) + x
        full = sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(x))
        out.append((i, h, len(x), sum(seen[(w,)] > 0 for w in x), n, sum(math.log10(p((), w)) for w in x), full))
    return sorted(out, key=str)


def compare(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_scores_against_plain_counts(spark, sf01_dir, docs01):
    compare(QUERIES["op8_lm_score"](spark, sf01_dir).collect(), plain_scores([(i, t) for i, (t, _) in docs01.items()], 20.0, 2))


def test_scores_hold_counts_only():
    """What a block's texts need besides their counts doesn't grow with the block."""
    peaks = []
    for texts in (80, 240):
        lengths = np.full(texts, 5000)
        grams = lm_score.Grams(np.arange(texts * 5000, dtype=np.int32) % 1000, lengths, np.arange(1000, dtype=np.uint64), 2)
        single, more = np.ones(len(grams.ends), np.int64), [np.ones(len(grams.ends), np.int64)]
        tracemalloc.start()
        known = [int(n) for columns in lm_score.judged(grams, single, more, 10, 1e6, 20.0) for n in columns[0]]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert known == [5001] * texts
    assert peaks[1] < 1.2 * peaks[0]


def test_scores_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for order in (1, 2, 3, 4):
        got = lm_score.scores(odd.repartition(3), order=order, block_bytes=500, range_tokens=300).collect()
        compare(got, plain_scores(rows, 20.0, order))
    assert lm_score.scores(odd.limit(0)).count() == 0
    assert lm_score.scores(odd.where("doc_id = 3")).count() == 2


def test_scores_of_order_three(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(lm_score.scores(docs.repartition(5), order=3, mu=2.0, range_tokens=20_000).collect(), plain_scores(rows, 2.0, 3))


def test_near_dedup_against_all_pairs(spark, sf01_dir, docs01):
    got = {r.doc_id: r.class_id for r in QUERIES["op9_near_dedup"](spark, sf01_dir).collect()}
    assert got == plain_classes([(i, t) for i, (t, _) in docs01.items()])


def test_near_dedup_hot_groups_and_chains(spark):
    pick = np.random.default_rng(4)
    word = lambda: "w%d" % pick.integers(0, 10**9)
    base = [word() for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 150):  # copies of one text with their own changes, most of them far from each other
        x = list(base)
        for j in pick.integers(0, 300, 5):
            x[j] = word()
        rows.append((k, " ".join(x)))
    chain = [word() for _ in range(200)]
    for k in range(200, 215):  # each near the one before only
        chain = [*chain[12:], *(word() for _ in range(12))]
        rows.append((k, " ".join(chain)))
    rows += [(300 + k, " ".join(base[:100] + [word() for _ in range(200)])) for k in range(40)]  # one common passage
    rows += [(400 + k, rows[0][1].upper()) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == plain_classes(rows)


def test_links_with_and_without_the_test_on_registers(spark, sf_dir):
    """Texts around the threshold, small blocks of a bucket: classes equal all pairs' either way."""
    pick = np.random.default_rng(11)
    word = lambda: "w%d" % pick.integers(0, 10**9)
    rows, base = [], [[word() for _ in range(120)] for _ in range(3)]
    for k in range(240):
        x = list(base[k % 3])
        for j in pick.integers(0, 120, pick.integers(0, 6)):
            x[j] = word()
        rows.append((k, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_classes(rows)
    for errors in (None, 7.0):
        assert {r.doc_id: r.class_id for r in near_dedup.classes(df, errors=errors, block=16).collect()} == want


def test_chance_of_losing_a_link_to_the_test_on_registers():
    """The binomial tail at the threshold itself, summed up."""
    size, p = 240, 0.2 * 7 / 8
    most = near_dedup.most_differing(0.8, size, 7.0)
    tail = sum(math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(most + 1, size + 1))
    assert tail < 3e-10


def test_a_hot_group_of_texts_below_the_threshold(spark):
    """2,000 texts of one bucket or another, of which few are links: none is lost, none made."""
    pick = np.random.default_rng(12)
    base = ["b%d" % k for k in range(90)]
    rows = [(k, " ".join(base[:60] + ["w%d" % pick.integers(0, 10**9) for _ in range(30)])) for k in range(1980)]
    rows += [(5000 + k, rows[k * 90][1] + " tail") for k in range(20)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    want = {k: k for k, _ in rows} | {5000 + k: k * 90 for k in range(20)}
    assert got == want


def test_near_dedup_odd_rows(spark, odd):
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.class_id for r in got}[7] == 7
    assert all(r.class_id == r.doc_id for r in got)
    assert near_dedup.classes(odd.limit(0)).count() == 0


def test_signatures_are_unbiased():
    pick = np.random.default_rng(2)
    off = []
    for _ in range(30):
        keys = np.sort(pick.integers(1, 2**63, 60).astype(np.uint64))
        a = pick.integers(1, 40, 60)
        b = np.maximum(1, a + pick.integers(-9, 10, 60))
        x, y = (keys[:50], a[:50]), (keys[6:], b[6:])
        s = near_dedup.signatures([x, y], 1500)
        off.append((s[0] == s[1]).mean() - near_dedup.similarity(x, y))
    assert abs(np.mean(off)) < 0.006 and np.std(off) < 0.03


def exact_nearest(rows, query, k):
    ids, x = zip(*rows)
    d = np.sqrt(((np.array(x, float) - np.array(dict(rows)[query], float)) ** 2).sum(1))
    return sorted((v, i) for v, i in zip(d.tolist(), ids) if i != query)[:k]


def test_nearest_recall(spark, sf01_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf01_dir}/embeddings.parquet").collect()]
    vectors = spark.read.parquet(f"{sf01_dir}/embeddings.parquet")
    for shard_rows in (8192, 150):
        got = defaultdict(list)
        for r in nearest.neighbours(vectors, vectors.vec_id % 100 == 0, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.score, r.vec_id, r.rank))
        hit = 0
        for q, found in got.items():
            want = exact_nearest(rows, q, 10)
            assert [f[2] for f in found] == list(range(1, 11)) and found == sorted(found)
            hit += len({f[1] for f in found} & {w[1] for w in want})
        assert len(got) == 5 and hit >= 45
    assert QUERIES["op10_nearest"](spark, sf01_dir).count() == 50


def test_nearest_ties_and_unusable_rows(spark):
    rows = [(k, [1.0, 2.0]) for k in range(0, 400)] + [(1000 + k, [float(k), -1.0]) for k in range(1, 30)]
    bad = [(2000, None), (2100, [0.0, 0.0]), (2200, [1.0, None]), (2300, [math.nan, 1.0]), (2400, [math.inf, 1.0]), (2500, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.neighbours(df, df.vec_id % 100 == 0, shard_rows=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        assert found == [(i, 0.0) for i in range(12) if i != q][:10]
    assert nearest.neighbours(df.limit(0), df.vec_id % 100 == 0).count() == 0


def test_nearest_of_ids_with_several_vectors(spark):
    """An id with several vectors asks with the first in order and is as far as its nearest."""
    pick = np.random.default_rng(6)
    rows = [(k, pick.normal(size=8).tolist()) for k in range(600)]
    rows += [(k, pick.normal(size=8).tolist()) for k in [0, 100, 200, *range(300, 420)] for _ in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest.neighbours(df, df.vec_id % 100 == 0, shard_rows=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hit = 0
    for q, found in got.items():
        asked, away = min(x for i, x in rows if i == q), {}
        for i, x in rows:
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(asked, x)))
            away[i] = min(d, away.get(i, d))
        want = sorted((d, i) for i, d in away.items() if i != q)[:10]
        assert len({i for _, i in found}) == 10 and found == sorted(found)
        assert all(abs(away[i] - d) < 1e-12 for d, i in found)
        hit += len({i for _, i in found} & {i for _, i in want})
    assert hit >= 54


@pytest.mark.parametrize("n", [1, 2, 5])
def test_graphs_of_few_vectors(n):
    g = nearest.build(np.eye(n + 1)[:n])
    nodes, _ = g.beam(g.vectors, n)
    assert all(set(row.tolist()) == set(range(n)) for row in nodes)
