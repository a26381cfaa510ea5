"""Each stage of the corpus pipeline, and run(), against plain versions on a small fixture."""

import hashlib
from collections import Counter

import corpus_pipeline
from tests_llm_plain import check_packing, plain_classes, plain_lines

from tidemark.llm import language_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(120).collect()
    rows = [tuple(r) for r in docs]
    base = max(r[0] for r in rows) + 1
    some = max((r[1] for r in rows if r[1]), key=len)
    rows += [rows[0], rows[1], (rows[2][0], "Another text of this number, unlike the first one in all of its words.", "en", "s", 9)]
    rows += [(base, None, "en", "s", 0), (base + 1, "", None, None, None), (base + 2, "12345 !!", "en", "s", 8), (base + 3, some + " and a tail", "en", "s", 1)]
    rows += [(base + 4 + k, some.upper() if k % 2 else some, "en", "s", 1) for k in range(6)] + [(None, some, "en", "s", 1), (None, "A text without a number stands here", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def plain_language(spark, docs, rows):
    profiles = language_id.learn(docs)
    kept = []
    for r in rows:
        lang, _, fit = profiles.predict(r[1])
        if lang != "und" and fit >= 0.02:
            kept.append(r)
    return kept


def plain_line_stage(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    keyed = [(r, [(x, x.strip(" \t\n\x0b\x0c\r").translate(low)) for x in (r[1] or "").split("\n")]) for r in rows]
    owner = {}
    for r, lines in keyed:
        for _, k in lines:
            if r[0] is not None and len(k) >= 10:
                owner[k] = min(r[0], owner.get(k, r[0]))
    out = []
    for r, lines in keyed:
        text = "\n".join(x for x, k in lines if r[0] is None or owner.get(k, r[0]) == r[0])
        out.append((r[0], text, r[2], r[3], len(text)))
    digests = sorted((hashlib.sha256(r[1].encode()).hexdigest() for r in out))
    assert digests == sorted(x[3] for x in plain_lines([(r[0], r[1]) for r in rows]))
    return out


def plain_near(rows):
    numbered = {}
    for r in rows:
        if r[0] is not None:
            numbered[r[0]] = min(r[1] or "", numbered.get(r[0], r[1] or ""))
    classes = plain_classes(list(numbered.items()))
    kept = {}
    for r in rows:
        if r[0] is not None and classes[r[0]] == r[0]:
            order = tuple((x is not None, x) for x in (r[2], r[3], r[4]))
            kept[r[0], r[1]] = min((order, r), kept.get((r[0], r[1]), (order, r)), key=lambda x: x[0])
    return [r for _, r in kept.values()] + [r for r in rows if r[0] is None]


def test_each_stage_and_the_whole(spark, sf_dir, tmp_path):
    docs, rows = fixture(spark, sf_dir)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "lines", "near_duplicates", "packed"]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, plain in (("language", lambda r: plain_language(spark, df, r)), ("lines", plain_line_stage), ("near_duplicates", plain_near)):
        want = plain(rows)
        got = stage[name](spark, df, str(tmp_path))
        assert got.columns == corpus_pipeline.COLUMNS
        assert key(got.collect()) == key(want), name
        assert len(want) < len(rows) or name == "lines"
        rows, df = want, spark.createDataFrame(want, SCHEMA)
    last = stage["packed"](spark, df, str(tmp_path)).collect()
    bins, least = check_packing(last, [(r[0], r[1]) for r in rows], 2048)
    assert bins <= least + 1
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    content = lambda out: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    assert content(whole) == content(last)


def test_two_texts_of_one_number_both_stay(spark):
    rows = [(1, "The first text of this number speaks about rivers and mountains.", "en", "a", 1), (1, "Something else entirely, on trains, tickets and timetables of today.", "en", "b", 2), (1, "Something else entirely, on trains, tickets and timetables of today.", "en", "a", 2)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert key(got) == key([rows[0], rows[2]])


def test_stages_on_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").count() == 0
