import hashlib
import random

import numpy as np

from tidemark.llm import bpe, bpe_codec, token_count
from tidemark.llm.queries import QUERIES


def expected(texts):
    tok = bpe.tokenizer()
    out = []
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def test_ids_equal_the_library_on_random_texts():
    tok, own, pick = bpe.tokenizer(), bpe.Bpe(), random.Random(1)
    parts = ["a", "Zé", "ł", " ", " ", "\n", "\t", "  ", "'s", "'ll", "'", "!", "***", "1", "½", "\xa0", "　", "\x1c", "\x85", "中", "ا", "🙂", "́", "<|endoftext|>", "<|", "_", "\x0b", "​", "don't", "ª"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 14))) for _ in range(4000)]
    split = bpe.Splitter(["<|endoftext|>"])
    for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        assert own.ids(t).tolist() == e.ids, repr(t)
        units = split.careful(t)
        assert "".join(units) == t
        assert [i for u in units for i in tok.encode(u, add_special_tokens=False).ids] == e.ids, repr(t)


def test_long_texts_are_cut_where_the_library_cuts():
    text = "Some words, and more: don't stop\nhere  now. " * 4000
    assert bpe.Bpe(piece=1000).ids(text).tolist() == bpe.tokenizer().encode(text, add_special_tokens=False).ids
    assert "".join(bpe.cut_long(text, 1000)) == text


def test_codec_and_counts_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(texts, expected(texts.values())))
    got = QUERIES["op1_bpe_codec"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    for r in QUERIES["op2_token_counts"](spark, sf_dir).collect():
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id][0])
        assert r.over_limit == (r.n_tokens > 512)


def test_codec_odd_rows(spark, odd):
    rows = [r.text for r in odd.collect()]
    got = bpe_codec.encode_decode(odd, block_bytes=2000).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected(rows))
    assert sorted(r.n_tokens for r in token_count.token_counts(odd).collect()) == sorted(x[0] for x in expected(rows))
    assert bpe_codec.encode_decode(odd.limit(0)).count() == token_count.token_counts(odd.limit(0)).count() == 0


def test_long_texts_are_counted_piece_by_piece(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["Some words, and more: don't stop\nhere  now. été 中文 " * 300, "<|endoftext|>" + "a b c " * 500 + "<|endoftext|>", "x" * 9000, "word " * 2000 + "<|endoftext|>tail", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_count.token_counts(df, batch_bytes=700, piece_bytes=300).collect()}
    assert got == {k: (w[0], len(t.encode())) for k, (t, w) in enumerate(zip(texts, expected(texts)))}
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_count.token_counts(df, path, batch_bytes=700, piece_bytes=300).collect()}
    assert got == {k: len(model.encode(t)) for k, t in enumerate(texts)}
    assert len(token_count.counter(path).cut(texts[3], 300)) > 10


def test_batches_hold_about_equal_bytes():
    pieces = [(k, "é" * (k % 7 + 1)) for k in range(500)]
    batches = list(token_count.batches_of(pieces, 100))
    assert [x for rows, kept in batches for x in zip(rows, kept)] == pieces
    assert all(100 <= sum(len(t.encode()) for t in kept) < 114 for _, kept in batches[:-1])


def test_sentencepiece_counts(spark, odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(len(model.encode(r.text or "")) for r in odd.collect())
    assert sorted(r.n_tokens for r in token_count.token_counts(odd, path).collect()) == want


def test_byte_alphabet():
    assert sorted(bpe.byte_of_char().values()) == list(range(256))
    assert np.array_equal(bpe.Bpe().ids(""), [])
