import hashlib
import random
import struct

import pytest

from strataweave.llm import bpe


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers

    return bpe._encoder(bpe.vocabulary_path(), public_tokenizers.PATTERN)


def test_varints():
    import numpy as np

    a = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**32 - 1] * 3)
    assert bpe.unpack(bpe.pack(a)).tolist() == a.tolist()
    assert bpe.unpack(bpe.pack(np.array([], int))).tolist() == []


def test_matches_library(spark, enc):
    rnd = random.Random(3)
    alphabet = "abcXYZ 'stll \n\t  é漢字😀٣1234.,!?--\x1c\x85\xa0​　İß’"
    texts = [None, "", " ", "\n\n\n", "<|endoftext|> I'll they've 'S", "a" * 5000, "  lead", "trail  ", "x\x1c\x1d y"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(400)]
    docs = spark.createDataFrame([(i % 350 if i else None, t, "z", i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(docs, block_chars=3000, buckets=7)).collect()
    want = sorted(((i % 350 if i else None, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts)), key=str)
    have = sorted(((r.doc_id, struct.unpack(f"<{len(r.ids) // 4}I", r.ids), bytes(r.decoded)) for r in got), key=str)
    assert have == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_every_character_splits_as_the_library(enc):
    """Classes of all characters: a letter, number or space in one library is one in the other."""
    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    cps = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for step in range(0, len(cps), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b" for c in cps[step : step + 4096])
        assert [i for w in find(text) for i in enc._encode_single_piece(w)] == enc.encode_ordinary(text), hex(cps[step])


def test_whole_table(spark, sf, enc):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.encode(docs, decoded=True).collect()}
    assert {i: bytes(r.decoded) for i, r in got.items()} == {r.doc_id: r.text.encode() for r in docs.collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    for i, ids in want.items():
        assert hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).digest() == hashlib.sha256(got[i].ids).digest()


def test_empty_table_arrays_and_bad_ids(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(docs).count() == 0
    docs = spark.createDataFrame([(1, "two words")], "doc_id bigint, text string")
    assert len(bpe.as_array(bpe.encode(docs)).first().ids) == bpe.encode(docs).first().n_tokens
    bad = spark.createDataFrame([(bytearray(struct.pack("<I", 4_000_000)),)], "ids binary")
    with pytest.raises(Exception, match="no token"):
        bpe.decode(bad).collect()


def test_full_word_tables_are_emptied(spark, enc):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, block_chars=2000, buckets=3, memo_bytes=5000).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert bytes(got[i]) == struct.pack(f"<{len(ids)}I", *ids)


def test_buckets_follow_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(300)], "doc_id bigint, text string")
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 1000)
    from strataweave.core.session import cut_lineage

    assert bpe._buckets_for(cut_lineage(docs), "text") == 300
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 10)
    assert bpe._buckets_for(cut_lineage(docs), "text") == bpe.MOST_BUCKETS
    assert bpe._buckets_for(docs.limit(0), "text") >= bpe.BUCKETS
