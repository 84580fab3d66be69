import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataweave.llm import bpe, decontam, simhash, warc


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_varints(xs):
    assert bpe.unpack(bpe.pack(np.array(xs, np.int64))).tolist() == xs


@settings(deadline=None)
@given(st.text(), st.integers(1, 40), st.integers(4, 60))
def test_warc_records(text, chunk, segment):
    payload = text.encode("utf-8", "surrogatepass") if not any(0xD800 <= ord(c) < 0xE000 for c in text) else b""
    assert warc.unchunked(warc.chunked(payload, chunk)) == payload
    parts = warc._cuts(payload, segment)
    assert b"".join(parts) == payload and all(len(p) <= max(4, segment) for p in parts)
    for p in parts:
        p.decode()
    whole = b"".join(r + b"\r\n\r\n" for r in warc.records(1, "u", payload, "ab" * 20, None, 4096))
    assert warc.http_payload(b"".join(b for _, b in warc.parse(whole))) == payload


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 12)).map(lambda x: (x[0], x[0] + x[1]))))
def test_merged_ranges_cover_the_same_words(ranges):
    got = decontam.merge(ranges)
    assert {k for a, b in got for k in range(a, b)} == {k for a, b in ranges for k in range(a, b)}
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:]))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12, unique=True), st.integers(6, 12))
def test_linear_hash(xs, bits):
    x = np.array(xs, np.uint64)
    m = simhash._masks(2)[: len(x)]
    assert (simhash._linear(x ^ m, bits) == (simhash._linear(x, bits) ^ simhash._linear(m, bits))).all()
    assert (simhash._linear(x, bits) < 1 << bits).all()
