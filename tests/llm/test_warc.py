import gzip
import hashlib
import random

import pytest

from strataweave.llm import warc


def brute(rows, least=1000):
    groups = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and i is not None:
            groups.setdefault(b, []).append(i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        last = max(groups.get(b, [i]), default=i) if i is not None and len(b) >= least else i
        kind = "response" if i == last else "revisit"
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, None if kind == "response" else last))
    return sorted(out, key=str)


def page(rid):
    p = rid.split(":")[2]
    return None if p == "null" else int(p)


def read(spark, path):
    rows = warc.read_warc(spark, path).collect()
    for r in rows:
        assert r.record_type == "revisit" or hashlib.sha1(r.payload).hexdigest() == r.digest
    return sorted(((page(r.record_id), r.payload_bytes, r.digest, r.record_type, page(r.refers_to) if r.refers_to else None) for r in rows), key=str)


def test_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    big = "".join(rnd.choice("abc\r\né漢😀 0") for _ in range(90_000))
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/x y\r\nz", "short"), (9, "u", "short"), (4, "u", big), (7, "u", big), (6, "u", big), (5, "u", "x" * 999), (8, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", big[:50_000]), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 4000), (13, "u", big + "1"), (13, "u", big + "1")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, segment=4096)
    assert read(spark, path) == brute(rows)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    kinds = [h["warc-type"] for h, _ in warc.parse(raw)]
    assert kinds.count("continuation") > 50 and len(kinds) == len(rows) + kinds.count("continuation")
    warc.write_warc(pages.limit(0), path)
    assert read(spark, path) == []


def test_chunk_framing():
    for data in (b"", b"a", "é漢😀".encode() * 1000, b"\r\n0\r\n\r\n"):
        for size in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


@pytest.mark.parametrize("drop", [1, 2, 3])
def test_incomplete_segments_raise(spark, drop):
    rec = [list(warc.parse(r + b"\r\n\r\n"))[0] for r in warc.records(1, "u", b"x" * 3000, "00" * 20, None, 1024)]
    rows = [("o", int(h["warc-segment-number"]), None, "d", int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, bytearray(b)) for h, b in rec if int(h["warc-segment-number"]) != drop]
    df = spark.createDataFrame(rows, "origin string, segment int, target_uri string, digest string, total bigint, block binary")
    with pytest.raises(Exception, match="segments do not make up"):
        warc.reassembled(df).collect()


def test_whole_table(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_warc(pages, str(tmp_path / "w"), segment=2048)
    assert read(spark, str(tmp_path / "w")) == brute([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_pieces_give_the_records_of_the_whole():
    rnd = random.Random(3)
    whole = b"".join(r + b"\r\n\r\n" for i in range(20) for r in warc.records(i, "u", bytes(rnd.choices(b"ab\r\n", k=rnd.randrange(300))), "00" * 20, None, 64))
    want = list(warc.parse(whole))
    for size in (1, 3, 50, 1000):
        assert list(warc.parse_pieces(whole[k : k + size] for k in range(0, len(whole), size))) == want
    for cut in (1, 4, 30):
        with pytest.raises(ValueError):
            list(warc.parse_pieces([whole[:-cut]]))


def test_archives_are_bounded_and_payloads_told_apart_by_sha256(spark, tmp_path):
    rows = [(i, "u", f"{i % 7}" * 3000) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    keys = {r.id: r.key for r in warc.decide(pages, "page_id", "html").collect()}
    assert keys == {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    warc.write_warc(pages.repartition(1), str(tmp_path / "w"), per_file=16)
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*")]
    assert len(files) >= 13 and all(len(list(warc.parse(f))) <= 16 for f in files)
    assert read(spark, str(tmp_path / "w")) == brute(rows)
    assert warc.FILE_BYTES // (warc.SEGMENT + 2048) * (warc.SEGMENT + 2048) <= warc.FILE_BYTES
