"""WARC archives: written with revisits for equal payloads and segmented long records, and read back whole.

Writing: payloads are compared by SHA-256 on narrow rows (id, digest, size), for different payloads with one SHA-1 are known; of equal payloads
of ``least`` bytes or more the largest id is the response and the others revisit it. The payloads themselves are shuffled once, by (id, digest), which no
common payload makes uneven. Records are text ended by CRLF CRLF, so Spark's own writer stores them, wherever only Spark can write. An
archive has so many records that it unpacks to ``FILE_BYTES`` at most, for a gzip file is read by one task.

Reading: archives are streamed: Spark unzips them and cuts them at CRLF CRLF, a task puts records together from those pieces, and holds
one record at a time. A record without segments is complete at once; the segments of the others are grouped by the
identifier of their origin, ordered by number, joined, and checked against the total length. Then the chunked framing is taken off and
the payload is held against its declared digest. The two kinds are read in a pass each: the second costs the unzipping, less than shuffling or storing
whole records would.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches
from strataweave.core.skew import hot_keys, salted_join

CRLF = b"\r\n"
LEAST = 1000
SEGMENT = 32 << 10
CHUNK = 8 << 10
FILE_BYTES = 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that never part a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + max(4, size))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("chunk does not end where its length says")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + CRLF + CRLF + block


def _uri(url: str | None) -> str | None:
    """Control characters and spaces percent-encoded: a header is one line."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join("%%%02X" % b for b in m.group().encode()), url)


def record_id(page, digest: str) -> str:
    return f"<urn:x-page:{'null' if page is None else page}:{digest[:16]}>"


def records(page, url: str | None, payload: bytes, digest: str, refers_to, segment: int, key: str | None = None) -> list[bytes]:
    """The records of one page, without their ends. ``digest`` is the payload's SHA-1; ``key`` (by default the same) names equal payloads."""
    key = key or digest
    own = record_id(page, key)
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", _uri(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(refers_to, key)), ("X-Payload-Length", str(len(payload)))], b"")]
    block = HTTP + chunked(payload)
    parts = _cuts(block, segment)
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *common], block)]
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block)) if n == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), ("WARC-Segment-Total-Length", total), ("WARC-Date", "1970-01-01T00:00:00Z")], part))
    return out


def decide(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """(id, key, refers_to), one row for each id and payload: ``key`` is the payload's SHA-256, ``refers_to`` is null for responses. Rows equal in both are all responses if one is."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    narrow = pages.select(F.col(id_col).alias("id"), F.sha2(payload.cast("binary"), 256).alias("key"), F.octet_length(payload).alias("size"))
    last = narrow.where((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    known = salted_join(narrow.select("id", "key").distinct(), last.where("n > 1").select("key", "last"), "key", F.col("id"), hot_keys(last, "key"))
    return known.select("id", "key", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, segment: int = SEGMENT, per_file: int | None = None) -> None:
    """Gzip archives in the folder ``path``, one response or revisit record (and continuations) for each row.

    A null payload is an empty one, a null URL has no header, a null id never is referred to and never revisits. Extra columns stay out.
    """
    bounded_batches(pages.sparkSession)
    per_file = per_file or max(1, FILE_BYTES // (segment + 2048))
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    full = full.withColumn("key", F.sha2("payload", 256))
    d = decide(pages, id_col, payload_col, least).withColumnsRenamed({"id": "_id", "key": "_key"})
    joined = full.join(d, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("id", "url", "payload", "key", "refers_to")

    def run(batches):
        for b in batches:
            for some in range(0, b.num_rows, 500):
                p = b.slice(some, 500).to_pylist()
                yield pa.RecordBatch.from_pydict({"record": pa.array([r for x in p for r in records(x["id"], x["url"], x["payload"], hashlib.sha1(x["payload"]).hexdigest(), x["refers_to"], segment, x["key"])], pa.binary())})

    lines = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    lines.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes):
    """(headers, block) of each record."""
    yield from parse_pieces([data])


def parse_pieces(pieces):
    """(headers, block) of each record of one archive that comes in pieces; no more than a record and a piece is held."""
    held, headers, need = bytearray(), None, 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if headers is None:
                end = held.find(CRLF + CRLF, at)
                if end < 0:
                    break
                version, *lines = held[at:end].decode("utf-8").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError("no record where one should begin")
                headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
                need, at = int(headers["content-length"]), end + 4
            if len(held) < at + need + 4:
                break
            if held[at + need : at + need + 4] != CRLF + CRLF:
                raise ValueError("a record is cut short")
            yield headers, bytes(held[at : at + need])
            headers, at = None, at + need + 4
        del held[:at]
    if headers is not None or held:
        raise ValueError("a record is cut short")


_PARSED = "record_id string, record_type string, target_uri string, refers_to string, digest string, declared bigint, origin string, segment int, total bigint, block binary"


def parsed(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """Records of the archives in ``path``: those with segments, or those without."""

    def run(batches):
        names = [x.split()[0] for x in _PARSED.split(", ")]
        rows, size = [], 0
        for h, block in archives(batches):
            if ("warc-segment-number" in h) != segments:
                continue
            sha1 = h.get("warc-payload-digest", "")[5:]
            number = lambda k, h=h: int(h[k]) if k in h else None
            rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), base64.b32decode(sha1).hex() if sha1 else None, number("x-payload-length"), h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"), block))
            size += len(block)
            if size > 4 << 20 or len(rows) >= 2000:
                yield batch(names, rows)
                rows, size = [], 0
        if rows:
            yield batch(names, rows)

    def archives(batches):
        """The records of all archives of the task, whose pieces come file by file and in order."""
        lines = ((name, piece.as_buffer()) for b in batches for name, piece in zip(b.column(0).to_pylist(), b.column(1)))
        for _, one in groupby(lines, key=itemgetter(0)):
            yield from parse_pieces(bytes(x) + CRLF + CRLF for _, x in one)

    def batch(names, rows):
        kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _PARSED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    lines = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, _PARSED)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from segments. A missing or doubled number, or a total that differs, raises; identical records met several times come out as often."""
    by_number = segments.groupBy("origin", "segment").agg(F.count("*").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("target_uri", "digest", "total", "block")])
    lists = by_number.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"), F.min("copies").alias("copies"), F.max("copies").alias("most"), F.first("target_uri", ignorenulls=True).alias("target_uri"), F.first("digest", ignorenulls=True).alias("digest"))
    # hexadecimal, for arrays join as strings in one pass over the record
    whole = lists.withColumn("block", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), "")))
    right = (F.col("copies") == F.col("most")) & (F.col("s")[F.size("s") - 1]["segment"] == F.size("s")) & (F.octet_length("block") == F.col("total"))
    checked = whole.withColumn("block", F.when(F.coalesce(right, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not make up the record "), F.col("origin"))).cast("binary")))
    rows = checked.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), "target_uri", F.lit(None).cast("string").alias("refers_to"), "digest", F.lit(None).cast("bigint").alias("declared"), "block")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, digest, payload_bytes, payload) of every response and revisit; a revisit's payload is null."""
    bounded_batches(spark)
    cols = ["record_id", "record_type", "target_uri", "refers_to", "digest", "declared", "block"]
    whole = parsed(spark, path, segments=False).select(*cols)
    both = whole.union(reassembled(parsed(spark, path, segments=True)).select(*cols))
    kinds = "record_id string, record_type string, target_uri string, refers_to string, digest string, payload_bytes bigint, payload binary"

    def run(batches):
        for b in batches:
            sizes, payloads = [], []
            for kind, digest, declared, block in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6)):
                if kind == "revisit":
                    sizes.append(declared)
                    payloads.append(None)
                    continue
                payload = http_payload(block.as_buffer().to_pybytes())
                if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a payload does not have its declared digest")
                sizes.append(len(payload))
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary())], names=[x.split()[0] for x in kinds.split(", ")])

    return both.mapInArrow(run, kinds)
