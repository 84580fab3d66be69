"""Byte-level BPE over a table: each distinct pre-token is encoded once.

Encoding, in two shuffles. Documents are taken in blocks of about ``BLOCK_CHARS`` characters (whole
documents). Within a block every pre-token gets a number in order of first use, so a document becomes its
sequence of numbers: the positions, packed as varints.

1. The block's distinct words go to word buckets (by CRC-32 of the word), packed per block and bucket. A bucket
   meets each of its distinct words from all blocks, runs BPE on it once and answers each block. There are at most ``MOST_BUCKETS`` buckets, so that
   packed rows grow with the blocks only, and a bucket's word table holds at most ``MEMO_BYTES`` bytes of words and ids: beyond that it is emptied, and a word that
   comes again is encoded again.
2. Answers and packed documents meet by block; ids are laid out by position.

No text is shuffled. A block's name is a digest of its rows, so if the input were ever read in another order by
one of the two passes, the second shuffle would find no answers and the job fails rather than mislabel;
pass a table scan or a checkpoint. Decoding looks every id up in the token-byte table (one fixed vocabulary).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches

BLOCK_CHARS = 12_000_000
CHUNK_BYTES = 1 << 20
BUCKETS, MOST_BUCKETS = 96, 4096
BUCKET_BYTES = 64 << 20
MEMO_BYTES = 96 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("table", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes end to end, start and length by id."""
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    lens = np.zeros(size, np.int64)
    table = [b""] * size
    for token, i in ranks.items():
        table[i] = token
        lens[i] = len(token)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lens) - lens, lens


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of runs [start, start + len) laid end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def pack(a: np.ndarray) -> bytes:
    """Varints of up to five 7-bit groups."""
    a = a.astype(np.uint64)
    out = np.empty((len(a), 5), np.uint8)
    used = np.empty((len(a), 5), bool)
    for k in range(5):
        more = a >> np.uint64(7 * (k + 1))
        out[:, k] = ((a >> np.uint64(7 * k)) & np.uint64(127)) | (np.uint64(128) * (more > 0))
        used[:, k] = True if k == 0 else (a >> np.uint64(7 * k)) > 0
    width = int(used.any(axis=0).sum()) if len(a) else 0
    return out[:, :width][used[:, :width]].tobytes()


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.r_[0, last[:-1] + 1]
    out = (raw[first] & 127).astype(np.int64)
    longest = int((last - first).max())
    for k in range(1, longest + 1):
        has = last - first >= k
        out[has] |= (raw[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _blocks(batches, limit: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of runs of whole documents, split where ``limit`` characters are passed."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            text = t.as_py() if t.is_valid else ""
            ids.append(i)
            texts.append(text)
            size += len(text) + 64
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _block_name(ids: list, texts: list[str]) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for i, t in zip(ids, texts):
        raw = t.encode()
        h.update(b"%s,%d;" % (str(i).encode(), len(raw)))
        h.update(raw)
    return h.digest()


def _numbering() -> defaultdict:
    d: defaultdict = defaultdict()
    d.default_factory = d.__len__
    return d


def _buckets_for(docs: DataFrame, text_col: str) -> int:
    """One word bucket for every 64 MB of input, ``BUCKETS`` at least and ``MOST_BUCKETS`` at most: by Catalyst's estimate, or where it has none (rows from memory or a checkpoint) by the texts' own bytes."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(max(BUCKETS, size // BUCKET_BYTES), MOST_BUCKETS)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, buckets: int | None = None, decoded: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(id, n_tokens, ids): ``ids`` is binary, little-endian unsigned 32-bit (see ``as_array``). With ``decoded`` also the bytes that the ids stand for, as ``decode`` gives them.

    Every row gives one row, repeated ids too; a null text is an empty one; extra columns are left behind.
    """
    import public_tokenizers
    import zstandard

    bounded_batches(docs.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    buckets = buckets or _buckets_for(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def words(batches):
        find, press = _splitter(pattern).findall, zstandard.ZstdCompressor(level=3).compress
        for ids, texts in _blocks(batches, block_chars):
            number = _numbering()
            for t in texts:
                for w in dict.fromkeys(find(t)):
                    number[w]
            name = _block_name(ids, texts)
            raw = [w.encode() for w in number]
            to = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int32, len(raw))
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in range(buckets):
                mine = order[cuts[k] : cuts[k + 1]]
                if len(mine):
                    lens = np.fromiter((len(raw[i]) for i in mine), np.int64, len(mine))
                    blob = [pack(np.diff(mine, prepend=0)), pack(lens), press(b"".join([raw[i] for i in mine]))]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "block": pa.array([name], pa.binary()), **{c: pa.array([x], pa.binary()) for c, x in zip(("numbers", "lens", "blob"), blob)}})

    def answer(batches):
        """Rows sorted by bucket: one word table at a time."""
        piece, seen, bucket, held = _encoder(path, pattern)._encode_single_piece, {}, None, 0
        unpress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, name, numbers, lens, blob in zip(*(c.to_pylist() for c in b.columns)):
                if k != bucket:
                    bucket, seen, held = k, {}, 0
                text, ids, n_ids, at = unpress(blob), [], [], 0
                for n in unpack(lens).tolist():
                    w = text[at : at + n]
                    at += n
                    got = seen.get(w)
                    if got is None:
                        got = tuple(piece(w))
                        held += 150 + n + 8 * len(got)
                        if held > memo_bytes:
                            seen, held = {}, 150 + n + 8 * len(got)
                        seen[w] = got
                    ids.extend(got)
                    n_ids.append(len(got))
                yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.binary()), "kind": pa.array([0], pa.int32()), "seq": pa.array([k], pa.int32()), "ids": pa.array([None], ids_type), "numbers": pa.array([numbers], pa.binary()), "lens": pa.array([pack(np.array(n_ids))], pa.binary()), "blob": pa.array([pack(np.array(ids))], pa.binary())})

    def positions(batches):
        find, press = _splitter(pattern).findall, zstandard.ZstdCompressor(level=3).compress
        for ids, texts in _blocks(batches, block_chars):
            number, name = _numbering(), _block_name(ids, texts)
            seq, own, lens, codes, size = 0, [], [], [], 0
            for i, t in zip(ids, texts):
                c = pack(np.array(list(map(number.__getitem__, find(t))), np.int64))
                own.append(i)
                lens.append(len(c))
                codes.append(c)
                size += len(c) + 16
                if size >= CHUNK_BYTES:
                    yield chunk(name, seq, own, lens, press(b"".join(codes)))
                    seq, own, lens, codes, size = seq + 1, [], [], [], 0
            if own:
                yield chunk(name, seq, own, lens, press(b"".join(codes)))

    def chunk(name, seq, own, lens, blob):
        return pa.RecordBatch.from_pydict({"block": pa.array([name], pa.binary()), "kind": pa.array([1], pa.int32()), "seq": pa.array([seq], pa.int32()), "ids": pa.array([own], ids_type), "numbers": pa.array([None], pa.binary()), "lens": pa.array([pack(np.array(lens))], pa.binary()), "blob": pa.array([blob], pa.binary())})

    def reassemble(batches):
        """Rows sorted by block, answers before documents."""
        unpress = zstandard.ZstdDecompressor().decompress
        block, parts, table = None, [], None
        for b in batches:
            for name, what, _, own, numbers, lens, blob in zip(*(c.to_pylist() for c in b.columns)):
                if name != block:
                    block, parts, table = name, [], None
                if what == 0:
                    parts.append((np.cumsum(unpack(numbers)), unpack(lens), unpack(blob).astype(np.uint32)))
                    continue
                if table is None:
                    table, parts = _table(parts), []
                starts, n_ids, ids = table
                raw, at, out = unpress(blob), 0, []
                for size in unpack(lens).tolist():
                    codes = unpack(raw[at : at + size])
                    at += size
                    if len(codes) and int(codes.max()) >= len(n_ids):
                        raise RuntimeError("a block was read in two different orders; encode a table scan or a checkpoint")
                    out.append(ids[spread(starts[codes], n_ids[codes])])
                for some in range(0, len(own), 64):
                    mine = out[some : some + 64]
                    row = {"id": pa.array(own[some : some + 64], ids_type.value_type), "n_tokens": pa.array([len(x) for x in mine], pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in mine], pa.binary())}
                    if decoded:
                        row["decoded"] = pa.array([_bytes_of(x.astype(np.int64), path) for x in mine], pa.binary())
                    yield pa.RecordBatch.from_pydict(row)

    ids_type = pa.list_({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])
    packed = f"block binary, kind int, seq int, ids array<{kind}>, numbers binary, lens binary, blob binary"
    answers = src.mapInArrow(words, "bucket int, block binary, numbers binary, lens binary, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, packed)
    documents = src.mapInArrow(positions, packed)
    parts = max(answers.sparkSession.sparkContext.defaultParallelism * 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = answers.union(documents).repartition(parts, "block").sortWithinPartitions("block", "kind", "seq")
    return met.mapInArrow(reassemble, f"id {kind}, n_tokens bigint, ids binary{', decoded binary' if decoded else ''}").withColumnRenamed("id", id_col)


def _bytes_of(ids: np.ndarray, path: str) -> bytes:
    """The token-byte table at each id, end to end."""
    data, starts, lens = _token_bytes(path)
    if len(ids) and (int(ids.max()) >= len(lens) or not lens[ids].all()):
        raise ValueError("an id has no token")
    return data[spread(starts[ids], lens[ids])].tobytes()


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and count of ids by number, and all ids."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    numbers = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    starts, n_ids = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    starts[numbers] = np.cumsum(counts) - counts
    n_ids[numbers] = counts
    return starts, n_ids, np.concatenate([p[2] for p in parts])


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its packed ids; null ids give null bytes, an id without a token is an error."""
    path = path or vocabulary_path()
    at = encoded.columns.index(ids_col)

    def run(batches):
        for b in batches:
            for some in range(0, b.num_rows, 256):
                part = b.slice(some, 256)
                out = [_bytes_of(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64), path) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, out_col])

    return encoded.mapInArrow(run, encoded.withColumn(out_col, F.lit(b"")).schema)


def as_array(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its packed ids as array<bigint>."""
    at = encoded.columns.index(ids_col)

    def run(batches):
        for b in batches:
            got = [None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(got, pa.list_(pa.int64())), *b.columns[at + 1 :]], names=b.schema.names)

    return encoded.mapInArrow(run, encoded.withColumn(ids_col, F.array(F.lit(0).cast("bigint"))).schema)
