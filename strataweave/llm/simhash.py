"""SimHash near-duplicates: ball hashing that meets in the middle.

A document's fingerprint takes the majority of the 64 bits of XXH64 over its word shingles. Two
fingerprints within ``radius`` bits have a common point within ``radius // 2`` of both (radius even), so every
fingerprint emits all points of that ball (1 + 64 + 2016 for radius 4) and equal points meet.

A point names its bucket by a linear hash over GF(2): H(fp ^ mask) = H(fp) ^ H(mask). The points of one
fingerprint in one bucket are therefore known from the fingerprint alone, and the shuffle carries one
8-byte fingerprint for all of them; the receiving task lists the points again, in passes of bounded
size. All fingerprints that meet in one point lie within ``radius`` of each other, so a chain along the
group loses no component; ``verify`` still compares each linked pair.

The hash adds up bits in groups (bit i of a bucket's number is the parity of one group of fingerprint bits), so the points of a ball
of radius 2 fall into 1 + bits + bits * (bits - 1) / 2 buckets at most, 137 for 16 bits, not into as many as there are points.

Bounds: ``_bucket_bits`` makes so many buckets that one expects ``BUCKET`` fingerprints at most, ``PASS`` points per sort. Equal
fingerprints are collapsed before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataweave.core.session import bounded_batches, cut_lineage
from strataweave.core.skew import hot_keys, salted_join
from strataweave.plans.graph import connected_components

SEED = 42
PASS = 1 << 20
BUCKET = 1 << 21  # fingerprints that a bucket holds on average: 16 MB, of which the receiver has a few copies
PIECE = 1 << 22  # bytes of a long text that are split into words at once


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, in runs from pieces of bounded size cut at white space."""
    if len(text) <= PIECE:
        yield text.lower().split()
        return
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].lower()
        last = at + PIECE >= len(text)
        words = piece.split()
        rest = b""
        if not last and words and not piece[-1:].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of one text; null or no words: zero; fewer words than a shingle: the whole sequence."""
    import xxhash

    digest = xxhash.xxh64_digest
    ones, n, kept = np.zeros(64, np.int64), 0, []
    for words in _pieces(text or b""):
        words = kept + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(bits)
            words = words[len(words) - shingle + 1 :] if shingle > 1 else []
        kept = words
    if not n:
        if not kept:
            return 0
        ones += np.unpackbits(np.frombuffer(digest(b" ".join(kept), SEED), np.uint8))
        n = 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per document; extra columns are left behind."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _masks(half: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


def _columns(bits: int, fold: int) -> np.ndarray:
    """64 words of ``bits`` bits, the columns of the linear hash: the low ``fold`` bits are parities of groups of fingerprint bits, the others pseudo-random."""
    z = (np.arange(1, 65, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    high = (z ^ (z >> np.uint64(31))) & np.uint64(((1 << bits) - 1) ^ ((1 << fold) - 1))
    return (high | (np.uint64(1) << (np.arange(64, dtype=np.uint64) * np.uint64(37) % np.uint64(64) % np.uint64(fold)))).astype(np.uint32)


def _linear(x: np.ndarray, bits: int, fold: int | None = None) -> np.ndarray:
    """H over GF(2), a byte of x at a time; its low ``fold`` bits (all by default) name the bucket."""
    col, out = _columns(bits, fold or bits), np.zeros(len(x), np.uint32)
    for byte in range(8):
        lut = np.zeros(256, np.uint32)
        for bit in range(8):
            lut[(np.arange(256) >> bit) & 1 == 1] ^= col[8 * byte + bit]
        out ^= lut[((x >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)]
    return out


def _bucket_bits(n: int, half: int) -> int:
    """The fewest bits (6 at least) for which ``n`` fingerprints, each sent to all buckets of its ball, fill a bucket with ``BUCKET`` on average at most."""
    return next(b for b in range(6, 33) if b == 32 or n * sum(comb(b, k) for k in range(half + 1)) <= BUCKET << b)


def _meet(fps: np.ndarray, bucket: int, bits: int, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) that span the groups meeting in one bucket: a forest, at most one link per fingerprint."""
    masks = _masks(half)
    extra = max(0, int(np.ceil(np.log2(max(1, len(fps) * len(masks) / 2**bits / PASS)))))
    full = bits + extra
    h = _linear(masks, full, bits)
    order = np.argsort(h, kind="stable")
    masks, h = masks[order], h[order]
    own = _linear(fps, full, bits)
    parent = np.arange(len(fps))
    for p in range(1 << extra):
        c = own ^ np.uint32((p << bits) | bucket)
        lo = np.searchsorted(h, c, "left")
        k = np.searchsorted(h, c, "right") - lo
        at = np.repeat(np.arange(len(fps), dtype=np.int64), k)
        step = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
        points = fps[at] ^ masks[np.repeat(lo, k) + step]
        s = np.sort(points)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, points), len(twice) - 1)] == points)
        hit = hit[np.lexsort((at[hit], points[hit]))]
        who, what = at[hit], points[hit]
        same = what[1:] == what[:-1]
        a, b = who[:-1][same], who[1:][same]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius  # verify
        _union(parent, a[near], b[near])
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[parent[linked]], fps[linked]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the ends of all pairs; every entry then points to the smallest index of its set."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        ra, rb = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(src, dst) over distinct fingerprints ``fps(fp)``, of which there are ``n``: their components are those of all pairs within ``radius``."""
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: both halves of a link then have the same ball")
    half = radius // 2
    bits = _bucket_bits(n, half)

    def emit(batches):
        keys = np.unique(_linear(_masks(half), bits))
        step = max(1, PASS // len(keys))
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), step):
                fps = all_fps[at : at + step]
                to = (_linear(fps, bits)[:, None] ^ keys[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                sent, to = np.repeat(fps, len(keys))[order], to[order]
                heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[heads[1:], len(to)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[heads].astype(np.int32)), pa.array([sent[i:j].tobytes() for i, j in zip(heads, ends)], pa.binary())],
                    names=["bucket", "fps"],
                )

    def meet(key, t):
        fps = np.unique(np.frombuffer(b"".join(t.column("fps").to_pylist()), np.uint64))
        a, b = _meet(fps, key[0].as_py(), bits, half, radius)
        return pa.table({"src": pa.array(a.view(np.int64)), "dst": pa.array(b.view(np.int64))})

    # as many tasks as there are buckets: their bytes are few for the work they make, so they are not to be merged by size
    tasks = min(max(1 << bits, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 20_000)
    return fps.select("fp").mapInArrow(emit, "bucket int, fps binary").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(meet, "src bigint, dst bigint")


def _groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame, list, DataFrame]:
    """(id, fp) of every row; (fp, root, component_id) of every fingerprint; the roots that many fingerprints share; rows for each fingerprint (fp, n)."""
    found = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    counts = found.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    counts = cut_lineage(counts)
    comp = connected_components(links(counts, counts.count(), radius))
    roots = counts.join(comp, counts["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    hot_roots = hot_keys(lowest.select("root", F.col("members").alias("n")), "root")
    of_fp = salted_join(roots.select("fp", "root"), lowest.select("root", "component_id"), "root", F.col("fp"), hot_roots).select("fp", "root", "component_id")
    return found, of_fp, hot_keys(counts, "fp"), counts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row: ``component_id`` is the smallest id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay. A
    null id is kept and never wins a minimum (a component of null ids only has a null component_id).
    """
    found, of_fp, hot, _ = _groups(docs, id_col, text_col, shingle, radius)
    return salted_join(found, of_fp.drop("root"), "fp", F.col("id"), hot).select(F.col("id").alias(id_col), "fp", "component_id")


def _with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with a column ``_fp``."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*b.schema.names[:-1], "_fp"])

    schema = StructType([*docs.schema.fields, StructField("_fp", LongType())])
    return docs.select(*docs.columns, F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **how) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest (null ids are kept).

    Of an id over several texts, each row is held against the component of its own text. Rows equal in id and fingerprint stay together.
    """
    near = near_duplicates(docs, id_col, text_col, shingle, **how)
    own = F.col(id_col) == F.col("component_id")
    ids = cut_lineage(near.groupBy(id_col).agg(F.min(own).alias("each"), F.max(own).alias("some")).where("not each"))
    plain = docs.join(ids.select(id_col), id_col, "left_anti")
    mixed = ids.where("some").select(id_col)
    if mixed.isEmpty():
        return plain
    kept = near.where(own).join(mixed, id_col, "left_semi").select(F.col(id_col).alias("_id"), F.col("fp").alias("_fp")).distinct()
    again = _with_fingerprint(docs.join(mixed, id_col, "left_semi").select(*docs.columns), text_col, shingle)
    return plain.union(again.join(kept, (F.col(id_col) == F.col("_id")) & (again["_fp"] == kept["_fp"]), "left_semi").select(*plain.columns))


def keep_one_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Exactly one row of ``docs`` for each component: of the rows with its smallest id (of all its rows, if no id is known) the first by fingerprint, text and the other columns as JSON.

    So repeated rows, repeated ids and rows without an id leave one document a group too. Only rows of repeated or null ids
    are fingerprinted twice; the others are decided by their id. An empty table stays empty; other columns pass through, whatever their names.
    """
    found, of_fp, hot, counts = _groups(docs, id_col, text_col, shingle, radius)
    near = salted_join(found, of_fp, "fp", F.col("id"), hot)
    own = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    ids = cut_lineage(near.where("id is not null").groupBy(F.col("id").alias(id_col)).agg(F.min(own).alias("each"), F.count("*").alias("n")).where("not each or n > 1"))
    plain = docs.where(F.col(id_col).isNotNull()).join(ids.select(id_col), id_col, "left_anti").select(*docs.columns)
    several = ids.where("n > 1").select(id_col)
    if several.isEmpty() and docs.where(F.col(id_col).isNull()).isEmpty():
        return plain
    again = docs.where(F.col(id_col).isNull()).union(docs.join(several, id_col, "left_semi").select(*docs.columns))
    row = F.struct(*map(F.col, docs.columns))
    again = _with_fingerprint(again.select(row.alias("_row"), F.col(text_col).alias("_words")), "_words", shingle).drop("_words").withColumnRenamed("_fp", "fp")
    again = salted_join(again, of_fp, "fp", F.xxhash64(f"_row.{text_col}"), hot)
    others = [F.col(f"_row.{c}") for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.col("fp"), F.col(f"_row.{text_col}"), F.to_json(F.struct(*others)) if others else F.lit(""))
    fit = again.where(F.col("component_id").isNull() | (F.col(f"_row.{id_col}") == F.col("component_id")))
    return plain.union(fit.groupBy("root").agg(F.min_by("_row", order).alias("_row")).select("_row.*"))


def hex16(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
