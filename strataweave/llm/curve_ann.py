"""Approximate nearest neighbours along several Hilbert curves.

Each of ``curves`` curves orders all vectors by the Hilbert index of a random orthonormal projection to a few
dimensions, scaled by the quantiles of a bounded sample. Quantiles of the sample's keys cut a curve into blocks
(a hash of the vector follows the curve index, so that equal indices are cut too). Rows are range-partitioned by
(curve, block); a query goes to the blocks within ``reach`` of its own on every curve, is compared there with whole
blocks by exact distance, and the lists of all blocks and curves merge.

The window is a share of the table, so the work grows as queries x rows: vectors without low-dimensional structure
have no neighbours that a window of constant length would find (see the README for the recall measured). It covers at
least ``LEAST`` distinct vectors a side; a smaller table is searched whole.

Equal vectors are one entry that carries its smallest ids, so copies are neither compared nor repeated. Vectors of different length have no
distance: those of each length are searched among themselves. Vectors of floats travel as floats; distances are doubles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from strataweave.core.session import cut_lineage
from strataweave.core.skew import hot_keys, salted_join
from strataweave.llm.hilbert import hilbert_index

CURVES, DIMS, BITS = 24, 8, 4
BLOCKS, WINDOW = 128, 0.03
LEAST, LEAST_BLOCK = 256, 64
BLOCK_ROWS = 4096
SAMPLE = 16_384


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) that take part: no null, non-finite or zero vectors, no null ids."""
    v = F.col(vec_col)
    fit = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("vec"))
    return good


class Curves:
    """Projections, scales and cuts of all curves, from a sample of the distinct vectors."""

    def __init__(self, sample: np.ndarray, total: int, curves: int, dims: int, bits: int, window: float, seed: int = 11):
        n, d = sample.shape
        rng = np.random.default_rng(seed)
        self.bits, self.dims = bits, min(dims, d)
        self.planes = [np.linalg.qr(rng.normal(size=(d, self.dims)))[0] for _ in range(curves)]
        self.scales = [np.quantile(sample @ p, np.arange(1, 1 << bits) / (1 << bits), axis=0).T for p in self.planes]
        self.blocks = max(BLOCKS, -(-total // BLOCK_ROWS))
        self.reach = max(1, round(window * self.blocks))
        if self.reach * (total // self.blocks) < LEAST:
            self.blocks = max(1, min(self.blocks, total // LEAST_BLOCK))
            self.reach = -(-LEAST // (total // self.blocks))
        at = np.minimum(np.arange(1, self.blocks) * n // self.blocks, n - 1)
        self.cuts = [np.sort(self.key(c, sample))[at] for c in range(curves)]

    def key(self, c: int, x: np.ndarray) -> np.ndarray:
        """Curve index, then 31 bits of the vector's own hash."""
        y = x @ self.planes[c]
        cells = np.stack([np.searchsorted(s, y[:, i], "right") for i, s in enumerate(self.scales[c])], axis=1)
        with np.errstate(over="ignore"):
            h = (np.ascontiguousarray(x).view(np.uint64) * np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)
            h = ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
        return (hilbert_index(cells, self.bits) << 31) | h.astype(np.int64)

    def block(self, c: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts[c], self.key(c, x), "right")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=-1))


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows that may be among its k nearest, with exact distances: a product screens, a bound on its rounding keeps all that it can't tell apart."""
    mid = x.mean(axis=0)
    qc, xc = q - mid, x - mid
    qn, xn = (qc**2).sum(axis=1), (xc**2).sum(axis=1)
    d2 = qn[:, None] + xn[None] - 2 * qc @ xc.T
    slack = 1e-12 * (qn[:, None] + xn.max())
    out = []
    for i in range(len(q)):
        edge = np.partition(d2[i], k - 1)[k - 1] if k < len(x) else np.inf
        near = np.flatnonzero(~(d2[i] > edge + slack[i]))
        d = exact(q[i], x[near])
        if len(near) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            near, d = near[keep], d[keep]
        out.append((near, d))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest found for each row of ``is_query`` (over the id column), ties to the smaller id.

    All rows are candidates but the query's own. Rows that ``clean`` leaves out take no part. Repeated ids with the same vector
    count once. Extra columns are not looked at.
    """
    spark = vectors.sparkSession
    good = clean(vectors, id_col, vec_col).distinct().withColumns({"v": F.xxhash64("vec"), "d": F.size("vec")})
    good = cut_lineage(good)
    query_ids = vectors.where(is_query & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    lengths = [r[0] for r in good.join(query_ids, "id").select("d").distinct().orderBy("d").collect()]
    kind = np.dtype("<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "<f8")
    found = [_search(spark, good.where(F.col("d") == d), query_ids, d, k, curves, window, kind) for d in lengths]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance double")


def _search(spark: SparkSession, good: DataFrame, query_ids: DataFrame, d: int, k: int, curves: int, window: float, kind: np.dtype) -> DataFrame:
    """``search`` among vectors of one length ``d``: good(id, vec, v)."""
    low = Window.partitionBy("vec").orderBy("id")
    few = good.withColumn("rn", F.row_number().over(low)).where(F.col("rn") <= k + 1)
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = good.join(query_ids, "id").select("id", "vec")
    entries = entries.join(asked.select("vec").distinct().withColumn("q", F.lit(True)), "vec", "left")
    entries = cut_lineage(entries.select(F.col("ids")[0].alias("e"), "ids", "vec", F.coalesce("q", F.lit(False)).alias("q")))
    total = entries.count()
    some = entries.orderBy(F.xxhash64("e")).limit(SAMPLE).select("vec").toArrow()
    sample = np.array(some.column(0).combine_chunks().values.to_numpy()).reshape(-1, d)
    sent = spark.sparkContext.broadcast(Curves(sample, total, curves, DIMS, BITS, window))

    def deal(batches):
        c = sent.value
        for b in batches:
            e, q = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            x = np.array(b.column(1).flatten().to_numpy()).reshape(-1, d)
            for i in range(curves):
                block = c.block(i, x)
                yield rows(i * c.blocks + block, e, x, np.zeros(len(e), bool))
                for s in range(-c.reach, c.reach + 1):
                    to = block + s
                    ok = q & (to >= 0) & (to < c.blocks)
                    if ok.any():
                        yield rows(i * c.blocks + to[ok], e[ok], x[ok], np.ones(int(ok.sum()), bool))

    def rows(slot, e, x, asks):
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(e), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(asks)], names=["slot", "e", "vec", "asks"])

    def compare(batches):
        """Rows sorted by slot, a slot at a time."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            slots = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
            for x, y in zip(cuts, cuts[1:]):
                part = b.slice(x, y - x)
                if held and part.num_rows and held[0].column(0)[0] != part.column(0)[0]:
                    yield from slot_of(held)
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from slot_of(held)

    def slot_of(held):
        t = pa.Table.from_batches(held)
        e, asks = t.column("e").to_numpy(), t.column("asks").to_numpy()
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).astype(np.float64).reshape(-1, d)
        if not asks.any() or asks.all():
            return
        base, own = x[~asks], e[~asks]
        for at in range(0, int(asks.sum()), 256):
            qx, qe = x[asks][at : at + 256], e[asks][at : at + 256]
            found = _nearest(qx, base, k + 1)
            n = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qe, n)), pa.array(np.concatenate([own[f[0]] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["qe", "e", "distance"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * curves // 50_000))
    dealt = entries.select("e", "vec", "q").mapInArrow(deal, "slot int, e bigint, vec binary, asks boolean")
    near = dealt.repartitionByRange(parts, "slot").sortWithinPartitions("slot").mapInArrow(compare, "qe bigint, e bigint, distance double")
    best = Window.partitionBy("qe").orderBy("distance", "e")
    top = near.groupBy("qe", "e").agg(F.min("distance").alias("distance")).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    lists = top.join(entries.select("e", "ids"), "e").groupBy("qe").agg(F.collect_list(F.struct("distance", "ids")).alias("found"))
    # each query row takes its vector's list: a vector may be asked by many rows
    by_vec = entries.where("q").select(F.xxhash64("vec").alias("v"), F.col("vec").alias("qvec"), F.col("e").alias("qe"))
    who = asked.select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("v"), "vec")
    hot = hot_keys(who.groupBy("v").agg(F.count("*").alias("n")), "v")
    one = salted_join(who, by_vec.join(lists, "qe"), "v", F.col("query_id"), hot, "inner").where(F.col("vec") == F.col("qvec"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["distance"].alias("distance"), i.alias("id")))))
    first = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("query_id"))), 1, k)
    out = one.select("query_id", F.posexplode(first).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.distance").alias("distance"))
