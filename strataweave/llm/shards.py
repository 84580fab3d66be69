"""Shards cut from a Hilbert ordering of several metadata columns, so that files prune on each of them.

Every dimension is quantised to ``2**bits`` cells: categories by a hash (equal values share a cell), numbers by the logarithm of
their size. The global position of a row is found without a global sort: rows are counted per curve index, of which there are at
most 2**(dims*bits), and a cell is dealt by a hash into so many buckets that one holds about ``PER_BUCKET`` rows, ``SUB`` at least. Running sums over
the buckets' counts give each its offset, and rows are numbered within their bucket. A hot cell (one source with a third of all rows) is
thus spread over as many tasks as its rows need, at any size.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.hilbert import with_hilbert

BITS = 4
SUB = 64
PER_BUCKET = 1 << 16


def category_cell(c: Column | str, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")


def log_cell(c: Column, bits: int = BITS, largest: float = 1e9) -> Column:
    """Equal steps of the logarithm up to ``largest``; null is 0."""
    x = F.coalesce(c.cast("double"), F.lit(0.0))
    step = F.floor(F.log1p(F.greatest(x, F.lit(0.0))) / F.log1p(F.lit(largest)) * (1 << bits))
    return F.least(step, F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, cells: dict[str, Column], n_shards: int, tie: list[str], bits: int = BITS, sub: int = SUB, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``docs`` with ``_shard`` (0 to n_shards-1), ``_slot`` (gapless from 0 in the shard) and ``_curve``.

    Rows in curve order are cut into runs whose row counts differ by one at most. Ties within a curve index are broken by the hash of
    the ``tie`` columns, then by them; rows equal in all of those are alike, so it makes no difference which comes first. Nulls
    have their own place. An empty table gives no row; extra columns pass through, whatever their names, but ``_shard``, ``_slot`` and ``_curve``,
    which are replaced.
    """
    mark = "_"
    while any(c.startswith(f"{mark}hs_") for c in docs.columns):
        mark += "_"
    cell_of, bucket, dealt, n, at, before_it, inside, total = (f"{mark}hs_{x}" for x in ("cell", "bucket", "dealt", "n", "at", "before", "inside", "total"))
    names = [f"{mark}hs_{i}" for i in range(len(cells))]
    df = docs.drop("_shard", "_slot", "_curve").withColumns(dict(zip(names, cells.values())))
    df = with_hilbert(df, names, bits, cell_of).drop(*names)
    # at most 2**(dims*bits) rows, whatever the table's size: they may meet in one window and be broadcast
    cell = df.groupBy(cell_of).agg(F.count("*").alias(n))
    before = Window.orderBy(cell_of).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(cell_of).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cell = cell.select(cell_of, F.greatest(F.lit(sub), F.ceil(F.col(n) / per_bucket)).cast("int").alias(dealt), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(at), F.sum(n).over(everything).alias(total))
    df = df.join(F.broadcast(cell), cell_of).withColumn(bucket, F.pmod(F.xxhash64(*tie), F.col(dealt)).cast("int"))
    counts = df.groupBy(cell_of, bucket).agg(F.count("*").alias(n))
    within = Window.partitionBy(cell_of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(cell_of, bucket, F.coalesce(F.sum(n).over(within), F.lit(0)).alias(before_it))
    order = Window.partitionBy(cell_of, bucket).orderBy(*[F.col(t) for t in tie])
    ranked = df.withColumn(inside, F.row_number().over(order) - 1).join(starts, [cell_of, bucket])
    rank = f"({at} + {before_it} + {inside})"
    # whole numbers: a quotient of doubles may fall on the wrong side of a cut
    shard, first = f"({rank} * {n_shards} div {total})", f"(({rank} * {n_shards} div {total}) * {total} + {n_shards - 1}) div {n_shards}"
    return ranked.select(*[c for c in docs.columns if c not in ("_shard", "_slot", "_curve")], F.expr(f"cast({shard} as int)").alias("_shard"), F.expr(f"cast({rank} - {first} as bigint)").alias("_slot"), F.col(cell_of).alias("_curve"))


def document_cells() -> dict[str, Column]:
    """The dimensions for documents: source, language, length."""
    return {"source": category_cell("source"), "lang": category_cell("lang"), "n_chars": log_cell(F.col("n_chars"))}


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order: readers skip files and row groups on every dimension."""
    kept = [c for c in sharded.columns if c not in ("_shard", "_slot", "_curve")]
    by = sharded.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    by.select(*kept, F.col("_shard").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)
