"""Ways to deal work out: hash shards, weighted bins, bands, chunks, and the checks that they cover everything once."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import floor_div, hash_shard


def lpt_bins(weights: list[tuple[str, float]], n: int) -> dict[str, int]:
    """Longest processing time first: the heaviest item (ties by name) goes to the lightest bin (ties by fewest items, then number). A plan over pages, of bounded size, made on the driver."""
    bins = [(0.0, 0, k) for k in range(max(1, min(n, len(weights)) or 1))]
    out = {}
    for name, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        load, size, k = heapq.heappop(bins)
        out[name] = k
        heapq.heappush(bins, (load + w, size + 1, k))
    return out


def lpt_loads(counts: list[tuple[float, int]], n: int) -> list[tuple[int, float]]:
    """(items, load) of each bin of ``lpt_bins`` over items given as (weight, how many): equal weights are dealt alike whatever their names, so memory follows the distinct weights."""
    bins = [(0.0, 0, k) for k in range(max(1, min(n, sum(c for _, c in counts)) or 1))]
    for w, c in sorted(counts, reverse=True):
        for _ in range(c):
            load, size, k = bins[0]
            heapq.heapreplace(bins, (load + w, size + 1, k))
    return [(size, load) for load, size, _ in sorted(bins, key=lambda b: b[2])]


def page_weight(geometry, vertical, material, text):
    """1 + 8 g + 2 v + 2 m + .02 t, for columns or numbers."""
    return 1 + 8 * geometry + 2 * vertical + 2 * material + 0.02 * text


def template_weight(text: Column) -> Column:
    """Of a page that has templates only: .25, and .02 a text, 2 at most."""
    return 0.25 + F.least(F.lit(2.0), 0.02 * text)


MOST_RUNNERS = 20


def affine_shard(affinity: Column, content_hash: Column, shards: int) -> Column:
    """The shard that fetched a document, else one by its content hash; at most ``MOST_RUNNERS`` shards."""
    n = max(1, min(MOST_RUNNERS, int(shards)))
    return F.coalesce(F.when(F.size(affinity) > 0, F.pmod(F.array_min(affinity), F.lit(n))), hash_shard(content_hash, n)).cast("int")


def bands(min_c: int, max_c: int, n: int) -> list[tuple[int, int]]:
    """Consecutive bands of the axis, sizes at most one apart."""
    size = max_c - min_c + 1
    n = max(1, min(n, size))
    return [(min_c + i * size // n, min_c + (i + 1) * size // n - 1) for i in range(n)]


def band_of(c, min_c: int, max_c: int, n: int):
    """Column: the band that holds coordinate ``c``."""
    size = max_c - min_c + 1
    n = max(1, min(n, size))
    return F.floor(((c - min_c + 1) * n - 1) / float(size)).cast("int")


def chunk_keys(df: DataFrame, x: str = "x", z: str = "z", y: str | None = None, size: int = 16) -> DataFrame:
    out = df.withColumns({"cx": floor_div(x, size), "cz": floor_div(z, size)})
    return out.withColumn("cy", floor_div(y, size)) if y else out


def split_boxes(df: DataFrame, size: int = 16) -> DataFrame:
    """Boxes of whole cells (x1, z1, x2, z2) cut at chunk borders."""
    d = df.withColumn("cx", F.explode(F.sequence(floor_div("x1", size), floor_div("x2", size)))).withColumn("cz", F.explode(F.sequence(floor_div("z1", size), floor_div("z2", size))))
    return d.withColumns({"x1": F.greatest("x1", F.col("cx") * size), "x2": F.least("x2", F.col("cx") * size + size - 1), "z1": F.greatest("z1", F.col("cz") * size), "z2": F.least("z2", F.col("cz") * size + size - 1)})


def coverage_faults(expected: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """(key, fault): keys that no shard has ('missing'), that several have ('duplicate'), or that were not expected ('unexpected')."""
    n = shards.groupBy(key).agg(F.count("*").alias("n"))
    j = expected.select(key).distinct().withColumn("e", F.lit(True)).join(n, key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def document_queue(docs: DataFrame, priority: str, key: str, limit: int = 25_000) -> tuple[DataFrame, DataFrame]:
    """(queue, truncated?): the first ``limit`` by priority, then key; a queue has a cap by contract, and says so when it bites."""
    n = docs.select(F.count("*").alias("n"))
    return docs.orderBy(F.col(priority).desc(), key).limit(limit), n.select((F.col("n") > limit).alias("truncated"))
