"""Connected components over an edge table, by alternating large-star and small-star rounds.

The centre of a large star has as many edges as its component has nodes; the joins deal the edges of such nodes over salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage
from strataweave.core.skew import hot_keys, salted_join


def _digest(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _lowest(edges: DataFrame) -> tuple[DataFrame, list]:
    """(u, m): the smallest neighbour of each node; and the nodes with a large share of the edges."""
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return found.drop("n"), hot_keys(found, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, hot = _lowest(both)
    low = low.withColumn("m", F.least("u", "m"))
    return salted_join(both.where("v > u"), low, "u", F.col("v"), hot, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low, hot = _lowest(down)
    linked = salted_join(down, low, "u", F.col("v"), hot, "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def node_degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, degree) of the ends of distinct edges: both ends of an edge are sent once, counted before the shuffle."""
    ends = edges.select(src, dst).distinct().select(F.explode(F.array(src, dst)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node of its component.

    Self-loops and null ends are ignored; nodes without other edges do not appear. The rounds run as
    shuffles on node ids with a reliable checkpoint each, so nothing is gathered on the driver, and their
    number grows with the logarithm of the longest chain.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = cut_lineage(e)
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = cut_lineage(_small_star(cut_lineage(_large_star(e))))
        now = _digest(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
