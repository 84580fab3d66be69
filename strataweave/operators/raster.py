"""Cells and voxels: last writer wins, neighbourhoods, distance, thinning, sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage

CELL = ["x", "y", "z"]


def last_writer(ops: DataFrame, cell: list[str] = CELL, phase: str = "phase", seq: str = "seq", value: str = "block") -> DataFrame:
    """The value written last to each cell: by phase, then insertion, ties by the greatest value. An aggregate with partial maxima, no sort."""
    return ops.groupBy(*cell).agg(F.max(F.struct(phase, seq, value)).alias("_m")).select(*cell, F.col(f"_m.{value}").alias(value), F.col(f"_m.{phase}").alias(phase))


def expand_boxes(ops: DataFrame) -> DataFrame:
    """Boxes (x1..z2) to cells; cut them at chunks first, so that a row makes at most 16 x 16 x height cells."""
    d = ops
    for a in CELL:
        d = d.withColumn(a, F.explode(F.sequence(f"{a}1", f"{a}2")))
    return d.drop(*[f"{a}{k}" for a in CELL for k in (1, 2)])


def terrain_top(cells: DataFrame) -> DataFrame:
    """Highest y of the ground phases (up to 1) by column."""
    return cells.where("phase <= 1").groupBy("x", "z").agg(F.max("y").alias("top"))


def above_terrain(cells: DataFrame, top: DataFrame) -> DataFrame:
    """(accepted or reason) for overlay cells: 'below-terrain' at or under the ground, 'no-terrain' where there is none, 'air'."""
    j = cells.join(top, ["x", "z"], "left")
    return j.withColumn("status", F.when(F.col("top").isNull(), "no-terrain").when(F.col("y") <= F.col("top"), "below-terrain").when(F.col("block") == "air", "air").otherwise("accepted")).drop("top")


def neighbours(cells: DataFrame, key: list[str], radius: int = 1, include_self: bool = False) -> DataFrame:
    """Each cell with the value of every cell around it that exists: (key, x, z, value, near)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if include_self or i or j])
    sent = cells.withColumn("_s", F.explode(steps)).select(*key, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("z") + F.col("_s.j")).alias("z"), F.col("value").alias("near"))
    return cells.join(sent, [*key, "x", "z"])


def median_conform(cells: DataFrame, key: list[str], limit: float, rounds: int = 2) -> DataFrame:
    """Each round moves a value to the median of its 3 x 3 neighbourhood, by at most ``limit``."""
    for _ in range(rounds):
        m = neighbours(cells, key, include_self=True).groupBy(*key, "x", "z").agg(F.first("value").alias("value"), F.median("near").alias("m"))
        cells = m.select(*key, "x", "z", (F.col("value") + F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("m") - F.col("value")))).alias("value"))
    return cells


def refine_mask(mask: DataFrame, key: list[str], fill: int = 6, drop: int = 1) -> DataFrame:
    """(key, x, z, seed) cells that are set: unset cells with ``fill`` set neighbours are added, set ones with at most ``drop`` removed unless they are seeds."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    votes = mask.withColumn("_s", F.explode(steps)).select(*key, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("z") + F.col("_s.j")).alias("z")).groupBy(*key, "x", "z").agg(F.count("*").alias("n"))
    j = mask.withColumn("_set", F.lit(True)).join(votes, [*key, "x", "z"], "full")
    n, is_set = F.coalesce("n", F.lit(0)), F.coalesce("_set", F.lit(False))
    return j.where(F.when(is_set, F.coalesce("seed", F.lit(False)) | (n > drop)).otherwise(n >= fill)).select(*key, "x", "z", F.coalesce("seed", F.lit(False)).alias("seed"))


def interior_steps(mask: DataFrame, key: list[str], max_rounds: int = 64) -> DataFrame:
    """(key, x, z, step): rounds that a fire from the edge takes to a cell (4-neighbours); one distributed pass per round."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    left, done, cell = cut_lineage(mask.select(*key, "x", "z").distinct()), None, [*key, "x", "z"]
    for r in range(max_rounds):
        if left.isEmpty():
            break
        votes = left.withColumn("_s", F.explode(steps)).select(*key, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("z") + F.col("_s.j")).alias("z")).groupBy(*cell).agg(F.count("*").alias("n"))
        inner = cut_lineage(left.join(votes.where("n = 4"), cell, "left_semi"))
        edge = left.join(inner, cell, "left_anti").withColumn("step", F.lit(r))
        done = edge if done is None else done.unionByName(edge)
        left = inner
    else:
        raise RuntimeError("the mask is thicker than max_rounds")
    return done if done is not None else left.withColumn("step", F.lit(0))


def depth_ramp(steps: DataFrame, key: list[str], max_depth: int) -> DataFrame:
    w = Window.partitionBy(*key)
    return steps.withColumn("depth", F.greatest(F.lit(1.0), F.floor(max_depth * (F.col("step") + 1) / (F.max("step").over(w) + 1) + 0.5)).cast("int"))


def bilinear(points: DataFrame, grid: DataFrame, size: float = 1.0) -> DataFrame:
    """Values of the grid (gx, gz, value) at points (x, z): the four cells around, those that exist weighted anew; null where none does."""
    fx, fz = F.col("x") / size, F.col("z") / size
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    p = points.withColumn("_p", F.monotonically_increasing_id()).withColumn("_c", F.explode(corner))
    p = p.withColumns({"gx": (F.floor(fx) + F.col("_c.i")).cast("bigint"), "gz": (F.floor(fz) + F.col("_c.j")).cast("bigint")})
    wx = F.when(F.col("_c.i") == 1, fx - F.floor(fx)).otherwise(1 - (fx - F.floor(fx)))
    wz = F.when(F.col("_c.j") == 1, fz - F.floor(fz)).otherwise(1 - (fz - F.floor(fz)))
    j = p.withColumn("_w", wx * wz).join(grid.where("value is not null"), ["gx", "gz"], "left")
    w = F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))
    return j.groupBy(*points.columns, "_p").agg((F.sum(F.col("_w") * F.col("value")) / F.nullif(w, F.lit(0.0))).alias("value")).drop("_p")


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest unset cell in tenths of a cell, 10 straight and 14 diagonal, by two sweeps."""
    h, w = mask.shape
    d = np.where(mask, 10**6, 0).astype(np.int64)
    d = np.pad(d, 1, constant_values=10**6)
    for ys, xs, near in ((range(1, h + 1), range(1, w + 1), ((-1, -1, 14), (-1, 0, 10), (-1, 1, 14), (0, -1, 10))), (range(h, 0, -1), range(w, 0, -1), ((1, 1, 14), (1, 0, 10), (1, -1, 14), (0, 1, 10)))):
        for y in ys:
            for x in xs:
                if d[y, x]:
                    d[y, x] = min(d[y, x], *(d[y + a, x + b] + c for a, b, c in near))
    return d[1:-1, 1:-1]


def thin(mask: np.ndarray) -> np.ndarray:
    """One-cell-wide skeleton: both half-steps of parallel thinning until nothing changes."""
    m = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for odd in (0, 1):
            n, ne, e, se, s, sw, w, nw = (np.roll(m, k, (0, 1)) for k in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            ring = [n, ne, e, se, s, sw, w, nw]
            count = sum(ring)
            turns = sum((a == 0) & (b == 1) for a, b in zip(ring, ring[1:] + ring[:1]))
            side = (n * e * s == 0) & (e * s * w == 0) if not odd else (n * e * w == 0) & (n * s * w == 0)
            gone = (m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & side
            if gone.any():
                m[gone], changed = 0, True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def weighted_pick(weights: dict[str, float], u: Column) -> Column:
    """The entry at share ``u`` in [0, 1) of the cumulative weights, in the given order."""
    total, run, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        run += w / total
        out = F.when(u < run, name) if out is None else out.when(u < run, name)
    return out.otherwise(list(weights)[-1])
