"""Lines, skeletons and outlines on grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.geometry import resample
from strataweave.operators.ordered import runs


def line_3d(p: tuple[int, int, int], q: tuple[int, int, int]) -> np.ndarray:
    """Voxels from p to q, one step of the longest axis at a time."""
    p, q = np.array(p), np.array(q)
    n = max(1, int(np.abs(q - p).max()))
    return np.unique(np.floor(p + (q - p) * (np.arange(n + 1) / n)[:, None] + 0.5).astype(np.int64), axis=0)


def tapered_cells(points: np.ndarray, start: float, end: float, step: float = 2.0) -> np.ndarray:
    """Cells of a line whose width goes from start to end along its length."""
    from strataweave.functions.geometry import band_cells

    p = resample(np.asarray(points, float), step, carry=False)
    run = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    out = [band_cells(p[i : i + 2], start + (end - start) * (run[i] + run[i + 1]) / 2 / (run[-1] or 1)) for i in range(len(p) - 1)]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def keep_free(line: np.ndarray, blocked, spacing: float = 0.5, least: float = 0.1) -> list[np.ndarray]:
    """Pieces of a line whose half-metre steps have unblocked midpoints; ``blocked`` tells it for an array of points."""
    p = resample(np.asarray(line, float), spacing, carry=False)
    free = ~np.asarray(blocked((p[1:] + p[:-1]) / 2), bool)
    edge = np.diff(np.r_[0, free.astype(int), 0])
    pieces = [p[a : b + 1] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return [x for x in pieces if np.hypot(*np.diff(x, axis=0).T).sum() >= least]


def dilate(cells: DataFrame, key: list[str], radius: float) -> DataFrame:
    """Cells within ``radius`` of a set cell."""
    r = int(radius)
    disc = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= radius * radius])
    return cells.withColumn("_s", F.explode(disc)).select(*key, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("z") + F.col("_s.j")).alias("z")).distinct()


def cell_runs(cells: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """Row runs (key, z, x0, x1, n) of cells."""
    return runs(cells, [*key, "z"], "x", value)


def outline(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Closed outlines of a cell set, inside on the left, corners only: cell edges that no neighbour shares, followed round."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, z in cells:
        for dx, dz, a, b in ((0, -1, (x, z), (x + 1, z)), (1, 0, (x + 1, z), (x + 1, z + 1)), (0, 1, (x + 1, z + 1), (x, z + 1)), (-1, 0, (x, z + 1), (x, z))):
            if (x + dx, z + dz) not in cells:
                after.setdefault(a, []).append(b)
    rings = []
    while after:
        start = min(after)
        ring, at, came = [start], start, (0, 1)
        while True:
            options = after[at]
            # where two outlines touch at a corner, the sharper left turn stays with the same one
            options.sort(key=lambda n: came[0] * (n[1] - at[1]) - came[1] * (n[0] - at[0]))
            nxt = options.pop()
            if not options:
                del after[at]
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            if at == start:
                break
            ring.append(at)
        n = len(ring)
        rings.append([p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - p[0])])
    return rings


def skeleton_edges(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Paths between the nodes (ends and forks) of a thinned mask, as (x, z) cells."""
    on = {(int(x), int(z)) for z, x in np.argwhere(mask)}
    near = lambda p: [q for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if q in on]
    nodes = {p for p in on if len(near(p)) != 2}
    seen, out = set(), []
    for n in sorted(nodes):
        for q in near(n):
            if (n, q) in seen:
                continue
            path = [n, q]
            while path[-1] not in nodes:
                step = [r for r in near(path[-1]) if r != path[-2] and r not in path[:-1]]
                if not step:
                    break
                path.append(step[0])
            seen |= {(path[0], path[1]), (path[-1], path[-2])}
            out.append(path)
    return out


def corridor(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Quads between consecutive cross sections (lx, lz, rx, rz)."""
    w = Window.partitionBy(*key).orderBy(order)
    pt = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("z"))
    d = df.withColumns({f"_{c}": F.lag(c).over(w) for c in ("lx", "lz", "rx", "rz")}).where("_lx is not null")
    return d.select(*key, order, F.array(pt("_lx", "_lz"), pt("lx", "lz"), pt("rx", "rz"), pt("_rx", "_rz")).alias("ring"))


def centroid(points: Column) -> Column:
    """Mean of the distinct corners of a ring."""
    p = F.array_distinct(points)
    mean = lambda k: F.aggregate(F.transform(p, lambda q: q[k]), F.lit(0.0), lambda s, v: s + v) / F.size(p)
    return F.struct(mean("x").alias("x"), mean("z").alias("z"))


def sub_cell_median(cells: DataFrame, fine: DataFrame, scale: float) -> DataFrame:
    """Median of k x k fine samples in each cell (x, z), k from 2 to 8 by the fine grid's step."""
    k = max(2, min(8, int(1 / scale + 0.5)))
    at = F.array(*[F.struct(F.lit((i + 0.5) / k).alias("i"), F.lit((j + 0.5) / k).alias("j")) for i in range(k) for j in range(k)])
    p = cells.withColumn("_s", F.explode(at)).withColumns({"gx": F.floor((F.col("x") + F.col("_s.i")) / scale).cast("bigint"), "gz": F.floor((F.col("z") + F.col("_s.j")) / scale).cast("bigint")})
    return p.join(fine, ["gx", "gz"], "left").groupBy("x", "z").agg(F.median("value").alias("value"), F.count("value").alias("n"))
