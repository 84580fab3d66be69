"""Geometry on arrays of points, and generators from geometry to cells.

Column functions work on ``array<struct<x:double,z:double>>`` rings and lines. The generators are NumPy kernels run by
``mapInArrow``, so that a row becomes many without leaving its task; nothing depends on other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import col


def bounds(points: Column | str) -> Column:
    p = col(points)
    xs, zs = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["z"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(zs).alias("min_z"), F.array_max(xs).alias("max_x"), F.array_max(zs).alias("max_z"))


def ring_area(points: Column | str) -> Column:
    """Shoelace area; the ring may be open."""
    p = col(points)
    turned = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    terms = F.zip_with(p, turned, lambda a, b: a["x"] * b["z"] - b["x"] * a["z"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def line_length(points: Column | str) -> Column:
    p = col(points)
    ahead = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), ahead, lambda a, b: F.hypot(b["x"] - a["x"], b["z"] - a["z"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, t: s + t)


def in_ring(x: Column, z: Column, points: Column | str) -> Column:
    """Even-odd rule."""
    p = col(points)
    turned = F.concat(F.slice(p, F.size(p), 1), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))))
    crosses = F.zip_with(p, turned, lambda a, b: ((a["z"] > z) != (b["z"] > z)) & (x < (b["x"] - a["x"]) * (z - a["z"]) / F.nullif(b["z"] - a["z"], F.lit(0.0)) + a["x"]))
    return F.when(F.size(p) >= 3, F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1).otherwise(F.lit(False))


def in_polygon(x: Column, z: Column, rings: Column | str) -> Column:
    """In the first ring and in none of the others."""
    r = col(rings)
    holes = F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0)))
    return (F.size(r) > 0) & in_ring(x, z, r[0]) & ~F.exists(holes, lambda h: in_ring(x, z, h))


def segment_distance(px: Column, pz: Column, ax: Column, az: Column, bx: Column, bz: Column) -> Column:
    dx, dz = bx - ax, bz - az
    d2 = dx * dx + dz * dz
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - ax) * dx + (pz - az) * dz) / F.nullif(d2, F.lit(0.0)), F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), pz - (az + t * dz))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller box, boxes of at least .01."""
    w = F.greatest(F.lit(0.0), F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"]))
    h = F.greatest(F.lit(0.0), F.least(a["max_z"], b["max_z"]) - F.greatest(a["min_z"], b["min_z"]))
    area = lambda q: (q["max_x"] - q["min_x"]) * (q["max_z"] - q["min_z"])
    return F.least(F.lit(1.0), w * h / F.greatest(F.lit(0.01), F.least(area(a), area(b))))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"]))
    h = F.greatest(F.lit(0.0), F.least(a["max_z"], b["max_z"]) - F.greatest(a["min_z"], b["min_z"]))
    area = lambda q: (q["max_x"] - q["min_x"]) * (q["max_z"] - q["min_z"])
    return w * h / F.greatest(F.lit(1e-9), area(a) + area(b) - w * h)


# ---- kernels

def polygon_spans(rings: list[np.ndarray]) -> np.ndarray:
    """(x0, x1, z) runs of cells whose centre row z + .5 lies inside, all rings by the even-odd rule."""
    rings = [np.asarray(r, float) for r in rings if len(r) >= 3]
    if not rings:
        return np.zeros((0, 3), np.int64)
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, 1, axis=0) for r in rings])
    out = []
    for z in range(int(np.floor(a[:, 1].min())), int(np.ceil(a[:, 1].max())) + 1):
        level = z + 0.5
        cut = (a[:, 1] > level) != (b[:, 1] > level)
        p, q = a[cut], b[cut]
        xs = np.sort(p[:, 0] + (level - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
        for left, right in zip(xs[::2], xs[1::2]):
            x0, x1 = int(np.ceil(left - 0.5)), int(np.floor(right - 0.5))
            if x0 <= x1:
                out.append((x0, x1, z))
    return np.array(out, np.int64).reshape(-1, 3)


def segment_cells(x0: int, z0: int, x1: int, z1: int) -> np.ndarray:
    """Cells of a straight line: the longer axis steps by one, and a diagonal step is taken where both errors allow it."""
    dx, dz = abs(x1 - x0), abs(z1 - z0)
    sx, sz = (1 if x0 < x1 else -1), (1 if z0 < z1 else -1)
    cells, gap = [(x0, z0)], dx - dz
    while (x0, z0) != (x1, z1):
        twice = 2 * gap
        if twice >= -dz:
            gap -= dz
            x0 += sx
        if twice <= dx:
            gap += dx
            z0 += sz
        cells.append((x0, z0))
    return np.array(cells, np.int64)


def band_cells(points: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Distinct cells within half the width of a line; where a cell's centre lies exactly on the edge, one side, the same for both directions of travel, gets it."""
    half = max(0.5, width / 2)
    reach = int(np.ceil(half))
    grid = np.stack(np.meshgrid(np.arange(-reach, reach + 1), np.arange(-reach, reach + 1), indexing="ij"), -1).reshape(-1, 2)
    dist = np.hypot(grid[:, 0], grid[:, 1])
    ends = np.floor(np.asarray(points, float) + 0.5).astype(np.int64)
    found = []
    for (x0, z0), (x1, z1) in zip(ends, ends[1:]):
        v = np.array([x1 - x0, z1 - z0], float)
        if v[0] < 0 or (v[0] == 0 and v[1] < 0):
            v = -v
        v /= np.hypot(*v) or 1.0
        side = grid @ np.array([-v[1], v[0]])
        stamp = grid[(dist < half - 1e-9) | ((np.abs(dist - half) <= 1e-9) & (side < 0.5) & ((np.abs(side) < 0.5) | (side < 0)))]
        core = segment_cells(int(x0), int(z0), int(x1), int(z1))
        found.append((core[:, None] + stamp[None]).reshape(-1, 2))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Keeps the ends and, between kept points, the farthest one while it is off by more than the tolerance."""
    p = np.asarray(points, float)
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        rel = p[a + 1 : b] - p[a]
        n2 = d @ d
        t = np.clip(rel @ d / n2, 0, 1) if n2 else np.zeros(len(rel))
        off = np.hypot(*(rel - t[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return p[keep]


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring's part in (min_x, min_z, max_x, max_z), one border after the other."""
    p = [tuple(q) for q in np.asarray(ring, float)]
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(p[-1:] + p[:-1], p):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if ib:
                out.append(b)
        p = out
        if not p:
            break
    return np.array(p, float).reshape(-1, 2)


def clip_segment(a: np.ndarray, b: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray | None:
    """The part of a segment in a box, by its parameters; None outside."""
    lo, hi, d = 0.0, 1.0, np.asarray(b, float) - a
    for axis in (0, 1):
        for bound, sign in ((box[axis], 1), (box[axis + 2], -1)):
            gain, lack = sign * d[axis], sign * (bound - a[axis])
            if gain == 0:
                if lack > 0:
                    return None
            elif gain > 0:
                lo = max(lo, lack / gain)
            else:
                hi = min(hi, lack / gain)
    return np.array([a + lo * d, a + hi * d]) if lo <= hi else None


def resample(points: np.ndarray, spacing: float, carry: bool = True) -> np.ndarray:
    """Points along a line: every ``spacing`` with the rest carried over corners, or equal steps of at most ``spacing`` per segment."""
    p = np.asarray(points, float)
    if len(p) < 2:
        return p
    seg = np.hypot(*np.diff(p, axis=0).T)
    if carry:
        run = np.r_[0, np.cumsum(seg)]
        at = np.arange(0, run[-1] + 1e-9, spacing)
        if run[-1] - at[-1] > 1e-9:
            at = np.r_[at, run[-1]]
        return np.c_[np.interp(at, run, p[:, 0]), np.interp(at, run, p[:, 1])]
    out = [p[:1]]
    for a, b, n in zip(p, p[1:], seg):
        k = max(1, int(np.ceil(n / spacing)))
        out.append(a + (b - a) * (np.arange(1, k + 1) / k)[:, None])
    return np.concatenate(out)


def _xy(points) -> np.ndarray:
    return np.array([(p["x"], p["z"]) for p in points or []], float).reshape(-1, 2)


def polygon_cells(df: DataFrame, id_col: str, rings_col: str) -> DataFrame:
    """(id, x0, x1, z): the runs of each polygon; polygons without area have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, rings in zip(b.column(0), b.column(1).to_pylist()):
                s = polygon_spans([_xy(r) for r in rings or []])
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(s), b.schema.field(0).type), *[pa.array(c) for c in s.T]], names=["id", "x0", "x1", "z"])

    return df.select(id_col, rings_col).mapInArrow(run, f"id {kind}, x0 bigint, x1 bigint, z bigint")


def line_cells(df: DataFrame, id_col: str, line_col: str, width_col: str) -> DataFrame:
    """(id, x, z): distinct cells of each line at its width."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, line, w in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = band_cells(_xy(line), w or 1.0)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(s), b.schema.field(0).type), *[pa.array(c) for c in s.T]], names=["id", "x", "z"])

    return df.select(id_col, line_col, F.col(width_col).cast("double")).mapInArrow(run, f"id {kind}, x bigint, z bigint")
