"""Lines, skeletons and outlines over tables: each line, page or mask is one row or one group, worked on in Arrow batches.

A line is an array<struct<x, z>> in one row, so the row is the unit and nothing is shuffled; a mask is a group of cells of one feature, of the size of one feature.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import bounded_batches
from strataweave.functions import geometry as G
from strataweave.operators import raster as R
from strataweave.operators import vector as V

_POINTS = "array<struct<x:double,z:double>>"


def _points(value) -> np.ndarray:
    return np.array([(p["x"], p["z"]) for p in value or [] if p and p["x"] is not None and p["z"] is not None], float).reshape(-1, 2)


def _list(points) -> list[dict]:
    return [{"x": float(x), "z": float(z)} for x, z in points]


def per_row(df: DataFrame, id_col: str, inputs: list[str], f: Callable, schema: str) -> DataFrame:
    """(id, ...) rows that ``f(*inputs)`` gives for each row, as tuples of ``schema``; a row for which it gives none has none."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = f"{id_col} {kind}, {schema}"
    types = df.sparkSession.createDataFrame([], out).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            found = ((i, *row) for i, *args in zip(*cols) for row in f(*args))
            while part := list(islice(found, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), arrow)], schema=arrow)

    return df.select(id_col, *inputs).mapInArrow(run, out)


def resampled(df: DataFrame, id_col: str, line: str, spacing: float, carry: bool = True) -> DataFrame:
    """(id, i, x, z): points of each line every ``spacing``; carried over its corners, or anew in each segment."""
    return per_row(df, id_col, [line], lambda p: ((i, float(x), float(z)) for i, (x, z) in enumerate(G.resample(q, spacing, carry=carry))) if len(q := _points(p)) > 1 else (), "i int, x double, z double")


def simplified(df: DataFrame, id_col: str, line: str, tolerance: float) -> DataFrame:
    """(id, line): corners that keep the line within ``tolerance``."""
    return per_row(df, id_col, [line], lambda p: [(_list(G.simplify(q, tolerance) if len(q := _points(p)) > 2 else q),)], f"line {_POINTS}")


def _pieces(points: np.ndarray, box) -> list[list]:
    """What of a line lies in the box, segment by segment; pieces that meet are one."""
    out: list[list] = []
    for p, q in zip(points, points[1:]):
        seg = G.clip_segment(p, q, box)
        if seg is None:
            continue
        if out and np.allclose(out[-1][-1], seg[0]):
            out[-1].append(seg[1])
        else:
            out.append([seg[0], seg[1]])
    return out


def clipped(df: DataFrame, id_col: str, line: str, box: tuple[float, float, float, float]) -> DataFrame:
    """(id, part, line): the pieces of each line inside a box (min x, min z, max x, max z)."""
    return per_row(df, id_col, [line], lambda p: ((k, _list(q)) for k, q in enumerate(_pieces(_points(p), box))), f"part int, line {_POINTS}")


def tapered(df: DataFrame, id_col: str, line: str, start: str, end: str, step: float = 2.0) -> DataFrame:
    """(id, x, z): cells of lines whose width goes from ``start`` to ``end``."""
    return per_row(df, id_col, [line, start, end], lambda p, a, b: ((int(x), int(z)) for x, z in V.tapered_cells(q, a, b, step)) if len(q := _points(p)) > 1 and a and b else (), "x bigint, z bigint")


def voxel_lines(df: DataFrame, id_col: str, a: list[str], b: list[str]) -> DataFrame:
    """(id, x, y, z): voxels from one whole point to another."""
    return per_row(df, id_col, [*a, *b], lambda *p: (tuple(map(int, v)) for v in V.line_3d(p[:3], p[3:])) if None not in p else (), "x bigint, y bigint, z bigint")


def free_routes(df: DataFrame, id_col: str, line: str, blockers: DataFrame, spacing: float = 0.5, least: float = 0.1) -> DataFrame:
    """(id, part, line): pieces of each line whose half-metre steps keep out of the blockers' rings (box, ring).

    Steps meet the blockers in a spatial join; the pieces of a line are put together from its free steps. Each line makes as many rows as it has
    steps, which Spark doesn't foresee from the size of the lines: the joins of steps are told not to send a side to the driver.
    """
    from strataweave.operators.reconcile import points_in_areas

    def steps(p):
        q = G.resample(_points(p), spacing, carry=False).tolist()
        return ((i, *a, *b) for i, (a, b) in enumerate(zip(q, q[1:])))

    step = per_row(df, id_col, [line], steps, "i int, ax double, az double, bx double, bz double")
    at = lambda k: F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}z").alias("z")).alias(k)
    mid = step.select(id_col, "i", at("a"), at("b"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("az") + F.col("bz")) / 2).alias("z"))
    hit = points_in_areas(mid.select(id_col, "i", "x", "z"), blockers.hint("merge")).select(F.col(f"p.{id_col}").alias(id_col), F.col("p.i").alias("i")).distinct()
    from pyspark.sql import Window

    free = mid.join(hit.hint("merge"), [id_col, "i"], "left_anti")
    w = Window.partitionBy(id_col).orderBy("i")
    run = free.withColumn("_g", F.col("i") - F.row_number().over(w)).groupBy(id_col, "_g").agg(F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("s"))
    points = F.concat(F.array(F.col("s")[0]["a"]), F.transform("s", lambda q: q["b"]))
    length = F.aggregate("s", F.lit(0.0), lambda t, q: t + F.hypot(q["a"]["x"] - q["b"]["x"], q["a"]["z"] - q["b"]["z"]))
    part = F.row_number().over(Window.partitionBy(id_col).orderBy("_g")) - 1
    return run.where(length >= least).select(id_col, part.alias("part"), points.alias("line"))


def _masks(df: DataFrame, key: str, f: Callable, schema: str) -> DataFrame:
    """``f(mask, x0, z0)`` for the cells (key, x, z) of each key, as a Boolean array with one empty cell round it."""
    kind = df.schema[key].dataType.simpleString()
    out = f"{key} {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)

    def run(k, t):
        x, z = t.column("x").to_numpy(), t.column("z").to_numpy()
        x0, z0 = int(x.min()) - 1, int(z.min()) - 1
        mask = np.zeros((int(z.max()) - z0 + 2, int(x.max()) - x0 + 2), bool)
        mask[z - z0, x - x0] = True
        rows = [(k[0].as_py(), *r) for r in f(mask, x0, z0)]
        cols = list(zip(*rows)) or [[] for _ in arrow]
        return pa.Table.from_arrays([pa.array(list(c), a.type) for c, a in zip(cols, arrow)], schema=arrow)

    cells = df.where("x is not null and z is not null").select(key, F.col("x").cast("bigint"), F.col("z").cast("bigint"))
    return cells.groupBy(key).applyInArrow(run, out)


def skeletons(cells: DataFrame, key: str) -> DataFrame:
    """(key, part, line): paths between the ends and forks of each thinned mask, as points at cell centres."""

    def paths(mask, x0, z0):
        for n, path in enumerate(V.skeleton_edges(R.thin(mask))):
            yield n, [{"x": x + x0 + 0.5, "z": z + z0 + 0.5} for x, z in path]

    return _masks(cells, key, paths, f"part int, line {_POINTS}")


def outlines(cells: DataFrame, key: str) -> DataFrame:
    """(key, part, ring): closed outlines of each mask, corners only."""

    def rings(mask, x0, z0):
        for n, ring in enumerate(V.outline({(int(x), int(z)) for z, x in np.argwhere(mask)})):
            yield n, [{"x": float(x + x0), "z": float(z + z0)} for x, z in ring]

    return _masks(cells, key, rings, f"part int, ring {_POINTS}")


def chamfer_distance(cells: DataFrame, key: str) -> DataFrame:
    """(key, x, z, distance): tenths of a cell to the nearest cell that is not set, 10 straight and 14 diagonal."""

    def far(mask, x0, z0):
        d = R.chamfer(mask)
        for z, x in np.argwhere(mask):
            yield int(x + x0), int(z + z0), int(d[z, x])

    return _masks(cells, key, far, "x bigint, z bigint, distance int")


def recovered_paths(cells: DataFrame, key: str, tolerance: float = 0.9, least: float = 3.0, rounds: int = 1) -> DataFrame:
    """(key, part, line, length): the network of a mask of path cells seen on imagery.

    The mask is refined (holes filled, specks dropped), thinned to a skeleton, traced between ends and forks, and simplified; pieces shorter than ``least`` go.
    """
    mask = cells.select(key, "x", "z").distinct().withColumn("seed", F.lit(False))
    for _ in range(rounds):
        mask = R.refine_mask(mask, [key])
    lines = skeletons(mask, key).withColumn("_id", F.struct(key, "part"))
    thin = per_row(lines.withColumn("_k", F.concat_ws("|", F.col(key).cast("string"), F.col("part").cast("string"))), "_k", [key, "part", "line"], lambda k, n, p: [(k, n, _list(G.simplify(q, tolerance) if len(q := _points(p)) > 2 else q))], f"{key} {cells.schema[key].dataType.simpleString()}, part int, line {_POINTS}")
    step = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.hypot(F.col("line")[i]["x"] - F.col("line")[i - 1]["x"], F.col("line")[i]["z"] - F.col("line")[i - 1]["z"]))
    length = F.when(F.size("line") > 1, F.aggregate(step, F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)
    return thin.select(key, "part", "line", length.alias("length")).where(F.col("length") >= least)
