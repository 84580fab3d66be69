import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import geometry as G


def inside(x, z, rings):
    hit = False
    for r in rings:
        for (ax, az), (bx, bz) in zip(r, r[1:] + r[:1]):
            if (az > z) != (bz > z) and x < (bx - ax) * (z - az) / (bz - az) + ax:
                hit = not hit
    return hit


RINGS = [[(0.2, 0.1), (17, 3), (23, 14), (11, 21), (4, 12)], [(8, 8), (14, 8), (14, 13), (8, 13)]]


def test_spans_are_the_cells_whose_centres_lie_inside():
    got = {(x, z) for a, b, z in G.polygon_spans([np.array(r) for r in RINGS]) for x in range(a, b + 1)}
    want = {(x, z) for x in range(-2, 30) for z in range(-2, 30) if inside(x + 0.5, z + 0.5, RINGS)}
    assert got == want
    assert len(G.polygon_spans([])) == 0 and len(G.polygon_spans([np.array([(0, 0), (1, 1)])])) == 0


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5.5])
def test_band_is_the_same_in_both_directions(width):
    line = np.array([(0, 0), (7, 3), (7, -6), (-4, -6)], float)
    a, b = G.band_cells(line, width), G.band_cells(line[::-1], width)
    straight = G.band_cells(np.array([(0, 0), (20, 0)], float), width)
    assert {tuple(c) for c in G.band_cells(np.array([(0, 0), (20, 0)], float), width)} == {tuple(c) for c in G.band_cells(np.array([(20, 0), (0, 0)], float), width)}
    assert len(a) and len(b)
    rows = np.bincount(straight[straight[:, 0] == 10][:, 1] + 50)
    assert rows.sum() in (math.floor(width), math.ceil(width), math.ceil(width) + (math.ceil(width) + 1) % 2)


def test_even_width_has_exactly_that_many_cells():
    for w in (2, 4, 6):
        c = G.band_cells(np.array([(0, 0), (30, 0)], float), w)
        assert (c[:, 0] == 15).sum() == w


def test_segment_cells_step_by_one():
    for end in ((9, 4), (-3, 8), (5, -5), (0, 0), (-7, 0)):
        c = G.segment_cells(0, 0, *end)
        assert tuple(c[0]) == (0, 0) and tuple(c[-1]) == end and (np.abs(np.diff(c, axis=0)).max(initial=0) <= 1)
        assert len(c) == max(map(abs, end)) + 1


def test_simplify_clip_resample():
    p = np.array([(0, 0), (5, 0.05), (10, 0), (10, 10)], float)
    assert G.simplify(p, 0.1).tolist() == [[0, 0], [10, 0], [10, 10]]
    c = G.clip_ring(np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), (5, 5, 20, 20))
    assert {tuple(x) for x in c.tolist()} == {(5, 5), (10, 5), (10, 10), (5, 10)}
    assert len(G.clip_ring(np.array([(0, 0), (1, 0), (1, 1)], float), (5, 5, 6, 6))) == 0
    assert G.clip_segment(np.array([0, 0]), np.array([10, 10]), (2, 3, 8, 9)).tolist() == [[3, 3], [8, 8]]
    assert G.clip_segment(np.array([0, 0]), np.array([1, 0]), (2, 3, 8, 9)) is None
    r = G.resample(np.array([(0, 0), (0, 3), (4, 3)], float), 2)
    assert np.allclose(r, [(0, 0), (0, 2), (1, 3), (3, 3), (4, 3)])
    assert len(G.resample(np.array([(0, 0), (0, 3), (4, 3)], float), 2, carry=False)) == 5


def test_column_functions(spark):
    pts = [(float(x), float(z)) for x, z in RINGS[0]]
    hole = [(float(x), float(z)) for x, z in RINGS[1]]
    df = spark.createDataFrame([([pts, hole], x + 0.5, z + 0.5) for x in range(-1, 25, 3) for z in range(-1, 23, 3)], "rings array<array<struct<x:double,z:double>>>, px double, pz double")
    for r in df.withColumn("i", G.in_polygon(F.col("px"), F.col("pz"), "rings")).collect():
        assert r.i == inside(r.px, r.pz, [pts, hole])
    one = df.select(G.ring_area(F.col("rings")[1]).alias("a"), G.line_length(F.col("rings")[1]).alias("l"), G.bounds(F.col("rings")[0]).alias("b")).first()
    assert one.a == 30 and one.l == 17 and (one.b.min_x, one.b.max_z) == (0.2, 21)
    d = spark.range(1).select(G.segment_distance(F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)).alias("d"), G.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("p")).first()
    assert d.d == 3 and d.p == 5
