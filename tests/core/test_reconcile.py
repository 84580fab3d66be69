import numpy as np
from pyspark.sql import functions as F

from strataweave.operators import raster as R
from strataweave.operators import reconcile as C
from strataweave.operators import registration as G
from strataweave.operators import vector as V


def transformed(n, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    src = rng.uniform(0, 800, (n, 2))
    a = np.radians(28)
    m = 0.05 * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    return src, src @ m.T + [140, -65] + rng.normal(0, noise, (n, 2))


def test_similarity_with_outlier():
    src, dst = transformed(7)
    dst[3] += 40
    got = G.solve(src, dst, np.ones(7), 0.05)
    assert got["pass"] and got["inliers"] == 6 and abs(got["scale"] - 0.05) < 1e-9 and abs(got["rotation"] - 28) < 1e-6
    assert G.solve(src, dst, np.ones(7), 0.08)["reasons"] == ["scale"]
    assert not G.solve(src[:1], dst[:1], np.ones(1))["pass"]
    mirrored = src * [1, -1]
    assert not G.solve(mirrored, src, np.ones(7))["pass"]


def test_affine_gates():
    src, _ = transformed(8)
    skew = src @ np.array([[0.05, 0.0], [0.02, 0.05]])
    assert G.solve(src, skew, np.ones(8), model="affine")["reasons"]
    src, dst = transformed(8)
    assert G.solve(src, dst, np.ones(8), model="affine")["pass"]


def test_pages(spark):
    src, dst = transformed(6, 0.05)
    rows = [("p1", *map(float, (*s, *d)), None, 0.05) for s, d in zip(src, dst)] + [("p2", 0.0, 0.0, 1.0, 1.0, 1.0, None)]
    reg = G.register_pages(spark.createDataFrame(rows, "page string, sx double, sy double, tx double, ty double, weight double, expected_scale double"))
    got = {r.page: r for r in reg.collect()}
    assert got["p1"]["pass"] and not got["p2"]["pass"] and got["p2"].reasons == ["insufficient-control-points"]
    pts = G.apply_transform(spark.createDataFrame([("p1", float(src[0, 0]), float(src[0, 1])), ("p2", 0.0, 0.0)], "page string, x double, y double"), reg).collect()
    assert len(pts) == 1 and np.hypot(pts[0].wx - dst[0, 0], pts[0].wy - dst[0, 1]) < 0.3
    pol = spark.createDataFrame([(True, True, 0, 2, 2), (True, True, 0, 3, 3), (True, True, 1, 0, 0), (True, False, 0, 0, 0), (False, True, 9, 9, 9)], "p boolean, w boolean, e int, s int, t int")
    assert [r[0] for r in pol.select(G.page_policy(*map(F.col, "pwest"))).collect()] == ["unregistered", "registered", "registered", "registered", "rejected"]
    fits = spark.createDataFrame([("p", "a", "x", 0.1, 1.0), ("p", "a", "y", 0.05, 1.0), ("p", "b", "y", 0.2, 1.0), ("p", "b", "x", 0.3, 1.0), ("p", "c", "z", 9.0, 1.0)], "page string, source string, target string, rmse double, coverage double")
    assert sorted((r.source, r.target) for r in G.shape_matches(fits).collect()) == [("a", "y"), ("b", "x")]


def test_lifecycle_combination(spark):
    rows = [("a", "current", 0.93, "app"), ("a", "refused", 0.98, "app"), ("b", "current", 0.99, "drawing-title-block"), ("b", "proposed", 0.91, "app"), ("c", "current", 0.93, "app"), ("c", "proposed", 0.91, "app"), ("d", "proposed", 0.74, "app"), ("e", None, None, None)]
    got = {r.k: (r.state, r.confidence) for r in C.combine_lifecycle(spark.createDataFrame(rows, "k string, state string, confidence double, source string"), "k").collect()}
    assert got == {"a": ("refused", 0.98), "b": ("current", 0.99), "c": ("unknown", 0.91), "d": ("proposed", 0.74), "e": ("unknown", 0.45)}


def test_widths(spark):
    cases = [({"width": "3 m"}, "path", "line", (3.0, "observed-width")), ({"width": "3"}, "path", "area", (None, "area-footprint")), ({"width:start": "2", "width:end": "4"}, "path", "line", (3.0, "variable-width-tagged")), ({"lanes": "2"}, "road", "line", (6.2, "lanes-derived")), ({"lanes": "2"}, "path", "line", (None, "unknown-marker")), ({"est_width": "55"}, "path", "line", (40.0, "tag-estimate"))]
    df = spark.createDataFrame([(t, k, f) for t, k, f, _ in cases], "t map<string,string>, k string, f string").withColumn("w", C.path_width(F.col("t"), F.col("k"), F.col("f")))
    assert [(r.w.width_m, r.w.status) for r in df.collect()] == [c[3] for c in cases]


BOXES = "id string, kind string, name string, min_x double, min_z double, max_x double, max_z double"


def test_supersede(spark):
    official = spark.createDataFrame([("o1", "water", "Lake", 0.0, 0.0, 10.0, 10.0)], BOXES)
    osm = spark.createDataFrame([("a", "water", None, 0.0, 0.0, 10.0, 9.0), ("b", "water", "Other", 0.0, 0.0, 10.0, 10.0), ("c", "path", None, 0.0, 0.0, 10.0, 10.0), ("d", "water", "lake", 5.0, 5.0, 16.0, 16.0), ("e", "water", None, 500.0, 0.0, 510.0, 10.0), ("f", "water", None, 11.0, 0.0, 12.0, 10.0)], BOXES)
    assert {r.id: r.action for r in C.supersede(official, osm).collect()} == {"a": "superseded", "b": "kept", "c": "kept", "d": "kept", "e": "kept", "f": "ambiguous"}


def test_targets_and_rides(spark):
    c = spark.createDataFrame([(1, "x", "building"), (2, "y", "building"), (3, "nope", "path"), (4, None, "path")], "candidate_id int, target string, kind string")
    f = spark.createDataFrame([("x", "building"), ("y", "water")], "id string, kind string")
    assert {r.candidate_id: r.status for r in C.certified_target(c, f).collect()} == {1: "accepted", 2: "certified-target-incompatible", 3: "certified-target-missing", 4: "search"}
    s = spark.createDataFrame([("a", "r2", None, 0.0, 0.0), ("b", None, "WAVE", 0.0, 0.0), ("c", None, "twin", 0.0, 10.0), ("d", None, None, 5.0, 0.0), ("e", None, None, 500.0, 0.0)], "id string, ride_ref string, name string, x double, z double")
    r = spark.createDataFrame([("r1", "Wave", 0.0, 1.0), ("r2", "Twin", 10.0, 0.0), ("r3", "Twin", 0.0, 12.0)], "ride_id string, name string, x double, z double")
    assert {x.id: (x.ride_id, x.method) for x in C.structure_ride(s, r).collect()} == {"a": ("r2", "explicit"), "b": ("r1", "name"), "c": ("r3", "nearest"), "d": (None, "ambiguous"), "e": (None, "none")}


def test_gap_repair(spark):
    e = spark.createDataFrame([(1, "f1", 1, 0.0, 0.0, 1.0, 0.0, "asphalt"), (2, "f1", 1, 0.0, 50.0, -1.0, 0.0, None)], "end_id int, feature string, component int, x double, z double, out_x double, out_z double, surface string")
    s = spark.createDataFrame([("f2", 2, 2.0, -5.0, 2.0, 5.0, "asphalt"), ("f3", 1, 1.0, -5.0, 1.0, 5.0, None), ("f1", 1, 0.5, 0.0, 1.0, 1.0, None), ("f4", 3, 3.0, 40.0, 3.0, 60.0, None)], "feature string, component int, ax double, az double, bx double, bz double, surface string")
    got = {r.end_id: (r.target, r.distance, r.status) for r in C.repair_gaps(e, s).collect()}
    assert got == {1: ("f2", 2.0, "accepted"), 2: (None, None, "no-compatible-route-within-tolerance")}


def test_heights_and_roofs(spark):
    c = spark.createDataFrame([("a", 10.0, 10.0 + h) for h in (5.0, 6.0, 7.0, 8.0, 0.5)] + [("b", 1.0, 9.0)], "k string, terrain double, surface double")
    got = {r.k: r for r in C.building_heights(c, "k").collect()}
    assert got["a"].height_m == 7.0 and got["a"].coverage == 0.8 and got["b"].status == "insufficient-coverage" and got["b"].height_m is None
    roof = [("k", x, z, 0.0, 30.0 if (x, z) == (2, 2) else None if (x, z) == (0, 0) else 6.0) for x in range(5) for z in range(5)] + [("k", 50, 50, 1.0, None)]
    r = {(q.x, q.z): (q.roof, q.evidence) for q in C.roof_cells(spark.createDataFrame(roof, "k string, x int, z int, terrain double, surface double"), ["k"]).collect()}
    assert r[2, 2] == (6.0, "outlier") and r[0, 0] == (6.0, "interpolated") and r[50, 50] == (5.0, "fallback") and r[3, 3] == (6.0, "measured")


def test_small_rules(spark):
    s = spark.createDataFrame([("f1", "R", 1.0, None, 0.9), ("f1", "R", 2.0, 5.0, None), ("f2", None, None, None, None)], "feature_id string, name string, elevation double, banking double, confidence double")
    assert {r.ride: (r.status, r.vertical_coverage, r.banking_coverage) for r in C.ride_summary(s).collect()} == {"R": ("full-3d-elevation", 1.0, 0.5), "f2": ("2d-only", 0.0, 0.0)}
    p = spark.createDataFrame([("stone", 3), ("air", 1), ("stone", 0)], "b string, s int")
    assert {r.b: r.palette_id for r in C.dense_palette(p, "b", "s").collect()} == {"stone": 0, "air": 1}
    g = spark.createDataFrame([(120, 30, 5, 2000.0, None, 1.0)], "features int, access int, buildings int, route_m double, ride_m double, chunk_ratio double")
    assert {r.gate: r["pass"] for r in C.acceptance(g).collect()} == {"features": True, "access": True, "buildings": False, "route": True, "rides": False, "chunks": True}
    got = spark.range(1).select(C.fill_style(F.array(*map(F.lit, (10.0, 121.0, 255.0)))).alias("f"), C.fill_style(F.array(*map(F.lit, (254.0, 255.0, 255.0)))).alias("w"), C.hatch_style(F.lit(-10.0), F.lit(-10.0), F.array(*map(F.lit, (0.0, 0.0, 0.0))), F.lit(1.0)).alias("h"), C.stratified(F.sequence(F.lit(0), F.lit(99)), 4).alias("s")).first()
    assert got.f == "fill:12,120,256" and got.w is None and got.h == "hatch:a45:c0,0,0:w1.0" and got.s == [0, 33, 66, 99]
    areas = spark.createDataFrame([("A", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 0.0, 0.0, 10.0, 10.0), ("B", [(50.0, 50.0), (60.0, 50.0), (60.0, 60.0)], 50.0, 50.0, 60.0, 60.0)], "aid string, ring array<struct<x:double,z:double>>, min_x double, min_z double, max_x double, max_z double")
    pts = spark.createDataFrame([(1, 8.0, 2.0), (2, 2.0, 8.0), (3, 9.0, 8.0)], "pid int, x double, z double")
    assert {r.aid: (r.n, r.children) for r in C.children_of(pts, areas, "pid", "aid").collect()} == {"A": (2, [1, 3]), "B": (0, None)}
    near = C.point_radius(spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, z double"), spark.createDataFrame([(1, 3.0, 4.0), (2, 3.1, 4.0)], "j int, x double, z double"), 5.0)
    assert [r.c.j for r in near.collect()] == [1]


def test_vectors(spark):
    assert len(V.line_3d((0, 0, 0), (5, 2, -9))) == 10
    t = V.tapered_cells(np.array([(0, 0), (40, 0)]), 1, 6)
    assert (t[:, 0] == 1).sum() < (t[:, 0] == 38).sum()
    pieces = V.keep_free(np.array([(0, 0), (10, 0)]), lambda p: (p[:, 0] > 4) & (p[:, 0] < 6))
    assert [p[[0, -1], 0].tolist() for p in pieces] == [[0, 4], [6, 10]]
    ring = V.outline({(0, 0), (1, 0), (1, 1)})
    assert len(ring) == 1 and set(ring[0]) == {(0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (0, 1)}
    hole = V.outline({(x, z) for x in range(3) for z in range(3)} - {(1, 1)})
    assert sorted(map(len, hole)) == [4, 4]
    assert len(V.outline({(0, 0), (1, 1)})) == 2
    bar = np.zeros((12, 40), bool)
    bar[4:7, 2:38] = True
    bar[6:12, 18:21] = True
    edges = V.skeleton_edges(R.thin(bar))
    assert edges and max(map(len, edges)) > 10
    c = spark.createDataFrame([("k", 0, 0)], "k string, x int, z int")
    assert V.dilate(c, ["k"], 2.0).count() == 13 and V.cell_runs(V.dilate(c, ["k"], 2.0), ["k"]).count() == 5
    sec = spark.createDataFrame([("k", i, 0.0, float(i), 2.0, float(i)) for i in range(3)], "k string, i int, lx double, lz double, rx double, rz double")
    assert V.corridor(sec, ["k"], "i").count() == 2
