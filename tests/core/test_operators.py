import numpy as np
from pyspark.sql import functions as F

from strataweave.operators import fusion as U
from strataweave.operators import ordered as O
from strataweave.operators import partitioning as K
from strataweave.operators import raster as R
from strataweave.operators import spatial as J
from strataweave.plans.graph import connected_components


def test_ambiguity_gate(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.7), ("b", 1, 0.9), ("b", 2, 0.85), ("c", 1, 0.5), ("d", 3, 0.8), ("e", 2, 0.9), ("e", 1, 0.9)], "k string, t int, score double")
    got = {r.k: (r.t, r.status) for r in J.best_of(df, ["k"], "t", "score", 0.66, 0.08).collect()}
    assert got == {"a": (1, "accepted"), "b": (1, "ambiguous"), "c": (1, "below-score-gate"), "d": (3, "accepted"), "e": (1, "ambiguous")}


def test_box_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(float(v) for v in (x, z, x + w, z + h))) for i, (x, z, w, h) in enumerate(zip(*(rng.uniform(a, b, 150) for a, b in ((-50, 50), (-50, 50), (0, 30), (0, 30)))))]
    df = spark.createDataFrame([*rows, (999, None, 1.0, 2.0, 3.0)], "id int, min_x double, min_z double, max_x double, max_z double")
    got = sorted((r.a, r.b) for r in J.box_join(df, df, 7.0, 1.5).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect())
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] - 1.5 <= q[3] and p[3] + 1.5 >= q[1] and p[2] - 1.5 <= q[4] and p[4] + 1.5 >= q[2])
    assert got == want


def test_edits(spark):
    base = spark.createDataFrame([(i, {"a": str(i), "b": "x"}) for i in range(1, 6)], "id int, tags map<string,string>")
    edits = spark.createDataFrame([(10, "delete", 1, {}), (11, "retag", 2, {"b": "y", "c": "z"}), (12, "replace", 3, {"n": "1"}), (13, "auto", 77, {"n": "2"}), (14, "delete", 78, {}), (15, "add", None, {"n": "3"}), (16, "retag", 79, {}), (17, "auto", None, {"n": "4"})], "edit_id int, operation string, target int, tags map<string,string>")
    got = {r.id: (dict(r.tags), r.action, len(r.history)) for r in U.apply_edits(base, edits).collect()}
    assert got == {2: ({"a": "2", "b": "y", "c": "z"}, "retagged", 1), 12: ({"n": "1"}, "replaced", 1), 4: ({"a": "4", "b": "x"}, "kept", 0), 5: ({"a": "5", "b": "x"}, "kept", 0), 13: ({"n": "2"}, "added", 0), 15: ({"n": "3"}, "added", 0), 17: ({"n": "4"}, "added", 0)}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 5000, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def brute_path(at, hs, qs):
    best = {(): (0.0, [])}
    n = len(at)
    paths = [(qs[0][k], [k]) for k in range(len(hs[0]))]
    for i in range(1, n):
        nxt = []
        for k in range(len(hs[i])):
            for v, p in paths:
                d = abs(hs[i][k] - hs[i - 1][p[-1]])
                s = d / max(0.25, at[i] - at[i - 1])
                if s <= 3.5:
                    nxt.append((v + qs[i][k] - d * 0.34 - max(0, s - 1.15) * 1.8, p + [k]))
        paths = nxt
    del best
    return max(paths)[0]


def test_profile_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        at = np.cumsum(rng.uniform(1, 4, 6))
        hs = [rng.uniform(0, 6, 3) for _ in at]
        qs = [rng.uniform(0, 3, 3) for _ in at]
        p = O.best_path(at, hs, qs)
        v = qs[0][p[0]]
        for i in range(1, 6):
            d = abs(hs[i][p[i]] - hs[i - 1][p[i - 1]])
            v += qs[i][p[i]] - d * 0.34 - max(0, d / max(0.25, at[i] - at[i - 1]) - 1.15) * 1.8
        assert abs(v - brute_path(at, hs, qs)) < 1e-9


def test_profile_breaks_where_it_must():
    e = np.array([])
    assert O.best_path(np.arange(5.0), [np.array([1.0]), e, np.array([1.0, 9.0]), np.array([1.0]), np.array([99.0])], [np.array([1.0]), e, np.array([1.0, 2.0]), np.array([1.0]), np.array([1.0])]) == [0, None, 0, 0, 0]


def test_brackets_never_extrapolate(spark):
    s = spark.createDataFrame([(1, float(a)) for a in range(0, 60, 10)] + [(2, 5.0)], "k int, at double")
    a = spark.createDataFrame([(1, 10.0, 2.0), (1, 10.0, 4.0), (1, 40.0, 9.0), (2, 5.0, 1.0)], "k int, at double, level double")
    got = {(r.k, r.at): r.bracketed for r in O.bracket_levels(s, a, ["k"], "at", "level").collect()}
    assert got == {(1, 0): None, (1, 10): 3, (1, 20): 5, (1, 30): 7, (1, 40): 9, (1, 50): None, (2, 5): 1}


def test_blue_noise_spacing_and_maximality(spark):
    pts = spark.createDataFrame([("k", x, z) for x in range(15) for z in range(15)], "k string, x int, z int")
    kept = [(r.x, r.z) for r in O.blue_noise(pts, "k", "x", "z", 3.0).collect()]
    d = lambda a, b: np.hypot(a[0] - b[0], a[1] - b[1])
    assert all(d(a, b) >= 3 for i, a in enumerate(kept) for b in kept[i + 1 :])
    assert all(any(d((x, z), k) < 3 for k in kept) for x in range(15) for z in range(15))


def test_bins_and_bands(spark):
    plan = K.lpt_bins([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2)
    assert plan == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    for lo, hi, n in ((-7, 12, 6), (0, 2, 9), (3, 3, 1)):
        b = K.bands(lo, hi, n)
        assert [x for a, z in b for x in range(a, z + 1)] == list(range(lo, hi + 1))
        got = spark.range(lo, hi + 1).select("id", K.band_of(F.col("id"), lo, hi, n).alias("b")).collect()
        assert all(b[r.b][0] <= r.id <= b[r.b][1] for r in got)


def test_coverage_faults(spark):
    e, s = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (2,), (3,), (9,)], "k int")
    assert {r.k: r.fault for r in K.coverage_faults(e, s, "k").collect()} == {1: "missing", 2: "duplicate", 9: "unexpected"}


def test_masks(spark):
    m = spark.createDataFrame([("k", x, z, False) for x in range(5) for z in range(5) if (x, z) != (2, 2)] + [("k", 20, 20, False), ("k", 30, 30, True)], "k string, x int, z int, seed boolean")
    got = {(r.x, r.z) for r in R.refine_mask(m, ["k"]).collect()}
    assert got == {(x, z) for x in range(5) for z in range(5)} | {(30, 30)}
    sq = spark.createDataFrame([("k", x, z) for x in range(7) for z in range(7)], "k string, x int, z int")
    steps = {(r.x, r.z): r.step for r in R.interior_steps(sq, ["k"]).collect()}
    assert all(steps[x, z] == min(x, z, 6 - x, 6 - z) for x in range(7) for z in range(7))


def test_skeleton_and_chamfer():
    bar = np.zeros((9, 30), bool)
    bar[2:7, 2:28] = True
    t = R.thin(bar)
    assert t.any() and t.sum(axis=0).max() <= 2 and (t & ~bar).sum() == 0
    d = R.chamfer(bar)
    assert d[4, 15] == 30 and d[2, 15] == 10 and d[0, 0] == 0


def test_bilinear(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (0, 1, 5.0), (1, 1, None)], "gx bigint, gz bigint, value double")
    p = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, 0.5), (3, 9.0, 9.0)], "id int, x double, z double")
    got = {r.id: r.value for r in R.bilinear(p, g).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None}


def test_iou_pairs_are_all_pairs(spark):
    import random

    from strataweave.operators import spatial as J

    rnd = random.Random(5)
    boxes = [(i, x := rnd.uniform(-9, 9), z := rnd.choice([-3.0, 0.0, 2.5]), x + rnd.choice([0.0, 1.0, 4.0, 60.0]), z + rnd.uniform(0, 9)) for i in range(300)]
    boxes += [(i, 1.0, 1.0, 5.0, 5.0) for i in range(300, 820)] + [(900, None, 1.0, 5.0, 5.0), (901, 5.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(boxes, "id int, min_x double, min_z double, max_x double, max_z double")

    def iou(a, b):
        i = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
        return i / max(1e-9, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - i)

    known = [b for b in boxes if b[1] is not None]
    want = {(a[0], b[0]) for a in known for b in known if iou(a, b) >= 0.3}
    got = [(r.a, r.b) for r in J.iou_pairs(df, df, 0.3).selectExpr("l.id as a", "r.id as b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    once = [(r.a, r.b) for r in J.iou_pairs(df, df, 0.3, once="id").selectExpr("l.id as a", "r.id as b").collect()]
    assert len(once) == len(set(once)) and set(once) == {p for p in want if p[0] < p[1]}


def test_last_writer_ties_do_not_depend_on_row_order(spark):
    rows = [(0, 0, 0, 3, 7, "N"), (0, 0, 0, 3, 7, "R"), (0, 0, 0, 2, 9, "Z"), (1, 0, 0, 0, 1, "A"), (1, 0, 0, 0, None, "B")]
    for r in (rows, rows[::-1]):
        got = R.last_writer(spark.createDataFrame(r, "x int, y int, z int, phase int, seq int, block string").coalesce(1)).collect()
        assert sorted(map(tuple, got)) == [(0, 0, 0, "R", 3), (1, 0, 0, "A", 0)]
