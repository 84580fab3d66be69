"""Rules over colours, patterns, words and change sets, against plain re-derivations and published examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import appearance as A
from strataweave.functions import vocabulary as V
from strataweave.operators import changes as H
from strataweave.operators import details as D
from strataweave.operators import lines as N
from strataweave.operators import partitioning as K
from strataweave.operators import raster as R
from strataweave.operators import spatial as J
from strataweave.sources import paging

BOX = "min_x double, min_z double, max_x double, max_z double"


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def patch(samples):
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for r, g, b in samples])


def test_ground_patches(spark):
    canopy = [(40 + i * 2, 105 + (i % 3) * 12, 35 + i) for i in range(9)]
    soil = [(130 + i, 88 + (i % 2) * 4, 54 + (i % 3) * 3) for i in range(9)]
    gravel = [(90, 91, 91), (140, 136, 132), (105, 108, 109), (155, 151, 148), (112, 109, 111), (145, 141, 142), (98, 101, 99), (160, 157, 153), (118, 116, 119)]
    got = {}
    for name, samples in (("canopy", canopy), ("soil", soil), ("gravel", gravel)):
        p = spark.range(1).select(A.patch_colour(patch(samples)).alias("p"))
        got[name] = p.select(A.aerial_class(F.col("p.r"), F.col("p.g"), F.col("p.b"), F.col("p.texture")).alias("a")).first().a
    assert got["canopy"]["class"] in ("dense-tree-canopy", "vegetation") and got["soil"]["class"] == "soil-mulch" and got["gravel"]["class"] == "rock-gravel"
    assert all(r.eligible and 0.6 < r.confidence <= 0.99 for r in got.values())
    assert one(spark, A.patch_colour(F.array().cast("array<struct<r:int,g:int,b:int>>"))) == [None]
    r = one(spark, A.aerial_class(F.lit(5.0), F.lit(5.0), F.lit(5.0)), A.aerial_class(F.lit(40.0), F.lit(60.0), F.lit(120.0)))
    assert [(x["class"], x.eligible) for x in r] == [("shadow", False), ("water-candidate", False)]


def plain_slot(p, x, z, scale, rotation):
    x, z = {0: (x, z), 90: (-z, x), 180: (-x, -z), 270: (z, -x)}[rotation]
    px, pz = x // scale % 24, z // scale % 24
    if p == "checker":
        return (px + pz) % 2
    if p == "herringbone":
        return 2 if (px + 2 * pz) % 7 == 0 else int((px + 2 * pz) % 4 == 0 or (2 * px + pz) % 5 == 0)
    if p == "running_bond":
        return 2 if (px + pz) % 11 == 0 else int((px + pz % 2 * 2) % 5 == 0)
    return int({"grid": px % 4 == 0 or pz % 4 == 0, "slabs": px % 5 == 0 or pz % 7 == 0, "stripes": px % 3 == 0, "solid": False}[p])


@pytest.mark.parametrize("scale,rotation", [(1, 0), (2, 90), (3, 180), (1, 270)])
def test_patterns(spark, scale, rotation):
    names = ["checker", "herringbone", "running_bond", "grid", "slabs", "stripes", "solid"]
    df = spark.createDataFrame([(p, x, z) for p in names for x in range(-30, 31, 3) for z in range(-30, 31, 4)], "p string, x int, z int")
    for r in df.withColumn("s", A.pattern_slot(F.col("p"), F.col("x"), F.col("z"), scale, rotation)).collect():
        assert r.s == plain_slot(r.p, r.x, r.z, scale, rotation)


def test_irregular_patterns_keep_their_shares(spark):
    df = spark.range(40_000).select((F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("z"))
    for name, material, want in (("mixed", "brick", (0.7, 0.22, 0.08)), ("organic", "grass", (0.66, 0.24, 0.1)), ("mosaic", "sett", (0.52, 0.28, 0.2))):
        n = {r.s: r.n for r in df.groupBy(A.pattern_slot(F.lit(name), F.col("x"), F.col("z"), seed=7, material=F.lit(material)).alias("s")).agg(F.count("*").alias("n")).collect()}
        assert [round(n[k] / 40_000, 2) for k in range(3)] == pytest.approx(want, abs=0.02)
    assert one(spark, A.pattern_name(F.lit("Basketweave")), A.pattern_name(F.lit("running bond")), A.pattern_name(F.lit("zig")), A.default_pattern(F.lit("brick")), A.default_pattern(F.lit("x"))) == ["grid", "running_bond", None, "running_bond", "solid"]


def test_leaves(spark):
    L = lambda v: F.lit(v).cast("double")
    leaf = lambda *rgb, kind="broadleaved", cycle=None: A.leaf_palette(*map(L, rgb), F.lit(kind), F.lit(cycle).cast("string"))
    got = one(spark, leaf(10, 60, 10, kind="Needleleaved"), leaf(None, None, None), leaf(None, None, None, cycle="evergreen"), leaf(30, 60, 30), leaf(150, 140, 60), leaf(60, 120, 60), leaf(90, 100, 80))
    assert [[x.replace("_leaves", "") for x in p] for p in got] == [["spruce", "dark_oak"], ["oak", "birch"], ["dark_oak", "oak"], ["dark_oak", "spruce"], ["birch", "azalea"], ["oak", "azalea"], ["oak", "dark_oak"]]


def test_path_roles(spark):
    cases = [({"highway": "track"}, "path", "service"), ({"foot": "no"}, "path", "service"), ({"motor_vehicle": "private"}, "road", "service"), ({"access": "delivery"}, "path", "service"), ({"access": "customers", "name": "Main Entrance Line"}, "path", "queue"), ({"name": "queue"}, "path", "guest"), ({"highway": "pedestrian"}, "road", "guest"), ({"backstage": "yes"}, "path", "service"), ({"queue": "yes", "access": "private"}, "path", "queue"), ({}, "road", "service"), ({}, "path", "guest")]
    df = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, tags map<string,string>, kind string")
    got = {r.i: r.role for r in df.select("i", A.path_role(F.col("tags"), F.col("kind")).alias("role")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_vocabularies(spark):
    m = lambda t: [x.material for x in one(spark, V.materials(F.lit(t)))[0]]
    assert m("Red tarmac") == ["red_tarmac"] and m("newBlackAsphalt") == ["fresh_black_asphalt"] and m("stone pavers")[0] == "paving_stones" and "stone" not in m("stone pavers")
    assert m("old concrete") == ["old_concrete"] and m("") == [] and m(None) == [] and set(m("brick / gravel")) == {"brick", "gravel"}
    c = one(spark, *[V.object_class(F.lit(t).cast("string")) for t in ("150 mm dia pipe to outfall OF3", "lighting column LC12", "Tree T12 retained", "nothing", None)])
    assert [(x.object_type, x.subtype) if x else None for x in c] == [("drainage", "pipe"), ("lighting", "lighting_column"), ("tree", "tree"), None, None]
    d = one(spark, V.object_details(F.lit("Existing silver birch  tree to be removed height 12.5 m, crown spread 400 m, gradient 1:12, 1200 x 900 mm, RAL 7016")))[0]
    assert (d.height_m, d.crown_m, d.gradient_ratio, d.size_a_mm, d.size_b_mm, d.ral, d.species, d.status) == (12.5, None, 12, 1200, 900, 7016, "silver birch", "removed")


def plain_windows(items, most=4, tol=3.5, gap=28.0):
    out = []
    for page in {i[0] for i in items}:
        rest = sorted((i for i in items if i[0] == page), key=lambda i: (-i[4], i[3], i[1]))
        lines = []
        for i in rest:
            if lines and lines[-1][-1][4] - i[4] <= tol:
                lines[-1].append(i)
            else:
                lines.append([i])
        for line in lines:
            line.sort(key=lambda i: (i[3], i[1]))
            for s in range(len(line)):
                used = []
                for i in line[s : s + most]:
                    if used:
                        p = used[-1]
                        room = max(gap, p[6] * 2.2, i[6] * 2.2)
                        space = i[3] - (p[3] + p[5])
                        if space > room or space < -max(room, p[5] * 0.35):
                            break
                    used.append(i)
                    out.append((page, line[s][1], len(used), " ".join(u[2] for u in used)))
    return sorted(out)


def test_text_windows(spark):
    rng = np.random.default_rng(3)
    items = [(int(p), i, f"t{i}", float(rng.integers(0, 400)), float(rng.integers(0, 40) * 3), float(rng.integers(5, 60)), float(rng.integers(6, 20))) for p in range(3) for i in range(60)]
    df = spark.createDataFrame(items, "page int, item int, text string, x double, y double, width double, size double")
    got = sorted((r.page, r["first"], r.n, r.raw) for r in V.text_windows(df, ["page"]).collect())
    assert got == plain_windows(items) and V.text_windows(df.limit(0), ["page"]).count() == 0


def test_text_windows_query(spark, sf):
    from strataweave import queries

    items = []
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        for i, t in enumerate(r.text.strip().split() if r.text else []):
            items.append((r.item_id, i, t, float(i % 6 * 60 + (30 if i % 5 == 0 else 0)), float(700 - i // 6 * 12 + i % 2), 40.0, 8.0))
    got = sorted((r.item_id, r["first"], r.n, r.raw) for r in queries.QUERIES["text_windows"](spark, sf).collect())
    assert got == plain_windows(items)


def test_near_boxes_take_few_cells_beside_a_large_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *p, p[0] + 4, p[1] + 4) for i, p in enumerate(rng.integers(0, 3000, (300, 2)).astype(float).tolist())]
    rows += [(1000, 0.0, 0.0, 2000.0, 2000.0), (1001, 100.0, 100.0, 160.0, 130.0), (1002, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, f"id int, {BOX}")
    got = sorted((r.l.id, r.r.id) for r in J.near_boxes(df, df, 16.0).collect())
    want = []
    for a in rows[:-1]:
        for b in rows[:-1]:
            touch = a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]
            far = np.hypot((a[1] + a[3] - b[1] - b[3]) / 2, (a[2] + a[4] - b[2] - b[4]) / 2)
            if touch or far < max(8, *(np.hypot(q[3] - q[1], q[4] - q[2]) for q in (a, b))):
                want.append((a[0], b[0]))
    assert got == sorted(want)
    assert J.near_boxes(df.limit(0), df, 16.0).count() == 0


def test_signs_all_find_a_free_cell(spark):
    rows = [(f"s{i:02}", j, 0, float(j)) for i in range(24) for j in range(24)] + [("s00", 0, 0, 0.5), (None, 1, 1, 0.0)]
    got = [(r.o, r.x, r.z) for r in D.sign_cells(spark.createDataFrame(rows, "o string, x int, z int, score double"), "o").collect()]
    assert len(got) == 24 and len({o for o, *_ in got}) == 24 and len({c[1:] for c in got}) == 24


def test_repeated_points_keep_their_rows(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 9.0, 9.0)], "id int, x double, z double")
    g = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0)], "gx bigint, gz bigint, value double")
    assert sorted((r.id, r.value) for r in R.bilinear(p, g).collect() if r.value is not None) == [(1, 2.0), (1, 2.0)] and R.bilinear(p, g).count() == 3


def test_paging_without_a_total(spark):
    def fetch(offset, limit):
        return [{"n": i} for i in range(offset, min(250, offset + limit))]

    spark.dataSource.register(paging.paged_source("pages_without_total", "n int", fetch))
    assert sorted(r.n for r in spark.read.format("pages_without_total").load().collect()) == list(range(250))
    assert spark.read.format("pages_without_total").option("total", 250).load().count() == 250
    assert paging.count_by_paging(fetch) == 250
    with pytest.raises(ValueError):
        paging.count_by_paging(fetch, most=200)


def test_shards_and_weights(spark):
    got = one(spark, K.affine_shard(F.array(F.lit(27), F.lit(5)), F.lit("a"), 64), K.affine_shard(F.array().cast("array<int>"), F.lit("a"), 64), K.template_weight(F.lit(10)), K.template_weight(F.lit(1000)))
    assert got[0] == 5 and 0 <= got[1] < 20 and [float(x) for x in got[2:]] == [0.45, 2.25]


def test_ranking_of_applications(spark):
    a = spark.createDataFrame([(1, "Oblivion", 1.0), (2, "Forbidden Valley", 0.8), (3, None, 1.0)], "anchor_id int, name string, weight double")
    t = spark.createDataFrame([(10, "the superoblivions", 0), (11, "works in valley forbidden and oblivion", 1), (12, None, 2), (13, "x", 3)], "application_id int, text string, at int")
    m = D.relevant_applications(a, t)
    assert {(r.anchor_id, r.application_id): round(r.score, 3) for r in m.collect()} == {(1, 10): 1.0, (1, 11): 1.0, (2, 11): 0.9}
    r = D.application_ranking(m.join(a, "anchor_id"), t, "at").collect()
    assert {x.application_id: (x.score, x.anchors) for x in r} == {10: (1.0, 1), 11: (1.0, 2), 12: (0.0, 0), 13: (0.0, 0)}
    with pytest.raises(ValueError):
        D.relevant_applications(a, t, most=1)


def test_changes(spark):
    c = spark.createDataFrame([
        (1, "terrain", None, None, None, "area", None, "add", True, False, None), (2, None, None, None, "timber fence", "line", None, "auto", True, False, None), (3, None, None, "Roof Plan", None, "area", None, "auto", True, False, None),
        (4, None, None, None, "footpath", "line", None, "auto", False, False, None), (5, None, None, None, "footpath", "line", None, "delete", False, False, None), (6, None, "demolition-footprint", None, None, "area", None, "auto", False, True, None),
        (7, None, None, None, None, "area", "gravel", "auto", True, False, None), (8, None, None, None, None, "area", None, "auto", True, False, "f2"), (9, None, None, None, "lake", "area", None, "add", True, False, None), (10, None, None, None, "lake", "area", None, "auto", True, False, None)],
        "candidate_id int, kind string, semantic string, classification string, text string, shape string, material string, operation string, current boolean, demolished boolean, certified string")
    at = {1: 0.0, 2: 500.0, 3: 700.0, 4: 900.0, 5: 900.0, 6: 100.0, 7: 0.0, 8: 0.0, 9: 300.0, 10: 300.0}
    boxes = spark.createDataFrame([(k, "area", x, 0.0, x + 10, 10.0) for k, x in at.items()], f"candidate_id int, family string, {BOX}")
    f = spark.createDataFrame([("f1", "building", "area", 100.0, 0.0, 110.0, 10.0), ("f2", "water", "area", 300.0, 0.0, 310.0, 10.0)], f"id string, kind string, family string, {BOX}")
    got = {r.candidate_id: (r.kind, r.action, r.reason, r.target) for r in H.compile_changes(c.join(boxes, "candidate_id"), f).collect()}
    assert got == {
        1: (None, "review", "terrain-geometry-immutable", None), 2: ("barrier", "add", "automatic-current-planning-gap-fill", None), 3: ("building", "review", "match-only-evidence-has-no-existing-target", None),
        4: ("path", "ignored", "planning-not-current-world-authority", None), 5: ("path", "review", "delete-not-current-authority", None), 6: ("building", "delete", "confirmed-demolition", "f1"),
        7: ("surface", "paint", "planning-surface-paint-only", None), 8: ("water", "replace", "automatic-current-planning-replace", "f2"), 9: ("water", "review", "explicit-add-conflicts-with-existing-feature", None), 10: ("water", "retain", "planning-corroborates-existing-geometry", "f2")}


PTS = "array<struct<x:double,z:double>>"


def test_lines_as_tables(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 10.0)], 2.0, 6.0), (2, [(3.0, 3.0)], 1.0, 1.0), (3, None, 1.0, 1.0)], f"id int, line {PTS}, a double, b double")
    s = {r.id: [(p.x, p.z) for p in r.line] for r in N.simplified(df, "id", "line", 0.5).collect()}
    assert s == {1: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 2: [(3.0, 3.0)], 3: []}
    r = N.resampled(df, "id", "line", 1.0).collect()
    assert {x.id for x in r} == {1} and len(r) >= 20
    c = [(x.part, [(p.x, p.z) for p in x.line]) for x in N.clipped(df.where("id = 1"), "id", "line", (2.0, -1.0, 20.0, 4.0)).collect()]
    assert len(c) == 1 and c[0][1][0][0] == 2.0 and c[0][1][-1] == (10.0, 4.0)
    cells = N.tapered(df, "id", "line", "a", "b").collect()
    low, high = (sum(1 for q in cells if q.x == x and q.z < 6) for x in (2, 8))
    assert 2 <= low < high
    v = spark.createDataFrame([(1, 0, 0, 0, 3, 1, 0), (2, None, 0, 0, 1, 1, 1)], "id int, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int")
    assert sorted((q.id, q.x, q.y, q.z) for q in N.voxel_lines(v, "id", ["x1", "y1", "z1"], ["x2", "y2", "z2"]).collect())[0] == (1, 0, 0, 0)
    ring = [(4.0, -2.0), (6.0, -2.0), (6.0, 2.0), (4.0, 2.0)]
    b = spark.createDataFrame([(9, ring, 4.0, -2.0, 6.0, 2.0)], f"bid int, ring {PTS}, {BOX}")
    free = sorted((q.part, q.line[0].x, q.line[-1].x, q.line[-1].z) for q in N.free_routes(df.where("id = 1"), "id", "line", b).collect())
    assert len(free) == 2 and free[0][2] <= 4.5 and free[1][1] >= 5.5 and free[1][3] == 10.0
    for f in (N.simplified(df.limit(0), "id", "line", 1.0), N.free_routes(df.limit(0), "id", "line", b)):
        assert f.count() == 0
    plan = N.free_routes(df, "id", "line", b)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a line makes any number of steps; Spark would send them all to the driver


def test_masks_as_tables(spark):
    cells = [(1, x, z) for x in range(-3, 20) for z in range(5)] + [(1, x, z) for x in range(8, 12) for z in range(5, 20)] + [(2, 0, 0)]
    df = spark.createDataFrame(cells, "k int, x int, z int")
    own = {(x, z) for k, x, z in cells if k == 1}
    rings = N.outlines(df, "k").collect()
    length = sum(abs(a.x - b.x) + abs(a.z - b.z) for r in rings if r.k == 1 for a, b in zip(r.ring, [*r.ring[1:], r.ring[0]]))
    assert length == sum((x + i, z + j) not in own for x, z in own for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    far = {(r.x, r.z): r.distance for r in N.chamfer_distance(df, "k").collect() if r.k == 1}
    assert set(far) == own and far[-3, 2] == 10 and max(far.values()) == 30
    paths = [r for r in N.recovered_paths(df, "k").collect() if r.k == 1]
    assert 3 <= len(paths) <= 4 and 25 < sum(r.length for r in paths) < 45
    assert N.skeletons(df.limit(0), "k").count() == 0
