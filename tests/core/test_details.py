import numpy as np
from pyspark.sql import functions as F

from strataweave.operators import details as D

BOX = "min_x double, min_z double, max_x double, max_z double"


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_gates(spark):
    L = F.lit
    cases = [("building-footprint-or-room", "site", "building", True), ("building-footprint-or-room", "site", "path", False), ("ride-centerline-or-edge", "Ride Layout", "ride_track", True), ("ride-centerline-or-edge", "site", "ride_track", False), ("ride-centerline-or-edge", "ride_layout", "path", False), ("ride-envelope-or-structure", "ride-layout", "structure", True), ("anything", "site", "building", False), ("site-edge-or-route", "site", "barrier", True)]
    assert one(spark, *[D.semantic_fits(L(s), L(c), L(k)) for s, c, k, _ in cases]) == [w for *_, w in cases]
    assert one(spark, D.current_authority(L(True), L("current")), D.current_authority(L(None).cast("boolean"), L("current")), D.current_authority(L(True), L("proposed"))) == [True, False, False]
    assert one(spark, D.material_role(L("slate"), L(None).cast("string"), L("building")), D.material_role(L("brick"), L(""), L("structure")), D.material_role(L("brick"), L(""), L("barrier")), D.legend_code(L("p - 12a")), D.legend_code(L("PAVING"))) == ["roof", "wall", "barrier", "P12A", None]
    r = one(spark, *[D.reclassify(L(k), L(t), L(b)) for k, t, b in (("unknown", "North elevation", ""), ("unknown", "x", "coaster track layout"), ("unknown", "x", "north elevation"), ("decision", "North elevation", ""))])
    assert [(x.classification, x.confidence) for x in r] == [("elevation", 0.95), ("ride_layout", 0.94), ("unknown", 0.0), ("decision", 1.0)]
    s = one(spark, D.surface_style(L(None).cast("string"), L("asphalt"), L("brick"), L(True)), D.surface_style(L(None).cast("string"), L(None).cast("string"), L("brick"), L(None).cast("boolean")))
    assert [(x.material, x.source) for x in s] == [("asphalt", "tag"), ("unknown", "fallback")]


def test_signs(spark):
    got = one(spark, D.wrap_sign(F.lit("The Quite Long Name Of A Very Big Attraction With Many Words And Then Some More Of Them")), D.wrap_sign(F.lit("Short")), D.wrap_sign(F.lit("x" * 45)))
    assert got[1] == ["Short"] and got[2] == ["x" * 20, "x" * 20, "x" * 5]
    assert len(got[0]) == 4 and all(len(x) <= 20 for x in got[0]) and got[0][-1].endswith("…")


def test_edit_match(spark):
    pts = "points array<struct<x:double,z:double>>"
    sq = lambda x: [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0)]
    e = spark.createDataFrame([(1, "auto", "path", "A", sq(0.0), 0.0, 0.0, 4.0, 4.0), (2, "delete", "path", None, sq(6.0), 6.0, 0.0, 10.0, 4.0), (3, "auto", "water", None, sq(0.0), 0.0, 0.0, 4.0, 4.0)], f"edit_id int, operation string, kind string, name string, {pts}, {BOX}")
    f = spark.createDataFrame([("a", "path", "a", 100, sq(0.0), 0.0, 0.0, 4.0, 4.0), ("b", "water", None, 300, sq(0.0), 0.0, 0.0, 4.0, 4.0)], f"id string, kind string, name string, rank int, {pts}, {BOX}")
    assert [(r.edit_id, r.target, r.score) for r in D.edit_match(e, f).collect()] == [(1, "a", 1.0)]


def test_water(spark):
    m = spark.createDataFrame([("a", None, 0.0, 0.0, 10.0, 10.0), ("b", "Tarn", 0.0, 0.0, 10.0, 9.0), ("c", None, 8.0, 8.0, 20.0, 20.0)], f"id string, name string, {BOX}")
    o = spark.createDataFrame([("o", "Mere", 0.0, 0.0, 10.0, 10.0)], f"id string, name string, {BOX}")
    assert [r.id for r in D.suppress_water(m, o).collect()] == ["a"]
    s = spark.createDataFrame([("t", 5.0, 1.0)] + [("s", None, x) for x in (1.0, 2.0, 3.0)] + [("u", None, x) for x in (1.0, 50.0)], "k string, tag_level double, shore double")
    assert {r.k: (r.level, r.source) for r in D.water_level(s, "k").collect()} == {"t": (5.0, "tag"), "s": (2.0, "shoreline"), "u": (None, "unknown")}


def test_labels_entrances_templates(spark):
    t = spark.createDataFrame([(1, "p", 0.0, 0.0, 2.0, 2.0), (2, "p", 10.0, 0.0, 12.0, 2.0), (3, "p", 90.0, 0.0, 91.0, 1.0)], f"id int, page string, {BOX}")
    l = spark.createDataFrame([("p", 3.0, 1.0, "path"), ("p", 13.0, 1.0, "road"), ("p", 9.0, 1.0, "path"), ("q", 90.0, 0.0, "x")], "page string, x double, z double, label string")
    assert {r.id: (r.label, r.status) for r in D.nearest_label(t, l, "id", 2.0).collect()} == {1: ("path", "labelled"), 2: (None, "ambiguous"), 3: (None, "none")}
    d = spark.createDataFrame([(1, 1, 0.0, 1.0), (2, 5, 0.0, 2.0), (3, 9, 0.0, 50.0)], "id int, rank int, x double, z double")
    w = spark.createDataFrame([("A", -5.0, 0.0, 5.0, 0.0), ("B", -5.0, 8.0, 5.0, 8.0)], "building string, ax double, az double, bx double, bz double")
    assert [(r.building, r.entrance) for r in D.entrances(d, w).collect()] == [("A", 2)]
    th = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "id int, code string")
    te = spark.createDataFrame([("S1", "t1"), ("S2", "t2"), ("S2", "t3")], "code string, template_id string")
    assert {r.id: (r.template_id, r.status) for r in D.unique_template(th, te, "code").collect()} == {1: ("t1", "matched"), 2: (None, "ambiguous"), 3: (None, "no-template")}


def test_relevance_mosaic_alignment(spark):
    a = spark.createDataFrame([(1, "Galactica"), (2, "Forbidden Valley Arena"), (3, "Oak")], "anchor_id int, name string")
    t = spark.createDataFrame([(10, "A new galactica station"), (11, "arena in the forbidden valley"), (12, "nothing")], "application_id int, text string")
    assert {(r.anchor_id, r.application_id): round(r.score, 9) for r in D.relevant_applications(a, t).collect()} == {(1, 10): 1.0, (2, 11): 0.9}
    m = spark.createDataFrame([(0, "coarse", 1.0, 5.0), (0, "fine", 0.25, None), (1, "coarse", 1.0, 6.0), (1, "fine", 0.25, 7.0)], "x int, layer string, resolution double, value double")
    assert {r.x: (r.value, r.layer) for r in D.mosaic(m, ["x"]).collect()} == {0: (5.0, "coarse"), 1: (7.0, "fine")}
    p = spark.createDataFrame([("a", 0.0, 0.5), ("a", 5.0, 2.5), ("b", 0.0, 90.0)], "k string, x double, z double")
    s = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("b", 0.0, 0.0, 10.0, 0.0)], "k string, ax double, az double, bx double, bz double")
    assert {r.k: (r["mean"], r.largest, r.status) for r in D.alignment(p, s, "k").collect()} == {"a": (1.5, 2.5, "close"), "b": (50.0, 50.0, "review-required")}


def test_growth_and_decisions(spark):
    st = spark.createDataFrame([(1, "s", True, 0.0, 0.0, 1.0, 0.0), (2, "s", False, 1.2, 0.0, 2.0, 0.0), (3, "t", False, 2.0, 0.0, 3.0, 0.0), (4, "s", False, 9.0, 0.0, 10.0, 0.0), (5, "s", False, 2.0, 0.5, 2.0, 5.0)], "id int, style string, seed boolean, ax double, az double, bx double, bz double")
    assert sorted(r.id for r in D.grow(st).collect()) == [1, 2, 5]
    pg = spark.createDataFrame([("a", "current"), ("a", "refused"), ("b", "current"), ("b", "proposed"), ("c", "current"), ("d", None)], "k string, state string")
    assert {r.k: r.decision for r in D.page_decision(pg, "k").collect()} == {"a": "excluded", "b": "ambiguous", "c": "current", "d": "unknown"}
    rv = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, "x"), ("b", 3, "z")], "k string, r int, v string")
    assert {r.k: (r.value, r.status) for r in D.agreeing_latest(rv, "k", "r", "v").collect()} == {"a": ("y", "latest"), "b": (None, "conflict")}
    sp = spark.createDataFrame([("p", 0, 5, 0.9, "specific"), ("p", 3, 8, 0.5, "generic"), ("p", 5, 9, 0.8, "next")], "k string, a int, b int, confidence double, name string")
    assert sorted(r.name for r in D.shadowed(sp, "k").collect()) == ["next", "specific"]
    fs = spark.createDataFrame([("h", 1, 5, "late"), ("h", 1, 2, "early"), ("g", 1, 9, "only")], "h string, p int, o int, t string")
    assert sorted((r.h, r.t) for r in D.first_seen(fs, ["h", "p"], "o").collect()) == [("g", "only"), ("h", "early")]
    assert {(r.k, r.change) for r in D.tombstones(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), "k").collect()} == {(1, "removed"), (3, "added")}


def test_first_seen_ties_do_not_depend_on_row_order(spark):
    rows = [("h", 5, 7, "b", {"k": 1}), ("h", 5, 3, "z", {"k": 2}), ("h", 5, 3, "a", {"k": 2}), ("h", None, 0, "a", {"k": 0}), ("n", None, 2, "y", {"k": 1})]
    for r in (rows, rows[::-1], rows[2:] + rows[:2]):
        d = spark.createDataFrame(r, "h string, o int, g int, t string, m map<string, int>")
        for parts in (1, 3):
            assert sorted(tuple(x) for x in D.first_seen(d.coalesce(1) if parts == 1 else d.repartition(parts), ["h"], "o").collect()) == [("h", 5, 3, "a", {"k": 2}), ("n", None, None, None, None)]


def test_merged_bundles_ties_do_not_depend_on_row_order(spark):
    rows = [("h", 1, 0, 5, 9, 1), ("h", 1, 0, 5, 4, 6), ("h", 2, 1, 1, 2, 2), ("h", 2, 0, 3, 8, 8)]
    for r in (rows, rows[::-1]):
        p = spark.createDataFrame(r, "content_hash string, page int, bundle int, seq int, geometry int, levels int").coalesce(1)
        got = D.merge_bundles(p, p.select("content_hash"), p.where("geometry < 5").select("content_hash", "page"), ["geometry", "levels"]).collect()
        assert [x.asDict() for x in got] == [{"pages": 2, "geometry": 12, "levels": 14, "documents": 1, "fallback_pages": 2}]


def test_merged_bundles_take_pages_without_a_bundle_last(spark):
    p = spark.createDataFrame([("h", 1, None, 1, 9), ("h", 1, 2, None, 7), ("h", 1, 2, 8, 5), ("g", 1, None, None, 3)], "content_hash string, page int, bundle int, seq int, geometry int")
    assert [(r.pages, r.geometry) for r in D.merge_bundles(p, p.select("content_hash"), p.select("content_hash", "page"), ["geometry"]).collect()] == [(2, 8)]


def test_placement(spark):
    c = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 0, 2.0), ("b", 0, 0, 0.5), ("b", 9, 9, 3.0), ("c", 0, 0, 0.7)], "o string, x int, z int, score double")
    assert {r.o: (r.x, r.z) for r in D.sign_cells(c, "o").collect()} == {"b": (0, 0), "a": (1, 0)}
    x = spark.createDataFrame([("a", 0, 0), ("a", 1, 0)], "i string, x int, z int")
    y = spark.createDataFrame([("b", 1, 0), ("b", 2, 0), ("b", 3, 0)], "j string, x int, z int")
    assert [tuple(r) for r in D.cell_overlap(x, y, "i", "j").collect()] == [("a", "b", 0.5)]
    tr = spark.createDataFrame([(1, 0, 10, 0, 5)], "id int, x int, y int, z int, height int")
    v = {(r.x, r.y, r.z): r.block for r in D.tree_voxels(tr, [(0, 0, 0, "log"), (0, 1, 0, "log"), (1, 1, 0, "leaves"), (0, 2, 0, "leaves")]).collect()}
    assert [v[0, y, 0] for y in range(11, 16)] == ["log", "log", "log", "leaves", "leaves"] or v[0, 11, 0] == "log" and v[0, 15, 0] == "leaves" and len({y for _, y, _ in v}) == 5
    track = np.c_[np.arange(0, 40.0), np.full(40, 10.0), np.zeros(40)]
    assert D.support_levels(track, np.zeros(40), 6.0, 3.0).tolist() == [3, 9, 15, 21, 27, 33, 39]
    assert D.support_levels(track, np.full(40, 9.0), 6.0, 3.0).tolist() == []
    lc = spark.createDataFrame([("a", "grass"), ("a", "grass"), ("a", "rock")], "k string, class string")
    assert {r["class"]: round(r.share, 3) for r in D.land_cover(lc, "k").collect()} == {"grass": 0.667, "rock": 0.333}
    assert one(spark, D.cross_section_confidence(F.lit(1.0), F.lit(0.1), F.lit(30.0), F.lit(0.0), F.lit(True))) == [1.0]
