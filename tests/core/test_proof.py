"""Proofs, anchored profiles, planting and covered ways, against plain re-derivations and literals."""

import math
import random

from pyspark.sql import functions as F

from strataweave.functions import appearance as A
from strataweave.functions.scalars import hash_2d
from strataweave.operators import details as D
from strataweave.operators import ordered as O
from strataweave.operators import proof as P
from strataweave.operators import spatial as J


def test_planting_in_order_of_weighted_hash_up_to_a_target(spark):
    rnd = random.Random(5)
    rows = [(a, float(x), float(z), rnd.choice([0.0, 0.08, 0.65, 1.0, 1.45])) for a in range(3) for x in range(0, 30, 2) for z in range(0, 30, 2)]
    most = {0: 7, 1: 1000, 2: 25}
    df = spark.createDataFrame(rows, "a int, x double, z double, m double")
    hashed = {(r.x, r.z): r.h for r in df.select("x", "z", hash_2d(F.floor(F.col("x") + 0.5), F.floor(F.col("z") + 0.5), 0).alias("h")).distinct().collect()}
    target = F.when(F.col("a") == 0, 7).when(F.col("a") == 1, 1000).otherwise(25)
    got = {}
    for r in O.blue_noise(df, "a", "x", "z", 5.0, multiplier=F.col("m"), target=target).collect():
        got.setdefault(r.a, set()).add((r.x, r.z))
    for a in most:
        kept = []
        for _, _, z, x in sorted((hashed[x, z] / m, hashed[x, z], z, x) for k, x, z, m in rows if k == a and m > 0):
            if len(kept) < most[a] and all(math.hypot(x - i, z - j) >= 5 for i, j in kept):
                kept.append((x, z))
        assert got[a] == set(kept)
    factor = lambda g, m: spark.range(1).select(A.planting_factor(F.lit(g), F.lit(m)).alias("f")).first().f
    assert [factor("grass", "shrubland"), factor("grass", "tree"), factor("shadow", "tree"), factor(None, "tree"), factor("unclassified", "tree")] == [0.65, 0.28, 0.0, 1.0, 0.65]


def test_profile_is_never_continued_beyond_its_anchors(spark):
    anchors = spark.createDataFrame([(1, 10.0, 100.0, 0.9, "b"), (1, 10.5, 102.0, 0.8, "a"), (1, 20.25, 111.0, 0.95, "c"), (2, 4.0, 50.0, 0.9, "d"), (3, 4.0, 50.0, 0.9, "e"), (3, 8.0, 51.0, 0.9, "f")], "k int, at double, level double, c double, ref string")
    samples = spark.createDataFrame([(k, float(x)) for k in (1, 2, 3) for x in range(8, 23)] + [(1, 10.25), (4, 1.0)], "k int, at double")
    got = {(r.k, r.at): r for r in O.anchored_profile(samples, anchors, ["k"], "at", "level", "c", "ref").collect()}
    assert len(got) == 47
    assert all(r.evidence == "none" and r.level is None and r.c is None for (k, x), r in got.items() if k > 1 or x < 10.25 or x > 20.25)
    assert (got[1, 10.25].level, got[1, 10.25].c, got[1, 10.25].ref, got[1, 10.25].evidence) == (101.0, 0.8, "a|b", "planning-verified")
    assert got[1, 20.0].evidence == "planning-verified" and got[1, 20.0].level == 111.0
    mid = got[1, 15.0]
    assert mid.evidence == "interpolated" and abs(mid.level - (101 + 10 * 4.75 / 10)) < 1e-9 and abs(mid.c - 0.8 * 0.82) < 1e-12 and mid.ref == "a|b|c"


def test_depth_of_open_maps_is_only_reported(spark):
    def depth(direct, maximum, rank, provider):
        r = spark.range(1).select(D.water_depth(F.lit(direct).cast("double"), F.lit(maximum).cast("double"), F.lit(rank), F.lit(provider)).alias("d")).first().d
        return r.status, r.depth, r.max_depth

    assert depth(8, None, 100, "OpenStreetMap") == ("reported-not-bathymetry", None, None)
    assert depth(8, None, 500, "OpenStreetMap") == ("reported-not-bathymetry", None, None)
    assert depth(4, None, 300, "Survey Water") == ("measured", 4.0, None) and depth(None, 6, 300, "Survey Water") == ("measured-max-depth", None, 6.0)
    assert depth(900, None, 300, "Survey Water")[0] == "reported-not-bathymetry" and depth(None, None, 300, None) == ("unknown", None, None)
    s = spark.createDataFrame([("few", None, 10.0)] * 3 + [("flat", None, h) for h in (10.0, 10.0, 11.0, 12.0)] + [("steep", None, h) for h in (0.0, 5.0, 9.0, 20.0)] + [("tag", 7.0, None)], "w string, tag_level double, shore double")
    got = {r.w: (r.level, r.source) for r in D.water_level(s, "w", 4).collect()}
    assert got == {"few": (None, "unknown"), "flat": (10.5, "shoreline"), "steep": (None, "unknown"), "tag": (7.0, "tag")}


def test_covered_ways_go(spark):
    box = "min_x double, min_z double, max_x double, max_z double"
    rows = [
        (1, "relation", "water", None, "Mere  Lake", 0.0, 0.0, 900.0, 900.0), (2, "way", "water", None, " mere lake", 10.0, 10.0, 20.0, 20.0), (3, "way", "water", None, "mere lake", 850.0, 10.0, 960.0, 20.0),
        (4, "way", "path", None, "mere lake", 10.0, 10.0, 20.0, 20.0), (5, "way", "water", "pond", "mere lake", 10.0, 10.0, 20.0, 20.0), (6, "way", "water", None, None, 10.0, 10.0, 20.0, 20.0),
        (7, "way", "water", None, "MERE LAKE", 5.0, 5.0, 5.0, 9.0), (8, "way", "water", None, "mere lake", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id int, element string, kind string, subtype string, name string, {box}")
    assert sorted(r.id for r in J.relations_over_ways(df).collect()) == [1, 3, 4, 5, 6, 8]
    assert J.relations_over_ways(df.limit(0)).count() == 0


def test_pages_need_independent_anchors(spark):
    pages = spark.createDataFrame(
        [(1, "a", "site_plan", "proposed", None, [], True), (2, "a", "site_plan", "proposed", None, [], True), (3, "a", "site_plan", "unknown", "ambiguous-document-revision-lineage", ["Granted"], True),
         (4, "b", "location_plan", "current", None, None, True), (5, "b", "site_plan", "refused", None, None, True), (6, "c", None, None, None, None, None)],
        "page_id int, application string, class string, state string, reason string, statuses array<string>, registered boolean",
    )
    own = spark.createDataFrame([(p, f, "path", "anchor", 0.9) for p in (1, 4, 5) for f in range(3)] + [(2, f, "path", "anchor", 0.9) for f in (0, 1)] + [(2, 9, "path", "duplicate-feature", None)], "page_id int, feature_id int, feature_kind string, status string, score double")
    single = spark.createDataFrame([(2, f % 2, "path", 0.9) for f in range(3)] + [(3, f % 2, ("path", "water")[f % 2], 0.8) for f in range(8)] + [(1, 77, "road", 0.1)], "page_id int, feature_id int, feature_kind string, score double")
    c = P.certified_pages(pages, own, single)
    got = {r.page_id: (r.status, r.anchors, r.features) for r in c.collect()}
    assert got[1] == ("implemented-plan-certified", 3, 3) and got[2] == ("insufficient-independent-current-anchors", 5, 2) and got[3] == ("implemented-plan-certified", 8, 2)
    assert got[4][0] == "implemented-context-certified" and got[5][0] == "page-explicitly-non-current" and got[6] == ("page-not-spatially-registered", 0, 0)
    apps = P.proved_applications(c, own, single).collect()
    assert [(r.application, r.pages, r.anchors, r.features) for r in apps] == [("a", 2, 11, 3)] and abs(apps[0].confidence - 0.896) < 1e-9
