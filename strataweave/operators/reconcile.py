"""Rules that reconcile records: lifecycle, widths, surfaces, names, containment, repair of paths, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.geometry import in_ring, segment_distance
from strataweave.functions.ladders import LIFECYCLE_RANK
from strataweave.functions.scalars import clamp, half_up, length_m
from strataweave.operators.spatial import BOX, best_of, box_join

EXCLUDED = ("demolished", "refused", "withdrawn", "superseded")


def combine_lifecycle(evidence: DataFrame, key: str) -> DataFrame:
    """(key, state, confidence) from rows (key, state, confidence, source).

    States that exclude beat all. Current against proposed is unknown, unless the title block says current with .95 or more. Otherwise
    the highest rank, then confidence. Nothing known is unknown at .45.
    """
    s, c = F.col("state"), F.col("confidence")
    rank = F.lit(0)
    for name, r in LIFECYCLE_RANK.items():
        rank = F.when(s == name, r).otherwise(rank)
    top = lambda cond: F.max(F.when(cond, F.struct(c.alias("c"), s.alias("s"))))
    g = evidence.groupBy(key).agg(
        top(s.isin(*EXCLUDED)).alias("x"), F.max(F.when(s == "current", c)).alias("cur"), F.max(F.when(s == "proposed", c)).alias("pro"),
        F.max(F.when((s == "current") & (F.col("source") == "drawing-title-block"), c)).alias("title"), F.max(F.when(s.isNotNull(), F.struct(rank.alias("r"), c.alias("c"), s.alias("s")))).alias("best"))
    clash = F.col("cur").isNotNull() & F.col("pro").isNotNull()
    proved = (F.col("title") >= 0.95) & (F.col("title") >= F.col("cur"))
    state = F.when(F.col("x").isNotNull(), F.col("x.s")).when(clash & proved, "current").when(clash, "unknown").otherwise(F.coalesce(F.col("best.s"), F.lit("unknown")))
    conf = F.when(F.col("x").isNotNull(), F.col("x.c")).when(clash & proved, F.col("cur")).when(clash, half_up(F.least("cur", "pro"), 3)).otherwise(F.coalesce(F.col("best.c"), F.lit(0.45)))
    return g.select(key, state.alias("state"), conf.alias("confidence"))


def path_width(tags: Column, kind: Column, family: Column, image_width: Column | None = None, image_confidence: Column | None = None, prior: Column | None = None) -> Column:
    """struct(width_m, status, confidence): area, start and end, observed, measured, carriageway, imagery, estimate, lanes, prior, unknown; the first that is there."""
    t = lambda *ks: F.coalesce(*[length_m(F.try_element_at(tags, F.lit(k))) for k in ks])
    fit = lambda w: clamp(half_up(w, 1), 0.5, 40)
    start, end = t("width:start", "width_start"), t("width:end", "width_end")
    lanes = F.try_element_at(tags, F.lit("lanes")).try_cast("int")
    lane = clamp(F.coalesce(t("lane_width"), F.lit(3.1)), 2.4, 4)
    img = image_width if image_width is not None else F.lit(None).cast("double")
    img_c = image_confidence if image_confidence is not None else F.lit(None).cast("double")
    pri = prior if prior is not None else F.lit(None).cast("double")
    row = lambda w, s, c: F.struct(w.alias("width_m"), F.lit(s).alias("status"), c.alias("confidence"))
    return (
        F.when(family == "area", row(F.lit(None).cast("double"), "area-footprint", F.lit(0.98)))
        .when((start > 0) & (end > 0), row(half_up((fit(start) + fit(end)) / 2, 1), "variable-width-tagged", F.lit(0.92)))
        .when(t("width") > 0, row(fit(t("width")), "observed-width", F.lit(0.95))).when(t("measured_width_m") > 0, row(fit(t("measured_width_m")), "observed-width", F.lit(0.98)))
        .when(t("width:carriageway") > 0, row(fit(t("width:carriageway")), "observed-width", F.lit(0.92))).when(img > 0, row(fit(img), "orthophoto-edge-observed", img_c))
        .when(t("est_width") > 0, row(fit(t("est_width")), "tag-estimate", F.lit(0.76)))
        .when((kind == "road") & (lanes > 0), row(half_up(lanes * lane, 1), "lanes-derived", F.when(t("lane_width").isNotNull(), 0.82).otherwise(0.64)))
        .when(pri > 0, row(pri, "class-prior", F.lit(0.4))).otherwise(row(F.lit(None).cast("double"), "unknown-marker", F.lit(0.0)))
    )


def fill_style(colour: Column, step: int = 4) -> Column:
    """Key of a fill: channels in steps; near-white has none."""
    q = F.transform(colour, lambda v: F.floor(v / step + 0.5) * step)
    return F.when((F.size(colour) == 3) & ~F.forall(q, lambda v: v >= 248), F.concat(F.lit("fill:"), F.array_join(q.cast("array<string>"), ",")))


def hatch_style(dx: Column, dz: Column, colour: Column, width: Column, dash: Column | None = None) -> Column:
    """Key of a hatch stroke of 1.5 to 220 points: angle in 15 degree steps, colour in steps of 8, width in quarters; the first six dashes in halves, if given."""
    n = F.hypot(dx, dz)
    angle = F.pmod(F.floor(F.pmod(F.degrees(F.atan2(dz, dx)), F.lit(180.0)) / 15 + 0.5) * 15, F.lit(180))
    q = F.transform(colour, lambda v: F.floor(v / 8 + 0.5) * 8)
    steps = [] if dash is None else [F.concat(F.lit("d"), F.array_join(F.transform(F.slice(dash, 1, 6), lambda v: (F.floor(v * 2 + 0.5) / 2).cast("string")), ","))]
    return F.when(n.between(1.5, 220), F.concat_ws(":", F.lit("hatch"), F.concat(F.lit("a"), angle.cast("int")), F.concat(F.lit("c"), F.array_join(q.cast("array<string>"), ",")), F.concat(F.lit("w"), F.floor(width * 4 + 0.5) / 4), *steps))


def duplicate_confidence(a: dict[str, Column], b: dict[str, Column], tolerance: Column) -> Column:
    """Of two areas: the larger of overlap over union and .9 of the containment; .35 for a gap within tolerance; else 0."""
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_z"], b["max_z"]) - F.greatest(a["min_z"], b["min_z"])
    i = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    area = lambda q: F.greatest(F.lit(1.0), (q["max_x"] - q["min_x"]) * (q["max_z"] - q["min_z"]))
    gap = F.hypot(F.greatest(F.lit(0.0), -w), F.greatest(F.lit(0.0), -h))
    full = F.greatest(i / F.greatest(F.lit(1.0), area(a) + area(b) - i), 0.9 * i / F.greatest(F.lit(1.0), F.least(area(a), area(b))))
    return F.when(i > 0, full).when(gap <= tolerance, 0.35).otherwise(0.0)


def supersede(official: DataFrame, fallback: DataFrame, size: float = 32.0, tolerance: float = 3.0) -> DataFrame:
    """Fallback rows (id, kind, name, box) with action 'superseded' (and by whom), 'ambiguous' or 'kept', by official rows of one kind and no other name."""
    pairs = box_join(official, fallback, size, tolerance, "o", "f").where((F.col("o.kind") == F.col("f.kind")) & (F.col("o.name").isNull() | F.col("f.name").isNull() | (F.lower(F.trim("o.name")) == F.lower(F.trim("f.name")))))
    c = pairs.select(F.col("f.id").alias("id"), F.col("o.id").alias("by"), duplicate_confidence({k: F.col(f"o.{k}") for k in BOX}, {k: F.col(f"f.{k}") for k in BOX}, F.lit(tolerance)).alias("c"))
    best = c.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("n"), F.col("by").alias("by"))).alias("b"))
    j = fallback.join(best, "id", "left")
    conf = -F.col("b.n")
    return j.withColumn("action", F.when(conf >= 0.72, "superseded").when(conf >= 0.35, "ambiguous").otherwise("kept")).withColumn("superseded_by", F.when(conf >= 0.72, F.col("b.by"))).drop("b")


def certified_target(candidates: DataFrame, features: DataFrame) -> DataFrame:
    """Candidates (candidate_id, target, kind) with status: a trusted target skips the search, but a missing or incompatible one fails closed."""
    j = candidates.join(features.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target", "left")
    return j.withColumn("status", F.when(F.col("target").isNull(), "search").when(F.col("target_kind").isNull(), "certified-target-missing").when(F.col("target_kind") != F.col("kind"), "certified-target-incompatible").otherwise("accepted"))


def structure_ride(structures: DataFrame, rides: DataFrame, reach: float = 28.0, gap: float = 4.0) -> DataFrame:
    """The ride of each structure (id, ride_ref, name, x, z): explicit id, then a name that one ride has, then the nearest within ``reach`` unless the second is within ``gap``."""
    one = rides.where("name is not null").groupBy(F.lower("name").alias("n")).agg(F.count("*").alias("c"), F.min("ride_id").alias("named")).where("c = 1").select("n", "named")
    box = lambda df: df.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    pairs = box_join(box(structures.select("id", "x", "z")), box(rides.select("ride_id", "x", "z")), reach, reach)
    near = pairs.select(F.col("l.id").alias("id"), F.col("r.ride_id").alias("near"), F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.z") - F.col("r.z")).alias("distance")).where(F.col("distance") <= reach)
    best = best_of(near, ["id"], "near", "distance", reach, gap, smaller_is_better=True)
    j = structures.join(rides.select(F.col("ride_id").alias("by_id")), structures["ride_ref"] == F.col("by_id"), "left").join(one, F.lower("name") == F.col("n"), "left").join(best.select("id", "near", "status"), "id", "left")
    ride = F.coalesce("by_id", "named", F.when(F.col("status") == "accepted", F.col("near")))
    return j.select("id", ride.alias("ride_id"), F.when(F.col("by_id").isNotNull(), "explicit").when(F.col("named").isNotNull(), "name").when(F.col("status") == "accepted", "nearest").when(F.col("status").isNotNull(), "ambiguous").otherwise("none").alias("method"))


def points_in_areas(points: DataFrame, areas: DataFrame, size: float = 32.0) -> DataFrame:
    """(point row p, area row a) for points (x, z) inside the ring of areas (box, ring)."""
    p = points.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    return box_join(p, areas, size, 0.0, "p", "a").where(in_ring(F.col("p.x"), F.col("p.z"), F.col("a.ring")))


def children_of(points: DataFrame, areas: DataFrame, point_id: str, area_id: str) -> DataFrame:
    """(area, n, children): what lies in each area; areas are of human size, a parking area holds bays."""
    inside = points_in_areas(points, areas).groupBy(F.col(f"a.{area_id}").alias(area_id)).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col(f"p.{point_id}"))).alias("children"))
    return areas.select(area_id).join(inside, area_id, "left").select(area_id, F.coalesce("n", F.lit(0)).alias("n"), "children")


def repair_gaps(endpoints: DataFrame, segments: DataFrame, tolerance: float = 6.0, least: float = 0.82) -> DataFrame:
    """The connector of each dangling end (end_id, feature, component, x, z, out_x, out_z, surface): to the segment (feature, component, ax, az, bx, bz, surface) within .2 to ``tolerance``, not backwards, one that joins components first."""
    e = endpoints.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    s = segments.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_z": F.least("az", "bz"), "max_z": F.greatest("az", "bz")})
    p = box_join(e, s, max(8.0, 2 * tolerance), tolerance, "e", "s").where(F.col("e.feature") != F.col("s.feature")).select("e.*", *[F.col(f"s.{c}").alias(f"s_{c}") for c in ("feature", "component", "ax", "az", "bx", "bz", "surface")])
    dx, dz = F.col("s_bx") - F.col("s_ax"), F.col("s_bz") - F.col("s_az")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((F.col("x") - F.col("s_ax")) * dx + (F.col("z") - F.col("s_az")) * dz) / F.nullif(dx * dx + dz * dz, F.lit(0.0)), F.lit(0.0))))
    p = p.withColumns({"to_x": F.col("s_ax") + t * dx, "to_z": F.col("s_az") + t * dz}).withColumn("distance", segment_distance(F.col("x"), F.col("z"), F.col("s_ax"), F.col("s_az"), F.col("s_bx"), F.col("s_bz")))
    turn = ((F.col("to_x") - F.col("x")) * F.col("out_x") + (F.col("to_z") - F.col("z")) * F.col("out_z")) / F.nullif(F.col("distance") * F.hypot("out_x", "out_z"), F.lit(0.0))
    p = p.withColumn("continuation", F.coalesce(turn, F.lit(0.0))).withColumn("joins", F.col("component") != F.col("s_component")).where((F.col("distance") >= 0.2) & (F.col("distance") <= tolerance) & (F.col("continuation") >= -0.15))
    best = p.groupBy("end_id").agg(F.min(F.struct((~F.col("joins")).alias("apart"), "distance", (-F.col("continuation")).alias("back"), F.col("s_feature").alias("target"), "to_x", "to_z", "surface", "s_surface")).alias("b"))
    same = F.coalesce(F.col("b.surface") == F.col("b.s_surface"), F.lit(False))
    conf = half_up(F.least(F.lit(0.96), 0.62 + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("b.distance") / tolerance) + 0.06 * F.greatest(F.lit(0.0), -F.col("b.back")) + 0.04 + F.when(same, 0.02).otherwise(0.0) + F.when(~F.col("b.apart"), 0.06).otherwise(0.0)), 3)
    out = endpoints.select("end_id").join(best, "end_id", "left").withColumn("confidence", conf)
    return out.select("end_id", F.col("b.target").alias("target"), half_up("b.distance", 2).alias("distance"), F.when(F.col("b").isNotNull(), F.col("confidence")).alias("confidence"), F.when(F.col("b").isNull(), "no-compatible-route-within-tolerance").when(F.col("confidence") >= least, "accepted").otherwise("review").alias("status"))


def building_heights(cells: DataFrame, key: str) -> DataFrame:
    """Measured heights from footprint cells (key, terrain, surface): differences of 1.5 to 80 m, at least four of them and 35 % of the cells."""
    d = F.col("surface") - F.col("terrain")
    g = cells.withColumn("h", F.when(d.between(1.5, 80), d)).groupBy(key).agg(F.count("*").alias("tried"), F.count("h").alias("n"), F.percentile("h", 0.65).alias("p65"), (F.percentile("h", 0.9) - F.percentile("h", 0.1)).alias("spread"))
    cover = F.col("n") / F.col("tried")
    h, spread = half_up("p65", 1), half_up("spread", 1)
    conf = F.least(F.lit(0.99), half_up(0.45 + 0.25 * cover + 0.2 * F.least(F.lit(1.0), F.log2(F.col("n") + 1) / 7) + 0.1 * F.greatest(F.lit(0.0), 1 - spread / F.greatest(F.lit(6.0), h)), 3))
    ok = (F.col("n") >= 4) & (cover >= 0.35)
    return g.select(key, F.when(ok, h).alias("height_m"), F.when(ok, spread).alias("spread_m"), "n", half_up(cover, 3).alias("coverage"), F.when(ok, conf).alias("confidence"), F.when(ok, "measured").otherwise("insufficient-coverage").alias("status"))


def roof_cells(cells: DataFrame, key: list[str], fallback_height: float = 4.0) -> DataFrame:
    """Roof cells (key, x, z, terrain, surface or null): gaps take the median of three or more measured neighbours, outliers without support are replaced, what is left falls back."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = cells.where("surface is not null").withColumn("_s", F.explode(steps)).select(*key, (F.col("x") + F.col("_s.i")).alias("x"), (F.col("z") + F.col("_s.j")).alias("z"), F.col("surface").alias("near"))
    j = cells.join(sent, [*key, "x", "z"], "left").groupBy(*key, "x", "z").agg(F.first("terrain").alias("terrain"), F.first("surface").alias("surface"), F.count("near").alias("n"), F.median("near").alias("m"), F.count_if(F.abs(F.col("near") - F.col("surface")) <= 1.25).alias("support"))
    odd = (F.col("n") >= 4) & (F.abs(F.col("surface") - F.col("m")) > 2.25) & (F.col("support") < F.when(F.col("n") >= 6, 3).otherwise(2))
    lent = F.when(F.col("n") >= 3, F.col("m")).otherwise(F.col("terrain") + fallback_height)
    how = F.when(F.col("surface").isNull() & (F.col("n") >= 3), "interpolated").when(F.col("surface").isNull(), "fallback").when(odd, "outlier").otherwise("measured")
    return j.select(*key, "x", "z", F.when(F.col("surface").isNull() | odd, lent).otherwise(F.col("surface")).alias("roof"), how.alias("evidence"))


def ride_summary(samples: DataFrame) -> DataFrame:
    """Per ride (name or id) of samples (feature_id, name, elevation, banking, confidence): coverages, range and status."""
    g = samples.groupBy(F.coalesce("name", "feature_id").alias("ride")).agg(F.count("*").alias("n"), F.count("elevation").alias("v"), F.count("banking").alias("b"), F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.avg(F.when(F.col("elevation").isNotNull(), F.coalesce("confidence", F.lit(0.0)))).alias("c"))
    v, b = F.col("v") / F.col("n"), F.col("b") / F.col("n")
    status = F.when((v >= 0.999) & (b >= 0.999), "full-3d-with-banking").when(v >= 0.999, "full-3d-elevation").when(v > 0, "partial-3d").otherwise("2d-only")
    return g.select("ride", status.alias("status"), half_up(v, 3).alias("vertical_coverage"), half_up(b, 3).alias("banking_coverage"), half_up(F.coalesce("c", F.lit(0.0)), 3).alias("confidence"), "low", "high")


def point_radius(samples: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """(sample row s, cloud row c) within ``radius`` in the plane."""
    box = lambda df: df.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    return box_join(box(samples), box(cloud), radius * 2, radius, "s", "c").where(F.pow(F.col("s.x") - F.col("c.x"), 2) + F.pow(F.col("s.z") - F.col("c.z"), 2) <= radius * radius)


def dense_palette(cells: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, palette_id): ids from 0 in order of first use. A palette is a vocabulary of block names, and is checked to be one."""
    first = cells.groupBy(value).agg(F.min(seq).alias("first"))
    if first.count() > 65_536:
        raise ValueError("a palette has at most 65,536 entries")
    return first.withColumn("palette_id", F.row_number().over(Window.orderBy("first", value)) - 1).drop("first")


def conflict_keys(observations: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return observations.groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("value")).select(key, F.when(F.col("n") == 1, F.col("value")).alias("value"), (F.col("n") > 1).alias("conflict"))


def application_proof(anchors: DataFrame, key: str) -> DataFrame:
    """(key, anchors, features, median_score, status) from anchors (key, feature, score, n): four anchors on two features at a median of .78 prove a scheme."""
    from strataweave.operators.fusion import proof_confidence

    g = anchors.groupBy(key).agg(F.sum("n").alias("anchors"), F.count_distinct("feature").alias("features"), F.median("score").alias("median_score"))
    ok = (F.col("anchors") >= 4) & (F.col("features") >= 2) & (F.col("median_score") >= 0.78)
    return g.withColumn("status", F.when(ok, "proved").otherwise("unproved")).withColumn("confidence", F.when(ok, half_up(proof_confidence(F.col("anchors"), F.col("features")), 3)))


GATES = [("features", "features >= 100"), ("access", "access >= 20"), ("buildings", "buildings >= 10"), ("route", "route_m >= 1000"), ("rides", "ride_m >= 100"), ("chunks", "chunk_ratio between 0.9 and 1.35")]


def acceptance(summary: DataFrame) -> DataFrame:
    """A row per gate with whether it holds; null measures fail."""
    return summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(F.expr(e), F.lit(False)).alias("pass")) for n, e in GATES])).alias("g")).select("g.*")


def ride_gate(rides: DataFrame, least: float = 0.9) -> DataFrame:
    """(gate, pass, n): whether named rides (name, status, vertical_coverage, length) are modelled in height.

    No named ride may be flat, each must have ``least`` of its height, and all together too, by length. Without named rides every gate holds.
    """
    named = rides.where("name is not null and trim(name) != ''")
    cover = F.coalesce(F.col("vertical_coverage"), F.lit(0.0))
    g = named.agg(F.count("*").alias("n"), F.count_if((F.col("status") == "2d-only") | (cover <= 0)).alias("flat"), F.count_if(cover < least).alias("low"), F.count_if(cover > 0).alias("some"), (F.sum(cover * F.col("length")) / F.nullif(F.sum("length"), F.lit(0.0))).alias("all"))
    none = F.col("n") == 0
    gates = [("some-ride-has-height", none | (F.col("some") > 0), "some"), ("no-ride-is-flat", F.col("flat") == 0, "flat"), ("each-ride-is-covered", F.col("low") == 0, "low"), ("rides-are-covered", none | F.coalesce(F.col("all") >= least, F.lit(False)), "n")]
    return g.select(F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), ok.alias("pass"), F.col(c).cast("bigint").alias("n")) for name, ok, c in gates])).alias("g")).select("g.*")


def exact_3d() -> Column:
    """An aggregate over ``code``: none of those that rule an exact model out."""
    codes = ["BOUNDARY_UNVERIFIED", "RIDE_VERTICAL_GEOMETRY_ABSENT", "RIDE_VERTICAL_GEOMETRY_PARTIAL", "RIDE_BANKING_GEOMETRY_PARTIAL", "RIDE_PLAN_PROFILE_MISALIGNED", "BRIDGE_VERTICAL_GEOMETRY_PARTIAL", "TERRAIN_NOT_SURVEY_GRADE", "TERRAIN_FLAT_DATUM"]
    return F.count_if(F.col("code").isin(*codes)) == 0


def spawn_cell(cells: DataFrame, x: float, z: float) -> DataFrame:
    """The one cell of the best surface priority, then nearest to (x, z)."""
    d = F.pow(F.col("x") - x, 2) + F.pow(F.col("z") - z, 2)
    return cells.agg(F.min(F.struct("priority", d.alias("d"), "x", "z")).alias("m")).select("m.x", "m.z", "m.priority")


def stratified(points: Column, n: int) -> Column:
    """At most ``n`` evenly spaced entries, the ends among them."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.size(points) - 1) / float(n - 1) + 0.5).cast("int"))
    return F.when(F.size(points) <= n, points).otherwise(F.transform(at, lambda i: F.element_at(points, i + 1)))
