"""Smaller rules: compatibility gates, surfaces and materials, labels, entrances, mosaics, water, growth along lines, placement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage
from strataweave.functions.geometry import segment_distance
from strataweave.functions.scalars import clamp, half_up, text_relevance
from strataweave.operators.spatial import BOX, best_of, box_join, iou_pairs, match_boxes, planning_match_score

# ---- gates

SEMANTIC_KINDS = [
    (r"building-footprint-or-room", ["building", "structure"]), (r"landscape-area-or-path", ["path", "road", "water", "terrain_detail"]), (r"landscape-edge-or-route", ["path", "road", "barrier"]),
    (r"site-feature-or-building-footprint", ["building", "structure", "path", "road", "water", "terrain_detail"]), (r"site-edge-or-route", ["path", "road", "barrier"]),
]


def current_authority(has_authority: Column, state: Column) -> Column:
    """Only evidence of the current state that may set geometry passes; unknown fails."""
    return F.coalesce(has_authority & (state == "current"), F.lit(False))


def semantic_fits(semantic: Column, classification: Column, kind: Column) -> Column:
    """Whether a drawn thing can be a feature of this kind. Ride lines only come from ride layouts, and are nothing else."""
    layout = F.regexp_replace(F.lower(F.trim(classification)), r"[\s-]+", "_") == "ride_layout"
    line = semantic.rlike("ride-centerline-or-edge")
    out = F.lit(False)
    for pattern, kinds in reversed(SEMANTIC_KINDS):
        out = F.when(semantic.rlike(pattern), kind.isin(*kinds)).otherwise(out)
    out = F.when(semantic.rlike("ride-envelope-or-structure"), layout & (kind == "structure")).otherwise(out)
    return F.coalesce(F.when(kind == "ride_track", layout & line).when(line, False).otherwise(out), F.lit(False))


def material_role(material: Column, raw: Column, kind: Column) -> Column:
    roofing = F.lower(F.concat_ws(" ", material, raw)).rlike("roof|slate|tile")
    return F.when(roofing & (kind == "building"), "roof").when(kind == "barrier", "barrier").when(kind.isin("building", "structure"), "wall").otherwise("surface")


# Class, confidence, what a title says of it. In order.
STRONG_CLASS = [
    ("ride_layout", 0.99, r"\b(?:roller\s+coaster|coaster|ride)\s+(?:track\s+)?layout\b|\b(?:track|ride)\s+(?:centre|center)\s*line\b|\b(?:roller\s+coaster|coaster|ride)\s+track\s+plan\b|\btrack\s+layout\s+(?:plan|drawing)\b|\brunning\s+rail(?:s)?\b"),
    ("section", 0.96, r"\b(?:roller\s+coaster|coaster|ride|track)\s+(?:longitudinal\s+|cross\s+)?section(?:s)?\b|\b(?:longitudinal|track)\s+section(?:s)?\b|\bsection\s+[a-z0-9]+[-–—][a-z0-9]+\b"),
    ("elevation", 0.95, r"\b(?:roller\s+coaster|coaster|ride|track)\s+elevation(?:s)?\b|\b(?:north|south|east|west|front|rear|side)\s+elevation(?:s)?\b|\belevation\s+drawing(?:s)?\b"),
    ("landscape_plan", 0.94, r"\b(?:hard|soft)\s+landscape\s+(?:plan|layout)\b|\blandscape\s+(?:site\s+)?plan\b|\bplanting\s+plan\b"),
    ("site_plan", 0.93, r"\bproposed\s+site\s+plan\b|\bgeneral\s+arrangement\s+(?:plan|drawing)\b|\bmaster\s*plan\b"),
]


def reclassify(known: Column, title: Column, body: Column) -> Column:
    """struct(classification, confidence): a weak class gives way to what the title says; of the body only a ride layout counts, .05 lower."""
    t, b = (F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")) for c in (title, body))
    weak = known.isNull() | known.isin("unknown", "supporting")
    row = lambda c, p: F.struct(F.lit(c).alias("classification") if isinstance(c, str) else c.alias("classification"), F.lit(p).alias("confidence"))
    out = F.when(b.rlike(STRONG_CLASS[0][2]), row("ride_layout", 0.94)).otherwise(row(known, 0.0))
    for name, conf, pattern in reversed(STRONG_CLASS):
        out = F.when(t.rlike(pattern), row(name, conf)).otherwise(out)
    return F.when(weak, out).otherwise(row(known, 1.0))


def legend_code(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.rlike(r"^[A-Z]{1,3}\s*[-_.]?\s*\d{1,3}[A-Z]?$"), F.regexp_replace(t, "[^A-Z0-9]", ""))


def surface_style(planning: Column, tag: Column, image: Column, image_ok: Column) -> Column:
    """struct(material, source): the planning palette, then tags, then accepted imagery, then a visible unknown."""
    row = lambda m, s: F.struct(m.alias("material"), F.lit(s).alias("source"))
    return F.when(planning.isNotNull(), row(planning, "planning")).when(tag.isNotNull(), row(tag, "tag")).when(image.isNotNull() & F.coalesce(image_ok, F.lit(False)), row(image, "imagery")).otherwise(row(F.lit("unknown"), "fallback"))


def wrap_sign(text: Column, width: int = 20, rows: int = 4) -> Column:
    """Lines of at most ``width`` characters, words whole where they fit; what is left over ends in an ellipsis."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"(.{{1,{width}}})"), F.lit(1))))
    last = lambda a: F.element_at(a, -1)
    lines = F.aggregate(cut, F.array().cast("array<string>"), lambda a, w: F.when((F.size(a) > 0) & (F.length(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))) + F.length(w) < width), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(a, F.lit(-1)), w)))).otherwise(F.concat(a, F.array(w))))
    full = F.concat(F.slice(lines, 1, rows - 1), F.array(F.concat(F.substring(last(F.slice(lines, 1, rows)), 1, width - 1), F.lit("…"))))
    return F.when(F.size(lines) > rows, full).otherwise(lines)


# ---- joins

def corroborate(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float = 32.0, gap: float = 0.12) -> DataFrame:
    """The match at .78; a wider gap than .08 is not granted."""
    return match_boxes(left, right, left_id, right_id, size, 0.78, min(gap, 0.08))


def edit_match(edits: DataFrame, features: DataFrame, tolerance: float = 8.0, minimum: float = 0.64, delete_minimum: float = 0.78) -> DataFrame:
    """The target of edits (edit_id, operation, kind, name, box, px/pz arrays of points) among features (id, kind, name, rank below 300)."""
    pairs = box_join(edits, features.where("rank < 300"), max(16.0, 2 * tolerance), tolerance, "e", "f").where(F.col("e.kind") == F.col("f.kind"))

    def mean_nearest(a: Column, b: Column) -> Column:
        d = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: F.hypot(p["x"] - q["x"], p["z"] - q["z"]))))
        return F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(d)

    shape = (mean_nearest(F.col("e.points"), F.col("f.points")) + mean_nearest(F.col("f.points"), F.col("e.points"))) / 2
    same = F.coalesce(F.lower(F.trim("e.name")) == F.lower(F.trim("f.name")), F.lit(False))
    score = planning_match_score({k: F.col(f"e.{k}") for k in BOX}, {k: F.col(f"f.{k}") for k in BOX}, shape, same, tolerance)
    s = pairs.select(F.col("e.edit_id").alias("edit_id"), F.col("e.operation").alias("operation"), F.col("f.id").alias("target"), score.alias("score"))
    s = s.where(F.col("score") >= F.when(F.col("operation") == "delete", delete_minimum).otherwise(minimum))
    return best_of(s, ["edit_id"], "target", "score", minimum, 0.06)


def suppress_water(mapped: DataFrame, official: DataFrame, least: float = 0.62) -> DataFrame:
    """Mapped water that official water covers (overlap over union) with no other name."""
    alike = F.col("l.name").isNull() | F.col("r.name").isNull() | (F.lower("l.name") == F.lower("r.name"))
    p = iou_pairs(mapped.select("id", "name", *BOX), official.select("name", *BOX), least, by=["name"], also=alike)
    return mapped.join(p.select(F.col("l.id").alias("id")).distinct(), "id", "left_semi")


def water_level(samples: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Level of each water body: its tag, or the median of ``least`` shore samples or more (the published rule: four) if these spread by 4 m at most, else unknown. A shore counts for still water only."""
    g = samples.groupBy(key).agg(F.max("tag_level").alias("t"), F.median("shore").alias("m"), (F.percentile("shore", 0.9) - F.percentile("shore", 0.1)).alias("spread"), F.count("shore").alias("n"))
    level = (F.col("spread") <= 4) & (F.col("n") >= least)
    confidence = F.when(F.col("t").isNull() & level, F.greatest(F.lit(0.55), F.least(F.lit(0.92), 0.92 - F.col("spread") * 0.08)))
    return g.select(key, F.coalesce("t", F.when(level, F.col("m"))).alias("level"), F.when(F.col("t").isNotNull(), "tag").when(level, "shoreline").otherwise("unknown").alias("source"), confidence.alias("shore_confidence"))


# Rank of a water source by the prefix of its id, then by provider; providers whose depths are only reported.
WATER_RANKS = [("override:", 500), ("planning:", 400), ("public:", 300)]
PROVIDER_RANKS = [("OpenStreetMap", 100), ("Overture Maps Foundation", 80)]


def water_rank(id_: Column, provider: Column, rank: Column, verified: Column) -> Column:
    """Authority of a water source: its own rank, else by id, provider, and whether its plan is verified."""
    c = F.when(rank.isNotNull(), rank)
    for prefix, n in WATER_RANKS:
        c = c.when(id_.startswith(prefix), n)
    for name, n in PROVIDER_RANKS:
        c = c.when(provider == name, n)
    return c.when(verified, 300).otherwise(150).cast("int")


def water_depth(direct: Column, maximum: Column, rank: Column, provider: Column) -> Column:
    """struct(depth, max_depth, source, confidence, status): a depth is trusted from ranks above 100 outside the open maps, and within 200 m (mean) or 500 m (greatest)."""
    trusted = (rank > 100) & ~F.coalesce(provider.isin(*[n for n, _ in PROVIDER_RANKS]), F.lit(False))
    row = lambda d, m, s, c, st: F.struct(d.cast("double").alias("depth"), m.cast("double").alias("max_depth"), F.lit(s).cast("string").alias("source"), F.lit(c).cast("double").alias("confidence"), F.lit(st).alias("status"))
    no = F.lit(None)
    return (
        F.when(trusted & (direct > 0) & (direct <= 200), row(direct, no, "verified-public-depth", 0.9, "measured"))
        .when(trusted & (maximum > 0) & (maximum <= 500), row(no, maximum, "verified-public-max-depth", 0.82, "measured-max-depth"))
        .when(direct.isNotNull() | maximum.isNotNull(), row(no, no, "untrusted-reported-depth", 0.35, "reported-not-bathymetry"))
        .otherwise(row(no, no, None, None, "unknown"))
    )


def nearest_label(things: DataFrame, labels: DataFrame, key: str, reach: float) -> DataFrame:
    """Label of each thing (key, page, box) by labels (page, x, z, label) within ``reach``: one, or 'ambiguous' where several differ."""
    l = labels.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    p = box_join(things, l, max(16.0, 2 * reach), reach, "t", "l").where(F.col("t.page") == F.col("l.page"))
    g = p.groupBy(F.col(f"t.{key}").alias(key)).agg(F.count_distinct("l.label").alias("n"), F.min("l.label").alias("label"))
    return things.select(key).join(g, key, "left").select(key, F.when(F.col("n") == 1, F.col("label")).alias("label"), F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "labelled").otherwise("ambiguous").alias("status"))


def entrances(doors: DataFrame, walls: DataFrame, reach: float = 8.0) -> DataFrame:
    """(building, entrance): each door goes to its nearest wall within reach, each building keeps its best-ranked door, then the nearest, then the first id."""
    d = doors.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    w = walls.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_z": F.least("az", "bz"), "max_z": F.greatest("az", "bz")})
    p = box_join(d, w, 16.0, reach, "d", "w").select(F.col("d.id").alias("entrance"), F.col("d.rank").alias("rank"), F.col("w.building").alias("building"), segment_distance(F.col("d.x"), F.col("d.z"), F.col("w.ax"), F.col("w.az"), F.col("w.bx"), F.col("w.bz")).alias("dist")).where(F.col("dist") <= reach)
    near = p.groupBy("entrance", "rank").agg(F.min(F.struct("dist", "building")).alias("m")).select("entrance", "rank", "m.*")
    return near.groupBy("building").agg(F.min(F.struct((-F.col("rank")).alias("r"), "dist", "entrance")).alias("m")).select("building", F.col("m.entrance").alias("entrance"))


def unique_template(things: DataFrame, templates: DataFrame, code: str) -> DataFrame:
    """The template of a thing's code; several are ambiguous, and none is chosen."""
    g = templates.groupBy(code).agg(F.count("*").alias("n"), F.min("template_id").alias("t"))
    j = things.join(g, code, "left")
    return j.withColumn("template_id", F.when(F.col("n") == 1, F.col("t"))).withColumn("status", F.when(F.col("n").isNull(), "no-template").when(F.col("n") == 1, "matched").otherwise("ambiguous")).drop("n", "t")


def relevant_applications(anchors: DataFrame, applications: DataFrame, least: float = 0.48, most: int = 20_000) -> DataFrame:
    """(anchor_id, application_id, score) of anchors (anchor_id, name) in application texts: the whole name, also inside longer words, or enough of its words.

    A name inside a longer word shares no word with the text, so no equi-join meets all pairs. Anchors are the named things of one map: up to ``most`` of
    them (checked) travel to all texts, and an expression finds what each text names.
    """
    names = anchors.where(F.col("name").isNotNull()).select("anchor_id", "name")
    if names.limit(most + 1).count() > most:
        raise ValueError("the anchors of one map are a bounded list")
    pairs = applications.select("application_id", "text").join(F.broadcast(names), text_relevance(F.col("name"), F.col("text")) >= least)
    return pairs.select("anchor_id", "application_id", text_relevance(F.col("name"), F.col("text")).alias("score"))


def application_ranking(matches: DataFrame, applications: DataFrame, order: str) -> DataFrame:
    """(application_id, score, anchors, place): the best weighted match (application_id, score, weight) and .02 for each further one, .12 at most; ranked by score, then ``order``."""
    g = matches.groupBy("application_id").agg(F.max(half_up(F.col("score") * F.col("weight"), 3)).alias("best"), F.count("*").alias("anchors"))
    j = applications.join(g, "application_id", "left").withColumns({"anchors": F.coalesce("anchors", F.lit(0).cast("bigint")), "best": F.coalesce("best", F.lit(0.0))})
    score = half_up(F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.12), F.greatest(F.lit(0), F.col("anchors") - 1) * 0.02)), 3)
    return j.withColumn("score", score).select("application_id", "score", "anchors", F.col(order))


def mosaic(layers: DataFrame, key: list[str]) -> DataFrame:
    """The value of the finest layer that has one: (key, value, layer) from (key, layer, resolution, value)."""
    return layers.where("value is not null").groupBy(*key).agg(F.min(F.struct("resolution", "layer", "value")).alias("m")).select(*key, "m.value", "m.layer")


def alignment(points: DataFrame, segments: DataFrame, key: str, reach: float = 50.0) -> DataFrame:
    """Mean and largest distance of vertices to the line of the same key: 'aligned' up to 1 m, 'close' to 3 m, else 'review-required'; beyond ``reach`` counts as reach."""
    p = points.withColumns({"_i": F.monotonically_increasing_id(), "min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    s = segments.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_z": F.least("az", "bz"), "max_z": F.greatest("az", "bz")})
    j = box_join(p, s, 2 * reach, reach, "p", "s").where(F.col(f"p.{key}") == F.col(f"s.{key}"))
    d = j.groupBy(F.col(f"p.{key}").alias(key), F.col("p.x").alias("x"), F.col("p.z").alias("z")).agg(F.min(segment_distance(F.col("p.x"), F.col("p.z"), F.col("s.ax"), F.col("s.az"), F.col("s.bx"), F.col("s.bz"))).alias("d"))
    g = points.join(d, [key, "x", "z"], "left").groupBy(key).agg(F.avg(F.least(F.coalesce("d", F.lit(reach)), F.lit(reach))).alias("mean"), F.max(F.least(F.coalesce("d", F.lit(reach)), F.lit(reach))).alias("largest"))
    return g.withColumn("status", F.when(F.col("largest") <= 1, "aligned").when(F.col("largest") <= 3, "close").otherwise("review-required"))


# ---- growth, revisions, placement

def grow(strokes: DataFrame, tolerance: float = 0.75, max_rounds: int = 200) -> DataFrame:
    """(id, round) reached from seed strokes (id, style, seed, ax, az, bx, bz) over strokes of one style whose ends meet within tolerance, round by round."""
    from strataweave.plans.graph import connected_components

    ends = strokes.select("id", "style", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("az").alias("z")), F.struct(F.col("bx").alias("x"), F.col("bz").alias("z")))).alias("p")).select("id", "style", "p.x", "p.z")
    e = ends.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    met = box_join(e, e, max(1.0, 2 * tolerance), tolerance).where((F.col("l.style") == F.col("r.style")) & (F.col("l.id") < F.col("r.id")) & (F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.z") - F.col("r.z")) <= tolerance))
    comp = connected_components(met.select(F.col("l.id").alias("src"), F.col("r.id").alias("dst")), max_rounds=max_rounds)
    own = strokes.join(comp, strokes["id"] == comp["node"], "left").select("id", "seed", F.coalesce("component", "id").alias("component"))
    return own.join(own.where("seed").select("component").distinct(), "component", "left_semi").select("id", "seed")


def page_decision(pages: DataFrame, key: str) -> DataFrame:
    """Decision of a page from its evidence: excluded, current, ambiguous, proposed, unknown, in this order."""
    g = pages.groupBy(key).agg(F.bool_or(F.col("state").isin("demolished", "refused", "withdrawn", "superseded")).alias("x"), F.bool_or(F.col("state") == "current").alias("c"), F.bool_or(F.col("state") == "proposed").alias("p"))
    return g.select(key, F.when(F.col("x"), "excluded").when(F.col("c") & F.col("p"), "ambiguous").when(F.col("c"), "current").when(F.col("p"), "proposed").otherwise("unknown").alias("decision"))


def agreeing_latest(rows: DataFrame, key: str, rev: str, value: str) -> DataFrame:
    """The value at the highest revision number of a key, if all rows at it agree."""
    top = rows.groupBy(key).agg(F.max(rev).alias("top"))
    g = rows.join(top, key).where(F.col(rev) == F.col("top")).groupBy(key).agg(F.count_distinct(value).alias("n"), F.min(value).alias("v"))
    return g.select(key, F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 1, "latest").otherwise("conflict").alias("status"))


def schedule_values(records: DataFrame, key: str, value: str, shown: str) -> DataFrame:
    """(key, n, agreed, conflict) of schedule records: peers of one code must agree on ``value``, else nothing is taken; ``shown`` is what is taken."""
    g = records.groupBy(key).agg(F.count_distinct(value).alias("d"), F.count("*").alias("n"), F.max(shown).alias("top"))
    return g.select(key, "n", F.when(F.col("d") <= 1, F.col("top")).alias("agreed"), (F.col("d") > 1).alias("conflict"))


def schedule_join(objects: DataFrame, schedule: DataFrame, key: str, family: str | None = None) -> DataFrame:
    """``objects`` with what the schedule says of their code: by the exact code, and the object's ``family`` where both sides have one.

    A code that the schedule has not, or has for another family only, leaves n 0 and nothing agreed.
    """
    s = schedule.withColumnRenamed(family, "_family") if family else schedule
    j = objects.join(s, key, "left")
    if family:
        fits = F.col("_family").isNull() | F.col(family).isNull() | (F.col("_family") == F.col(family))
        j = j.withColumns({c: F.when(fits, F.col(c)) for c in schedule.columns if c not in (key, family)}).drop("_family")
    return j.withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "conflict": F.coalesce("conflict", F.lit(False))})


def shadowed(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, a, b, confidence, name) that stay when, by confidence, each takes its place and overlaps nothing taken. A page is one group."""

    def run(k, t):
        taken, out = [], []
        for r in sorted(t.to_pylist(), key=lambda r: (-r["confidence"], r["a"], r["b"], r["name"])):
            if all(r["b"] <= a or r["a"] >= b for a, b in taken):
                taken.append((r["a"], r["b"]))
                out.append(r)
        return pa.Table.from_pylist(out, schema=t.schema)

    return spans.groupBy(key).applyInArrow(run, spans.schema)


def first_seen(pages: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of repeated pages the first by ``order``, ties by the least other columns, in theirs; an aggregate, so repeats collapse before the shuffle."""
    rest = [c for c in pages.columns if c not in key and c != order]
    tie = [F.col(c).cast("string") if "map<" in pages.schema[c].dataType.simpleString() else F.col(c) for c in rest]  # maps have no order
    first = F.when(F.col(order).isNotNull(), F.struct(order, *tie))
    return pages.groupBy(*key).agg(F.min_by(F.struct(*rest), first).alias("_r"), F.min(order).alias(order)).select(*key, order, "_r.*")


def merge_bundles(pages: DataFrame, documents: DataFrame, fallback: DataFrame, counts: list[str]) -> DataFrame:
    """One row: distinct documents, pages, sums of ``counts`` over the pages, and pages left to a raster reader, of several extraction bundles.

    A page (content_hash, page) counts as the first bundle has it (``bundle``, then ``seq``, null last in both); documents without a hash are not counted.
    """
    p = pages.withColumn("_order", F.struct(F.col("bundle").isNull(), "bundle", F.col("seq").isNull(), "seq")).drop("bundle", "seq")
    p = first_seen(p, ["content_hash", "page"], "_order").agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counts])
    d = documents.agg(F.count_distinct("content_hash").alias("documents"))
    r = fallback.select(F.coalesce("content_hash", F.lit("")).alias("h"), F.coalesce("page", F.lit(0)).alias("p")).distinct().agg(F.count("*").alias("fallback_pages"))
    return p.join(d, how="cross").join(r, how="cross")  # one row each



def tombstones(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what went and what came, between two states."""
    b, a = before.select(key).distinct().withColumn("b", F.lit(1)), after.select(key).distinct().withColumn("a", F.lit(1))
    return b.join(a, key, "full").where("a is null or b is null").select(key, F.when(F.col("a").isNull(), "removed").otherwise("added").alias("change"))


def sign_cells(candidates: DataFrame, owner: str) -> DataFrame:
    """A cell for each sign (owner, x, z, score; low is good) that has a free one, no cell twice: each round every sign asks for its best free cell, and the best asker gets it.

    Every round places a sign at least, so the rounds end by themselves; signs that are left have no cell that another didn't take.
    """
    left, done = cut_lineage(candidates.select(owner, "x", "z", "score").dropna()), None
    while True:
        want = left.groupBy(owner).agg(F.min(F.struct("score", "x", "z")).alias("m")).select(owner, "m.*")
        won = cut_lineage(want.groupBy("x", "z").agg(F.min(F.struct("score", owner)).alias("m")).select(f"m.{owner}", "x", "z", "m.score"))
        if won.isEmpty():
            return done if done is not None else left
        done = won if done is None else cut_lineage(done.unionByName(won))
        left = cut_lineage(left.join(won.select(owner), owner, "left_anti").join(won.select("x", "z"), ["x", "z"], "left_anti"))


def cell_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Shared cells over the smaller set, for pairs that share any."""
    na, nb = a.groupBy(a_id).agg(F.count("*").alias("na")), b.groupBy(b_id).agg(F.count("*").alias("nb"))
    n = a.join(b, ["x", "z"]).groupBy(a_id, b_id).agg(F.count("*").alias("n"))
    return n.join(na, a_id).join(nb, b_id).select(a_id, b_id, (F.col("n") / F.least("na", "nb")).alias("overlap"))


def cross_section_confidence(coverage: Column, resolution_m: Column, edge: Column, spread: Column, provenance: Column) -> Column:
    """Of a width measured on imagery: .08 + .25 coverage + .2 resolution + .22 edge + .15 consistency + .1 provenance."""
    res = clamp(1 - (resolution_m - 0.1) / 0.9)
    return half_up(clamp(0.08 + 0.25 * clamp(coverage) + 0.2 * res + 0.22 * clamp(edge / 30) + 0.15 * clamp(1 - spread) + 0.1 * F.when(provenance, 1.0).otherwise(0.0)), 3)


def land_cover(samples: DataFrame, key: str) -> DataFrame:
    """Share of each class among a key's samples."""
    n = samples.groupBy(key, "class").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def tree_voxels(trees: DataFrame, template: list[tuple[int, int, int, str]]) -> DataFrame:
    """Voxels of trees (id, x, y, z, height) from a template of whole cells (dx, dy, dz, block): rows of the template are resampled to the height, wood wins over leaves."""
    high = max(t[1] for t in template) + 1
    rows = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(k).alias("block")) for a, b, c, k in template])
    d = trees.withColumn("_y", F.explode(F.sequence(F.lit(1), F.col("height").cast("int"))))
    src = F.floor(1 + (F.col("_y") - 1) * (high - 1) / F.greatest(F.col("height") - 1, F.lit(1)) + 0.5) - 1
    d = d.withColumn("_src", src).withColumn("_t", F.explode(F.filter(rows, lambda t: t["dy"] == F.col("_src"))))
    cells = d.select("id", (F.col("x") + F.col("_t.dx")).alias("x"), (F.col("y") + F.col("_y")).alias("y"), (F.col("z") + F.col("_t.dz")).alias("z"), F.col("_t.block").alias("block"))
    return cells.groupBy("x", "y", "z").agg(F.max(F.struct((~F.col("block").contains("leaves")).alias("wood"), "block", "id")).alias("m")).select("x", "y", "z", "m.block", "m.id")


def support_levels(track: np.ndarray, ground: np.ndarray, spacing: float, least: float) -> np.ndarray:
    """Indices of track points that get a support: due every ``spacing`` from half of it, at least ``least`` above ground, not steeper than 1.5."""
    step = np.r_[0, np.sqrt((np.diff(track, axis=0) ** 2).sum(axis=1))]
    due = np.floor((np.cumsum(step) + 1e-6 - spacing / 2) / spacing)
    new = due > np.r_[-1, np.maximum.accumulate(np.maximum(due, -1))[:-1]]
    run = np.r_[1, np.hypot(*np.diff(track[:, [0, 2]], axis=0).T)]
    rise = np.r_[0, np.abs(np.diff(track[:, 1]))]
    ok = (due >= 0) & new & (run >= 0.5) & (rise <= 1.5 * np.maximum(run, 1e-9)) & (track[:, 1] - ground >= least)
    return np.flatnonzero(ok)
