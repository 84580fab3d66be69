"""Change sets: what kind of thing a drawn candidate is, which feature it means, and what is done to the map.

A change set is compiled in three set-based steps: an ordered ladder gives each candidate a kind, a spatial match of equal kinds gives it a target, and a second ladder
decides. Every candidate comes out with an action and a reason; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.details import semantic_fits
from strataweave.operators.spatial import match_boxes

# Kinds whose geometry a change set may set, the kind that only paints, kinds that are never changed, and the gates.
TOPOLOGY = ["building", "structure", "path", "road", "ride_track", "ride_support", "barrier", "water", "vegetation"]
PAINT = "surface"
TERRAIN = ["terrain", "terrain_detail", "landform", "ground"]
ADD_CONFIDENCE, MATCH_SCORE, MATCH_GAP = 0.82, 0.7, 0.08

# Kind, confidence, reason, words of the label. In order, after the rules on semantics.
LABEL_KINDS = [
    ("barrier", 0.94, "barrier-label", r"\b(fence|fencing|wall|barrier|guardrail|balustrade|gate)\b", False),
    ("water", 0.94, "water-label", r"\b(lake|pond|pool|water|watercourse|stream|basin)\b", False),
    ("road", 0.93, "road-label", r"\b(service road|access road|carriageway|roadway|road)\b", False),
    ("path", 0.94, "path-label", r"\b(path|footpath|footway|walkway|pedestrian|queue line|queue path)\b", False),
    ("structure", 0.88, "structure-label", r"\b(gantry|platform|canopy|bridge structure|retaining structure)\b", False),
    ("vegetation", 0.86, "vegetation-area-label", r"\b(tree|trees|planting|hedge|shrub|woodland)\b", True),
]


def _word(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def infer_kind(explicit: Column, semantic: Column, classification: Column, text: Column, shape: Column, material: Column, certified_kind: Column) -> Column:
    """struct(kind, confidence, reason, match_only, immutable) of a candidate, the first rule that holds.

    ``shape`` is 'area', 'line' or 'point'; ``certified_kind`` the kind of a feature that the candidate was tied to by evidence after the decision.
    """
    e, s, c, t = (_word(x) for x in (explicit, semantic, classification, text))
    kind_of = F.regexp_replace(c, r"[\s-]+", "_")
    both = F.concat(s, F.lit(" "), t)
    area, line, layout = shape == "area", shape == "line", kind_of == "ride_layout"
    null = F.lit(None).cast("string")

    def row(kind, confidence, reason, match_only=False, immutable=False):
        value = kind if isinstance(kind, Column) else null if kind is None else F.lit(kind)
        conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(value.alias("kind"), conf.alias("confidence"), why.alias("reason"), F.lit(match_only).alias("match_only"), F.lit(immutable).alias("immutable"))

    # Confidences and reasons, and the words that the rules on semantics look for.
    out = F.when(e.isin(*TERRAIN), row(None, 1, "terrain-geometry-immutable", immutable=True))
    out = out.when(e == PAINT, row(PAINT, 0.99, "explicit-surface-paint"))
    out = out.when(e.isin(*TOPOLOGY) & (s != "") & ~semantic_fits(s, c, e), row(None, 1, "explicit-kind-incompatible-with-planning-semantic"))
    out = out.when(e.isin(*TOPOLOGY), row(e, 0.99, "explicit-feature-kind"))
    out = out.when(certified_kind.isNotNull(), row(certified_kind, 0.96, "implementation-corroborated-existing-feature-kind"))
    out = out.when(layout & both.rlike("ride[-_ ]?support|support[-_ ]?structure|column|support pier"), row("ride_support", 0.94, "ride-support-label"))
    out = out.when(layout & (line | both.rlike("ride[-_ ]?centerline|ride[-_ ]?track|track[-_ ]?layout")), row("ride_track", 0.98, "ride-layout-centerline"))
    out = out.when(s.rlike("demolition[-_ ]?footprint"), row("building", 0.94, "demolition-building-footprint"))
    out = out.when(both.rlike("building[-_ ]?footprint|building[-_ ]?outline|building footprint|floor[-_ ]?plan") | ((kind_of == "floor_plan") & area), row("building", 0.92, "building-plan-geometry"))
    out = out.when(s.rlike("roof[-_ ]?plane|roof[-_ ]?footprint") | (kind_of == "roof_plan"), row("building", 0.76, "roof-plan-match-only", match_only=True))
    for kind, confidence, reason, words, needs_area in LABEL_KINDS:
        out = out.when(t.rlike(words) & (area if needs_area else F.lit(True)), row(kind, confidence, reason))
    paint = area & (material.isNotNull() | (kind_of == "landscape_plan")) & ~s.rlike("building|roof")
    known = material.isNotNull()
    out = out.when(paint, row(PAINT, F.when(known, 0.93).otherwise(0.72), F.when(known, "material-defined-surface-area").otherwise("landscape-area-needs-material")))
    return out.otherwise(row(None, 0.4, "semantic-kind-unresolved"))


def decide_change(inference: Column, operation: Column, has_geometry: Column, current: Column, demolished: Column, shape: Column, material: Column, match: Column, same_geometry: Column) -> Column:
    """struct(action, reason) of a candidate, the first gate that holds; ``match`` is the status of its spatial match: accepted, ambiguous, or anything else for none."""
    op = _word(operation)
    known, demolition = F.coalesce(current, F.lit(False)), F.coalesce(demolished, F.lit(False))
    kind, reason = inference["kind"], inference["reason"]
    found, unclear = match == "accepted", match == "ambiguous"
    removal = demolition | (op == "delete")
    row = lambda a, r: F.struct(F.lit(a).alias("action"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    # Actions and reasons. In order.
    return (
        F.when(inference["immutable"], row("review", "terrain-geometry-immutable"))
        .when(~F.coalesce(has_geometry, F.lit(False)), row("review", "missing-georegistered-geometry"))
        .when((op == "delete") & ~known & ~demolition, row("review", "delete-not-current-authority"))
        .when(~known & ~demolition, row("ignored", "planning-not-current-world-authority"))
        .when(removal & (kind.isNull() | (kind == PAINT)), row("review", "demolition-target-kind-unresolved"))
        .when(removal & ~found, row("review", F.concat(F.lit("delete-"), match)))
        .when(removal, row("delete", F.when(demolition, "confirmed-demolition").otherwise("explicit-current-delete")))
        .when((kind == PAINT) & (shape != "area"), row("review", "surface-paint-requires-area-geometry"))
        .when((kind == PAINT) & material.isNull(), row("review", "surface-paint-material-unresolved"))
        .when(kind == PAINT, row("paint", "planning-surface-paint-only"))
        .when(kind.isNull() | ~kind.isin(*TOPOLOGY), row("review", reason))
        .when(found & (op == "add"), row("review", "explicit-add-conflicts-with-existing-feature"))
        .when(found & F.coalesce(same_geometry, F.lit(False)), row("retain", "planning-corroborates-existing-geometry"))
        .when(found, row("replace", F.when(op == "replace", "explicit-current-replace").otherwise("automatic-current-planning-replace")))
        .when(unclear, row("review", "ambiguous-existing-feature-match"))
        .when(inference["match_only"], row("review", "match-only-evidence-has-no-existing-target"))
        .when(inference["confidence"] < ADD_CONFIDENCE, row("review", "new-feature-semantic-confidence-below-gate"))
        .otherwise(row("add", F.when(op == "add", "explicit-current-add").otherwise("automatic-current-planning-gap-fill")))
    )


def compile_changes(candidates: DataFrame, features: DataFrame, size: float = 16.0, same_within: float = 0.5) -> DataFrame:
    """(candidate_id, kind, action, reason, target, score) of each candidate.

    Candidates: candidate_id, kind, semantic, classification, text, shape, material, operation, current, demolished, certified (a feature's id or null), family and
    a box (null without geometry). Features: id, kind, family and a box. A certified target that is there is taken without a search; else the best feature of the
    same kind is, by the change-set weights. Geometry is the same if all sides of the boxes lie within ``same_within``.
    """
    box = ("min_x", "min_z", "max_x", "max_z")
    sure = features.select(F.col("id").alias("certified"), F.col("kind").alias("certified_kind"))
    c = candidates.join(sure, "certified", "left")
    c = c.withColumn("inference", infer_kind(F.col("kind"), F.col("semantic"), F.col("classification"), F.col("text"), F.col("shape"), F.col("material"), F.col("certified_kind")))
    asked = c.where(F.col("inference.kind").isin(*TOPOLOGY)).select("candidate_id", "family", F.col("inference.kind").alias("want"), *box)
    near = match_boxes(asked, features.select("id", "family", F.col("kind").alias("have"), *box), "candidate_id", "id", size, MATCH_SCORE, MATCH_GAP, compatible=F.col("l.want") == F.col("r.have"), weights=(0.46, 0.29, 0.17, 0.08), other_family=0.5)
    near = near.select("candidate_id", F.col("id").alias("best"), F.col("score").alias("best_score"), F.col("status").alias("found"))
    j = c.join(near, "candidate_id", "left")
    by_evidence = F.col("certified_kind").isNotNull() & (F.col("inference.reason") == "implementation-corroborated-existing-feature-kind")
    j = j.withColumns({"target": F.when(by_evidence, F.col("certified")).when(F.col("found") == "accepted", F.col("best")), "match": F.when(by_evidence, "accepted").otherwise(F.coalesce("found", F.lit("no-compatible-candidate"))), "score": F.when(by_evidence, 1.0).otherwise(F.col("best_score"))})
    there = features.select(F.col("id").alias("target"), *[F.col(b).alias(f"t_{b}") for b in box])
    j = j.join(there, "target", "left")
    same = F.lit(True)
    for b in box:
        same = same & (F.abs(F.col(b) - F.col(f"t_{b}")) <= same_within)
    has = F.col("min_x").isNotNull() & F.col("min_z").isNotNull() & F.col("max_x").isNotNull() & F.col("max_z").isNotNull()
    d = decide_change(F.col("inference"), F.col("operation"), has, F.col("current"), F.col("demolished"), F.col("shape"), F.col("material"), F.col("match"), same)
    done = j.select("candidate_id", F.col("inference.kind").alias("kind"), d.alias("d"), "target", "score")
    aimed = F.col("d.action").isin("delete", "replace", "retain")
    return done.select("candidate_id", "kind", "d.action", "d.reason", F.when(aimed, F.col("target")).alias("target"), F.when(aimed, F.col("score")).alias("score"))
