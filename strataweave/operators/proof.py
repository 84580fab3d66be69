"""Proof that a drawn scheme was built: anchors between a page and what is observed today, a ladder per page, a summary per application.

An anchor counts only if today's observation is later than the decision. Every match and page keeps a reason, so what failed can be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import clamp, half_up
from strataweave.operators.fusion import proof_confidence

# Classes of drawings that may certify places, that give context only, and states that are never proved.
SPATIAL, CONTEXT, EXCLUDED = ["site_plan", "landscape_plan", "ride_layout"], ["location_plan"], ["refused", "withdrawn", "demolished", "superseded"]
# Largest error of a match and of a page in metres; least anchors, features and median score.
MATCH_RMSE, PAGE_RMSE, LEAST_REGISTERED, LEAST_ANCHORS, LEAST_FEATURES, MEDIAN_SCORE = 1.0, 1.0, 3, 4, 2, 0.78
CONSENT = "approved|granted|permitted|consent"


def registration_anchors(matches: DataFrame, pages: DataFrame, features: DataFrame) -> DataFrame:
    """Matches (page_id, feature_id, candidate_id, rmse) with status, score and feature_kind; an anchor has status 'anchor'.

    ``pages`` (page_id, registered, page_rmse, decision_at), ``features`` (feature_id, feature_kind, observed_at). Of several anchors on one feature of a page the
    one of the smallest error stays, ties to the smaller candidate; the others are 'duplicate-feature'.
    """
    f = features.withColumn("_there", F.lit(True))
    d = matches.join(pages, "page_id").join(f, "feature_id", "left")
    reason = (
        F.when(~F.coalesce("registered", F.lit(False)), "registration-not-passed").when(F.col("decision_at").isNull(), "missing-planning-decision-date")
        .when(F.col("page_rmse").isNull() | (F.col("page_rmse") > PAGE_RMSE), "registration-page-rmse-above-proof-gate").when(F.col("_there").isNull(), "registration-reference-feature-missing")
        .when(F.col("observed_at").isNull(), "current-observation-missing-timestamp").when(F.col("observed_at") <= F.col("decision_at"), "observation-not-post-decision")
        .when(F.col("rmse").isNull() | (F.col("rmse") > MATCH_RMSE), "registration-match-rmse-above-proof-gate").otherwise("anchor")
    )
    d = d.withColumn("status", reason)
    anchor = F.col("status") == "anchor"
    first = Window.partitionBy("page_id", "feature_id", "status").orderBy("rmse", "candidate_id")
    d = d.withColumn("status", F.when(anchor & (F.row_number().over(first) > 1), "duplicate-feature").otherwise(F.col("status")))
    score = F.when(F.col("status") == "anchor", half_up(clamp(1 - F.col("rmse") / 4), 3))
    return d.select("page_id", "feature_id", "candidate_id", "feature_kind", "status", score.alias("score"))


def lifecycle_eligible(state: Column, reason: Column, statuses: Column) -> Column:
    """Whether a page's state may still be proved: proposed, current, or unknown by an ambiguous lineage under a consent."""
    s = F.lower(F.coalesce(state, F.lit("unknown")))
    consent = F.coalesce(F.exists(statuses, lambda v: F.lower(v).rlike(CONSENT)), F.lit(False))
    unclear = F.coalesce(F.lower(reason).contains("ambiguous-document-revision-lineage"), F.lit(False))
    return s.isin("proposed", "current") | ((s == "unknown") & unclear & consent)


def _enough(n: Column, features: Column, kinds: Column, median: Column) -> Column:
    independent = (features >= 3) | ((features >= 2) & (kinds >= 2) & (n >= 8))
    return (n >= LEAST_ANCHORS) & (features >= LEAST_FEATURES) & independent & (median >= MEDIAN_SCORE)


def certified_pages(pages: DataFrame, registered: DataFrame, corroborated: DataFrame) -> DataFrame:
    """(page_id, application, class, status, alone, anchors, features, median_score, confidence) of pages (page_id, application, class, state, reason, statuses, registered).

    ``registered`` are anchors of ``registration_anchors``, ``corroborated`` anchors of single candidates (page_id, feature_id, feature_kind, score). Three registered
    anchors on three features at the median prove a page ``alone``, which then counts them only; else both kinds together need four anchors, on three features or on two of two kinds with eight anchors.
    """
    cols = ["page_id", "feature_id", "feature_kind", "score"]
    own = registered.where("status = 'anchor'").select(*cols, F.lit(True).alias("_own"))
    a = own.unionByName(corroborated.select(*cols, F.lit(False).alias("_own")))
    mine = lambda c: F.when(F.col("_own"), F.col(c))
    g = a.groupBy("page_id").agg(
        F.count("*").alias("anchors"), F.count_distinct("feature_id").alias("features"), F.count_distinct("feature_kind").alias("_kinds"), F.median("score").alias("median_score"),
        F.count(mine("score")).alias("_n"), F.count_distinct(mine("feature_id")).alias("_f"),
    )
    m = own.groupBy("page_id").agg(F.median("score").alias("_m"))
    d = pages.join(g, "page_id", "left").join(m, "page_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    alone = (zero("_n") >= LEAST_REGISTERED) & (zero("_f") >= LEAST_REGISTERED) & (half_up(F.coalesce("_m", F.lit(0.0)), 3) >= MEDIAN_SCORE)
    proved = alone | _enough(zero("anchors"), zero("features"), zero("_kinds"), F.coalesce("median_score", F.lit(0.0)))
    spatial, context = F.coalesce(F.col("class").isin(*SPATIAL), F.lit(False)), F.coalesce(F.col("class").isin(*CONTEXT), F.lit(False))
    status = (
        F.when(F.lower("state").isin(*EXCLUDED), "page-explicitly-non-current").when(~F.coalesce("registered", F.lit(False)), "page-not-spatially-registered")
        .when(~spatial & ~context, "page-class-not-implementation-anchor").when(~lifecycle_eligible(F.col("state"), F.col("reason"), F.col("statuses")), "page-lifecycle-not-eligible-for-corroboration")
        .when(~proved, "insufficient-independent-current-anchors").when(spatial, "implemented-plan-certified").otherwise("implemented-context-certified")
    )
    d = d.withColumns({"status": status, "alone": alone, "median_score": F.when(alone, F.col("_m")).otherwise(F.col("median_score"))})
    d = d.withColumns({"anchors": F.when(F.col("alone"), zero("_n")).otherwise(zero("anchors")), "features": F.when(F.col("alone"), zero("_f")).otherwise(zero("features"))})
    bonus = 0.86 + F.greatest(F.lit(0.0), F.coalesce("median_score", F.lit(0.0)) - 0.78) * 0.45 + F.least(F.lit(0.06), zero("anchors") * 0.002)
    confidence = F.when(F.col("status").startswith("implemented"), half_up(F.least(F.lit(0.97), bonus), 3))
    return d.select("page_id", "application", "class", "status", "alone", "anchors", "features", "median_score", confidence.alias("confidence"))


def proved_applications(certified: DataFrame, registered: DataFrame, corroborated: DataFrame) -> DataFrame:
    """(application, pages, anchors, features, confidence) of applications with a page certified for places; features are distinct over all those pages."""
    good = certified.where("status = 'implemented-plan-certified'")
    a = registered.where("status = 'anchor'").select("page_id", "feature_id", F.lit(True).alias("_own")).unionByName(corroborated.select("page_id", "feature_id", F.lit(False).alias("_own")))
    d = a.join(good.select("page_id", "application", "alone"), "page_id").where("_own or not alone")
    g = d.groupBy("application").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("anchors"), F.count_distinct("feature_id").alias("features"))
    return g.withColumn("confidence", half_up(proof_confidence(F.col("anchors"), F.col("features")), 3))
