"""Evidence: candidates per entity and attribute are scored, ranked and resolved; losers and gaps are kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.scalars import clamp, half_up, recency_score, resolution_score, temporal_score

WEIGHTS = {"authority": 0.34, "directness": 0.24, "confidence": 0.15, "recency": 0.10, "resolution": 0.10, "temporal": 0.07}
ACCURACY_WEIGHTS = {"boundary": 0.18, "planimetry": 0.24, "rides": 0.22, "structures": 0.16, "terrain": 0.14, "freshness": 0.06}
GAP_BASE = {"geometry": 100, "verticalProfile": 98, "height": 92, "roof": 86, "width": 84, "material": 72, "groundElevation": 70}
LOW_CONFIDENCE, CONFLICT_GAP = 0.72, 0.12


def quality_terms(rank: Column, directness: Column, confidence: Column, age_days: Column, resolution_m: Column, state: Column, state_confidence: Column) -> dict[str, Column]:
    return {"authority": clamp(rank / 400), "directness": clamp(directness), "confidence": clamp(confidence), "recency": clamp(recency_score(age_days)), "resolution": resolution_score(resolution_m), "temporal": temporal_score(state, state_confidence)}


def evidence_score(terms: dict[str, Column]) -> Column:
    total = None
    for k, w in WEIGHTS.items():
        total = terms[k] * w if total is None else total + terms[k] * w
    return half_up(total, 3)


def resolve(candidates: DataFrame, entity: str = "entity", attribute: str = "attribute", score: str = "score", rank: str = "authority_rank", value: str = "value", tie: str = "ref", keep: int = 4, tolerance: Column | None = None) -> DataFrame:
    """One row per entity and attribute: winner, alternatives (the next ``keep``), conflict.

    Order: score, rank, then ``tie``. A conflict is a runner-up whose value differs materially (by more than ``tolerance``, or at all) at
    a score less than CONFLICT_GAP away. Only ``keep`` + 1 rows of a key go through the shuffle (the limit is pushed below the window).
    """
    w = Window.partitionBy(entity, attribute).orderBy(F.col(score).desc(), F.col(rank).desc(), F.col(tie))
    top = candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep + 1)
    item = F.struct(F.col("_rn"), F.col(score).alias("score"), F.col(rank).alias("authority_rank"), F.col(value).alias("value"), F.col(tie).alias("ref"))
    lists = top.groupBy(entity, attribute).agg(F.array_sort(F.collect_list(item)).alias("r"))
    a, b = F.col("r")[0], F.try_element_at("r", F.lit(2))
    apart = F.abs(a["value"] - b["value"]) > tolerance if tolerance is not None else ~a["value"].eqNullSafe(b["value"])
    conflict = F.coalesce(b.isNotNull() & apart & (F.abs(a["score"] - b["score"]) < CONFLICT_GAP), F.lit(False))
    return lists.select(entity, attribute, a["value"].alias("value"), a["score"].alias("score"), a["ref"].alias("ref"), b["score"].alias("runner_up_score"), (F.size("r") - 1).alias("n_alternatives"), F.slice("r", 2, keep).alias("alternatives"), conflict.alias("conflict"))


def gap_priority(attribute: Column, kind: Column, score: Column) -> Column:
    base = F.lit(60)
    for k, v in GAP_BASE.items():
        base = F.when(attribute == k, F.lit(v)).otherwise(base)
    boost = F.when(kind == "ride_track", 4).when(kind == "building", 3).when(kind.isin("path", "road"), 2).otherwise(0)
    return F.least(F.lit(100.0), half_up(base + boost - F.coalesce(score, F.lit(0.0)) * 10))


def gaps(required: DataFrame, resolved: DataFrame, entity: str = "entity", attribute: str = "attribute") -> DataFrame:
    """Required (entity, kind, attribute) without a winner, or with one below LOW_CONFIDENCE: status, priority."""
    j = required.join(resolved.select(entity, attribute, "score"), [entity, attribute], "left")
    status = F.when(F.col("score").isNull(), "missing").when(F.col("score") < LOW_CONFIDENCE, "low-confidence")
    return j.withColumn("status", status).where("status is not null").withColumn("priority", gap_priority(F.col(attribute), F.col("kind"), F.col("score")))


def materialise(resolved: DataFrame, known: DataFrame, entity: str = "entity", attribute: str = "attribute") -> DataFrame:
    """Winners that may be written back: no geometry, no conflicts, .72 or more, or .50 where ``known`` (entity, attribute) has nothing."""
    j = resolved.join(known.select(entity, attribute).distinct().withColumn("_has", F.lit(True)), [entity, attribute], "left")
    need = F.when(F.col("_has").isNull(), 0.50).otherwise(0.72)
    return j.where(~F.col("conflict") & (F.col(attribute) != "geometry") & (F.col("score") >= need)).drop("_has")


def summary(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Counts over grouping sets: every column of ``by`` alone, and all together."""
    sets = [[F.col(c)] for c in by] + [[]]
    counted = (F.count("*").alias("total"), F.count_if(F.col("score") < LOW_CONFIDENCE).alias("low_confidence"), F.count_if("conflict").alias("conflicts"))
    return resolved.groupingSets(sets, *by).agg(*counted)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.65, "C").when(score >= 0.5, "D").otherwise("E")


def accuracy(components: DataFrame, critical: Column) -> DataFrame:
    """score, score_grade and grade (at most B where ``critical``) of rows with the six component columns."""
    total = None
    for k, w in ACCURACY_WEIGHTS.items():
        total = clamp(F.col(k)) * w if total is None else total + clamp(F.col(k)) * w
    out = components.withColumn("_total", total)
    capped = F.when(critical & (grade(F.col("_total")) == "A"), "B").otherwise(grade(F.col("_total")))
    return out.withColumns({"score": half_up("_total", 3), "score_grade": grade(F.col("_total")), "grade": capped}).drop("_total")
