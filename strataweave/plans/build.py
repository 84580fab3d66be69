"""The build as one DAG of DataFrame stages, with reliable checkpoints where the stages hand over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage
from strataweave.functions.geometry import bounds
from strataweave.functions.ladders import temporal_state
from strataweave.operators import evidence as E
from strataweave.operators import fusion as U
from strataweave.operators.spatial import BOX, box_join

REQUIRED = {"building": ["geometry", "height", "roof", "material"], "structure": ["geometry", "height", "material"], "path": ["geometry", "width", "material"], "road": ["geometry", "width", "material"], "ride_track": ["geometry", "verticalProfile"], "vegetation": ["geometry", "height"], "barrier": ["geometry", "height", "material"], "water": ["geometry"], "terrain_detail": ["geometry"]}


def with_box(features: DataFrame) -> DataFrame:
    b = bounds(F.flatten("parts"))
    return features.withColumn("_b", b).select(*features.columns, *[F.col(f"_b.{k}").alias(k) for k in BOX])


def fuse(base: DataFrame, gap_source: DataFrame, public: DataFrame, overrides: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Features of all sources (one schema): the gap source only where no base feature of its kind touches, public observations beside them, overrides in the place of what they replace.

    The gap source's rows are compared with the base, and among themselves by a fixed order (the smaller id stays), which takes the
    place of an acceptance that depends on the order of reading.
    """
    b, g = with_box(base), with_box(gap_source)
    taken = box_join(g, b, 32.0, tolerance).where(F.col("l.kind") == F.col("r.kind")).select(F.col("l.id").alias("id"))
    free = g.join(taken.distinct(), "id", "left_anti")
    twins = box_join(free, free, 32.0, tolerance).where((F.col("l.kind") == F.col("r.kind")) & (F.col("r.id") < F.col("l.id"))).select(F.col("l.id").alias("id"))
    extra = free.join(twins.distinct(), "id", "left_anti").drop(*BOX)
    joined = base.unionByName(extra, allowMissingColumns=True).unionByName(public, allowMissingColumns=True)
    return U.replace_rows(joined, overrides, "id", "replaces")


def evidence_graph(features: DataFrame, observations: DataFrame, reference_date: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, gaps) for features (id, kind, status, layer) and observations (id, attribute, value, ref, rank, directness, confidence, observed_at, resolution_m)."""
    f = features.withColumn("t", temporal_state("status", layer=F.col("layer")))
    o = observations.join(f.select("id", "kind", "t"), "id")
    age = F.datediff(F.lit(reference_date).cast("date"), F.col("observed_at").cast("date"))
    terms = E.quality_terms(F.col("rank"), F.col("directness"), F.col("confidence"), age, F.col("resolution_m"), F.col("t.state"), F.col("t.confidence"))
    c = cut_lineage(o.select(F.col("id").alias("entity"), "attribute", "value", "ref", F.col("rank").alias("authority_rank"), E.evidence_score(terms).alias("score")))
    resolved = E.resolve(c, tolerance=F.when(F.col("attribute") == "width", 0.75).otherwise(1.0))
    need = F.lit(None).cast("array<string>")
    for kind, names in REQUIRED.items():
        need = F.when(F.col("kind") == kind, F.array(*map(F.lit, names))).otherwise(need)
    required = features.select(F.col("id").alias("entity"), "kind", F.explode(F.coalesce(need, F.array(F.lit("geometry")))).alias("attribute"))
    return resolved, E.gaps(required, resolved)
