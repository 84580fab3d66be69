"""Ordered analytics: runs, chainage, gap filling, spacing, grades, and the dynamic programme along a profile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: list[str], x: str, value: str | None = None) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive whole numbers ``x`` (of one ``value``), distinct cells counted once."""
    part = [*key, value] if value else key
    d = df.select(*part, x).distinct()
    island = F.col(x) - F.row_number().over(Window.partitionBy(*part).orderBy(x))
    return d.withColumn("_i", island).groupBy(*part, "_i").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.count("*").alias("n")).drop("_i")


def chainage(df: DataFrame, key: list[str], order: list[str], step: Column) -> DataFrame:
    """Running sum of steps; ``step`` may use lag over the same order, and counts 0 on the first row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_step", step).withColumn("chainage", F.sum(F.coalesce("_step", F.lit(0.0))).over(w)).drop("_step")


def fill_short_gaps(df: DataFrame, key: list[str], at: str, value: str, confidence: str, longest: float = 12.0) -> DataFrame:
    """Linear between the nearest known neighbours where these are at most ``longest`` apart; confidence is the weaker end times .72. Nothing is extrapolated."""
    w = Window.partitionBy(*key).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v"), F.col(confidence).alias("c")))
    d = df.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    span = F.col("_b.at") - F.col("_a.at")
    ok = F.col(value).isNull() & (span <= longest) & (span > 0)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * ((F.col(at) - F.col("_a.at")) / span)
    return d.withColumns({"filled": F.when(ok, line).otherwise(F.col(value)), "filled_confidence": F.when(ok, F.least("_a.c", "_b.c") * 0.72).otherwise(F.col(confidence)), "evidence": F.when(F.col(value).isNotNull(), "measured").when(ok, "interpolated").otherwise("unknown")}).drop("_a", "_b")


def bracket_levels(samples: DataFrame, anchors: DataFrame, key: list[str], at: str, level: str) -> DataFrame:
    """Levels of samples between anchors (equal places merged by their mean), linear; beyond the outermost anchors, or with fewer than two, unknown."""
    merged = anchors.groupBy(*key, at).agg(F.avg(level).alias("_anchor"))
    both = samples.withColumn("_sample", F.lit(True)).unionByName(merged, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(at)
    known = F.when(F.col("_anchor").isNotNull(), F.struct(F.col(at).alias("at"), F.col("_anchor").alias("v")))
    range_back, range_on = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    d = both.withColumn("_a", F.last(known, ignorenulls=True).over(range_back)).withColumn("_b", F.first(known, ignorenulls=True).over(range_on))
    span = F.col("_b.at") - F.col("_a.at")
    value = F.when(span == 0, F.col("_a.v")).when(span > 0, F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(at) - F.col("_a.at")) / span)
    return d.where("_sample").withColumn("bracketed", value).drop("_a", "_b", "_anchor", "_sample")


def merged_anchors(anchors: DataFrame, key: list[str], at: str, level: str, confidence: str, ref: str, within: float = 0.75) -> DataFrame:
    """Runs of anchors, each within ``within`` of the one before it, as one: median place and level, least confidence, all references in order."""
    w = Window.partitionBy(*key).orderBy(at)
    first = F.coalesce(F.col(at) - F.lag(at).over(w) > within, F.lit(True)).cast("int")
    d = anchors.select(*key, at, level, confidence, ref).withColumn("_first", first).withColumn("_run", F.sum("_first").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, "_run").agg(F.median(at).alias(at), F.median(level).alias(level), F.min(confidence).alias(confidence), F.array_join(F.array_sort(F.collect_set(ref)), "|").alias(ref)).drop("_run")


def anchored_profile(samples: DataFrame, anchors: DataFrame, key: list[str], at: str, level: str, confidence: str, ref: str, spacing: float = 1.0, within: float = 0.75, apart: float = 5.0) -> DataFrame:
    """Samples with level, confidence, evidence and references from merged anchors of their line, which must be two at least and span ``apart``.

    A sample at .45 of the spacing or nearer takes the anchor before it, else the one after it ('planning-verified'); between two anchors it lies on the line
    with .82 of the weaker confidence ('interpolated'); outside them it stays unknown ('none').
    """
    m = merged_anchors(anchors, key, at, level, confidence, ref, within)
    line = Window.partitionBy(*key)
    m = m.withColumn("_wide", F.max(at).over(line) - F.min(at).over(line)).withColumn("_n", F.count("*").over(line)).where((F.col("_n") >= 2) & (F.col("_wide") >= apart))
    known = F.struct(F.col(at).alias("at"), F.col(level).alias("v"), F.col(confidence).alias("c"), F.col(ref).alias("s"))
    both = samples.withColumn("_sample", F.lit(True)).unionByName(m.select(*key, at, known.alias("_anchor")), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(at, F.col("_sample").asc_nulls_last())  # samples before an anchor at their place
    d = both.withColumn("_a", F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_anchor", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_sample")
    a, b, x, near = F.col("_a"), F.col("_b"), F.col(at), spacing * 0.45
    inside = b.isNotNull() & (a.isNotNull() | (x == b["at"]))
    direct = F.when(inside & (x - a["at"] <= near), a).when(inside & (b["at"] - x <= near), b)
    d = d.withColumn("_d", direct)
    part = (x - a["at"]) / (b["at"] - a["at"])
    pick = lambda f, between: F.when(F.col("_d").isNotNull(), F.col("_d")[f]).when(inside, between)
    out = {level: pick("v", a["v"] + (b["v"] - a["v"]) * part), confidence: pick("c", F.least(a["c"], b["c"]) * 0.82), ref: pick("s", F.concat_ws("|", a["s"], b["s"]))}
    evidence = F.when(F.col("_d").isNotNull(), "planning-verified").when(inside, "interpolated").otherwise("none")
    return d.withColumns({**out, "evidence": evidence}).drop("_a", "_b", "_d", "_anchor", "_sample")


def spaced(df: DataFrame, key: list[str], order: list[str], travelled: str, spacing: float) -> DataFrame:
    """Rows at which a place is due: the first at half the spacing, then every spacing of ``travelled``; several due on one step are one."""
    w = Window.partitionBy(*key).orderBy(*order)
    due = F.floor((F.col(travelled) + 1e-6 - spacing / 2) / spacing)
    return df.withColumn("_due", due).withColumn("_before", F.lag("_due", 1, -1).over(w)).where("_due >= 0 and _due > _before").drop("_due", "_before")


def terrain_grade(df: DataFrame, key: list[str], at: str, z: str, water: Column | None = None) -> DataFrame:
    """Per line the 90th percentile and the largest grade (per cent) of consecutive samples: 'bridge-review' over water, 'steep' above 16, 'ramp' above 8.3, 'level'."""
    w = Window.partitionBy(*key).orderBy(at)
    run = F.col(at) - F.lag(at).over(w)
    g = df.withColumn("_g", F.when(run > 0, F.abs(F.col(z) - F.lag(z).over(w)) / run * 100)).withColumn("_w", water if water is not None else F.lit(False))
    out = g.groupBy(*key).agg(F.percentile("_g", 0.9).alias("p90"), F.max("_g").alias("max_grade"), F.bool_or("_w").alias("_water"))
    return out.withColumn("terrain", F.when(F.col("_water"), "bridge-review").when(F.col("p90") > 16, "steep").when(F.col("p90") > 8.3, "ramp").otherwise("level")).drop("_water")


def height_clusters(points: DataFrame, key: list[str], z: str, classification: str, terrain: Column | None = None, keep: int = 8) -> DataFrame:
    """Half-metre bins of heights: median, count, quality; the best ``keep`` of a key."""
    p = points.withColumn("_bin", F.floor(F.col(z) / 0.5 + 0.5)).withColumn("_t", terrain if terrain is not None else F.lit(None).cast("double"))
    above = F.col(z) - F.col("_t")
    p = p.where(F.col("_t").isNull() | above.between(0.45, 80))
    c = p.groupBy(*key, "_bin").agg(F.median(z).alias("elevation"), F.count("*").alias("n"), F.avg(F.when(F.col(classification).isin(0, 1), 1.0).otherwise(0.0)).alias("_u"), F.min("_t").alias("_t"))
    over = F.coalesce(F.col("elevation") - F.col("_t"), F.lit(0.0))
    quality = F.log2(F.col("n") + 1) * 1.35 + F.col("_u") * 0.35 - over * 0.008
    base = F.greatest(F.lit(0.25), F.least(F.lit(0.86), 0.36 + 0.34 * F.least(F.lit(1.0), F.log2(F.col("n") + 1) / 2.6) + 0.12 * F.col("_u") - F.greatest(F.lit(0.0), over - 45) * 0.004))
    c = c.withColumns({"quality": quality, "base_confidence": base})
    w = Window.partitionBy(*key).orderBy(F.col("quality").desc(), "_bin")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("_u", "_t")


def best_path(at: np.ndarray, heights: list[np.ndarray], quality: list[np.ndarray]) -> list[int | None]:
    """For each sample the candidate on the best path: quality less .34 per metre of change and 1.8 per unit of slope above 1.15; slopes above 3.5 are barred.

    Samples without candidates, and places where every step is barred, break the path into parts.
    """
    n = len(at)
    chosen: list[int | None] = [None] * n
    best: list[np.ndarray | None] = [None] * n
    came: list[np.ndarray | None] = [None] * n
    for i in range(n):
        if not len(heights[i]):
            continue
        best[i], came[i] = quality[i].astype(float), np.full(len(heights[i]), -1)
        if i and best[i - 1] is not None:
            delta = np.abs(heights[i][:, None] - heights[i - 1][None])
            slope = delta / max(0.25, at[i] - at[i - 1])
            step = best[i - 1][None] - delta * 0.34 - np.maximum(0, slope - 1.15) * 1.8
            step[slope > 3.5] = -np.inf
            if np.isfinite(step).any():
                came[i] = np.where(np.isfinite(step.max(axis=1)), step.argmax(axis=1), -2)
                best[i] = np.where(came[i] >= 0, quality[i] + step.max(axis=1), -np.inf)
    i = n - 1
    while i >= 0:
        if best[i] is None:
            i -= 1
            continue
        k = int(best[i].argmax())
        while True:
            chosen[i] = k
            k = int(came[i][k])
            i -= 1
            if k < 0:
                break
    return chosen


def viterbi_profile(candidates: DataFrame, key: str, at: str, height: str, quality: str) -> DataFrame:
    """(key, at, height, quality) on the best path of each key; a key is one line, and its samples are one group."""

    def run(k, t):
        a, h, q = (t.column(c).to_numpy() for c in (at, height, quality))
        order = np.lexsort((h, -q, a))
        a, h, q = a[order], h[order], q[order]
        cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
        places = a[np.r_[0, cuts]]
        hs, qs = np.split(h, cuts), np.split(q, cuts)
        picked = best_path(places, hs, qs)
        rows = [(p, x[c], y[c]) for p, x, y, c in zip(places, hs, qs, picked) if c is not None]
        return pa.table({key: pa.array([k[0].as_py()] * len(rows), t.schema.field(key).type), at: pa.array([float(r[0]) for r in rows], pa.float64()), height: pa.array([r[1] for r in rows], pa.float64()), quality: pa.array([r[2] for r in rows], pa.float64())})

    kind = candidates.schema[key].dataType.simpleString()
    return candidates.select(key, F.col(at).cast("double").alias(at), height, quality).groupBy(key).applyInArrow(run, f"{key} {kind}, {at} double, {height} double, {quality} double")


def blue_noise(df: DataFrame, key: str, x: str, z: str, spacing: float, seed: int = 0, multiplier: Column | None = None, target: Column | None = None) -> DataFrame:
    """Points of each key thinned in order of their coordinate hash: one stays if none before it is nearer than ``spacing``.

    The hash is divided by ``multiplier``, so points of a high one come first; points without a positive one take no part. A key ends at its ``target``
    (the smallest of its points' values), if there is one. Sequential by nature, so a key is one group.
    """
    from strataweave.functions.scalars import hash_2d

    def run(k, t):
        xs, zs = t.column(x).to_numpy(), t.column(z).to_numpy()
        order = np.lexsort((xs, zs, t.column("_h").to_numpy(), t.column("_score").to_numpy()))
        targets = [v for v in t.column("_target").to_pylist() if v is not None]
        most = min(targets) if targets else len(order)
        grid: dict[tuple[int, int], list[int]] = {}
        keep = []
        for i in order:
            if len(keep) >= most:
                break
            c = (int(xs[i] // spacing), int(zs[i] // spacing))
            near = (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((c[0] + a, c[1] + b), ()))
            if all(np.hypot(xs[i] - xs[j], zs[i] - zs[j]) >= spacing for j in near):
                grid.setdefault(c, []).append(i)
                keep.append(i)
        return t.take(pa.array(sorted(keep), pa.int64())).select([key, x, z])

    kind = df.schema[key].dataType.simpleString()
    m = multiplier.cast("double") if multiplier is not None else F.lit(1.0)
    n = target.cast("bigint") if target is not None else F.lit(None).cast("bigint")
    d = df.select(key, F.col(x).cast("double").alias(x), F.col(z).cast("double").alias(z), m.alias("_m"), n.alias("_target")).withColumn("_h", hash_2d(F.floor(F.col(x) + 0.5), F.floor(F.col(z) + 0.5), seed))
    d = d.where(F.col("_m") > 0).withColumn("_score", F.col("_h") / F.col("_m")).drop("_m")
    return d.groupBy(key).applyInArrow(run, f"{key} {kind}, {x} double, {z} double")


def spread_of(rows: DataFrame, key: list[str], value: str, least: int = 1) -> DataFrame:
    """(key, p65, spread, med, n) of groups of ``least`` values or more: upper middle, width of the middle 80 %, median."""
    g = rows.groupBy(*key).agg(F.percentile(value, 0.65).alias("p65"), (F.percentile(value, 0.9) - F.percentile(value, 0.1)).alias("spread"), F.median(value).alias("med"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least)


def weighted_share(rows: DataFrame, key: list[str], covered: Column, weight: Column) -> DataFrame:
    """(key, coverage): the weight of what is covered over all weight; null where nothing weighs."""
    return rows.groupBy(*key).agg((F.sum(F.when(covered, weight).otherwise(0)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("coverage"))
