"""Spatial joins by grid buckets, and the gate that rejects ambiguous winners.

A theta join on boxes would compare everything with everything. Here each side is exploded to the grid cells that it touches, an
equi-join meets them by cell, and a pair is kept only in the first cell that both touch, so that no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.geometry import box_iou, box_overlap, segment_distance
from strataweave.functions.scalars import clamp, half_up

BOX = ("min_x", "min_z", "max_x", "max_z")


def _cells(df: DataFrame, size: float, grow: float, prefix: str) -> DataFrame:
    lo = lambda c: F.floor((F.col(c) - grow) / size).cast("bigint")
    hi = lambda c: F.floor((F.col(c) + grow) / size).cast("bigint")
    df = df.withColumns({f"_{prefix}x": lo("min_x"), f"_{prefix}z": lo("min_z")})
    df = df.withColumn("_cx", F.explode(F.sequence(lo("min_x"), hi("max_x"))))
    return df.withColumn("_cz", F.explode(F.sequence(lo("min_z"), hi("max_z"))))


def box_join(left: DataFrame, right: DataFrame, size: float, tolerance: float = 0.0, left_as: str = "l", right_as: str = "r") -> DataFrame:
    """Pairs of rows (as structs) whose boxes, the left one grown by ``tolerance``, touch. Rows with a null box pair with nothing."""
    ok = " and ".join(f"{c} is not null" for c in BOX)
    a = _cells(left.where(ok), size, tolerance, "l")
    b = _cells(right.where(ok), size, 0.0, "r")
    a = a.select("_cx", "_cz", "_lx", "_lz", F.struct(*left.columns).alias(left_as))
    b = b.select("_cx", "_cz", "_rx", "_rz", F.struct(*right.columns).alias(right_as))
    first = (F.col("_cx") == F.greatest("_lx", "_rx")) & (F.col("_cz") == F.greatest("_lz", "_rz"))
    p, q = F.col(left_as), F.col(right_as)
    touch = (p["min_x"] - tolerance <= q["max_x"]) & (p["max_x"] + tolerance >= q["min_x"]) & (p["min_z"] - tolerance <= q["max_z"]) & (p["max_z"] + tolerance >= q["min_z"])
    return a.join(b, ["_cx", "_cz"]).where(first & touch).select(left_as, right_as)


def _blocks(df: DataFrame, step: float, by: list[str], once: str | None, largest: int = 256) -> DataFrame:
    """Rows whose corners lie in the same squares of ``step``, at most ``largest`` a block: the rows, ``by``, the box round them, and bounds of what one of them measures."""
    ok = " and ".join(f"{c} is not null" for c in BOX)
    square = [f"_q{c}" for c in BOX]
    d = df.where(ok).select(F.struct(*df.columns).alias("row"), *by, *BOX, *([F.col(once).alias("_id")] if once else []), *[F.floor(F.col(c) / step).alias(q) for c, q in zip(BOX, square)])
    d = d.withColumn("_n", F.floor(F.row_number().over(Window.partitionBy(*by, *square).orderBy(F.lit(0))) / largest))
    wide = F.greatest(F.lit(0.0), F.min("max_x") - F.max("min_x"))
    high = F.greatest(F.lit(0.0), F.min("max_z") - F.max("min_z"))
    first = [F.min("_id").alias("first")] if once else []
    return d.groupBy(*by, *square, "_n").agg(F.collect_list("row").alias("rows"), *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX], (wide * high).alias("least_area"), *first).drop(*square, "_n")


def iou_pairs(left: DataFrame, right: DataFrame, least: float, size: float = 8.0, step: float = 2.0, by: list[str] | None = None, also: Column | None = None, once: str | None = None) -> DataFrame:
    """Pairs of rows (structs l and r) whose boxes overlap by ``least`` of their union or more; ``least`` is above 0, rows with a null box pair with nothing.

    Boxes that lie alike, to ``step`` at each corner, are one block. Blocks meet in the grid of ``size``, and only those rows are paired whose
    blocks leave room for such an overlap, so that crowded places don't compare all that touches. ``also`` is a condition over l and r
    on the columns ``by``, which are the same throughout a block. With ``once``, a unique id, both sides are one table and each pair comes once, the smaller id as l.
    """
    by = by or []
    met = box_join(_blocks(left, step, by, once), _blocks(right, step, by, once), size)
    p, q = F.col("l"), F.col("r")
    room = lambda a, b: F.greatest(F.lit(0.0), F.least(p[b], q[b]) - F.greatest(p[a], q[a]))
    met = met.where(room("min_x", "max_x") * room("min_z", "max_z") * (1 + least) >= (p["least_area"] + q["least_area"]) * (least * (1 - 1e-9)))
    if also is not None:
        met = met.where(also)
    if once:
        met = met.where(p["first"] <= q["first"])
    same = (p["first"] == q["first"]).alias("same") if once else F.lit(False).alias("same")
    rows = met.select(F.explode(p["rows"]).alias("l"), q["rows"].alias("_r"), same).select("l", F.explode("_r").alias("r"), "same")
    rows = rows.where(box_iou(_box(p), _box(q)) >= least)
    if once:
        back = p[once] > q[once]
        rows = rows.where(~F.col("same") | (p[once] < q[once])).select(F.when(back, q).otherwise(p).alias("l"), F.when(back, p).otherwise(q).alias("r"))
    return rows.select("l", "r")


def _box(c: Column) -> dict[str, Column]:
    return {k: c[k] for k in BOX}


def box_match_score(a: dict[str, Column], b: dict[str, Column], same_family: Column, weights=(0.43, 0.29, 0.18, 0.10), other_family: float = 0.55) -> Column:
    """Overlap, centre distance over the diagonal, scale, family: the authority match; (.46, .29, .17, .08) and .5 for change sets."""
    cx = lambda q: (q["min_x"] + q["max_x"]) / 2
    cz = lambda q: (q["min_z"] + q["max_z"]) / 2
    diag = lambda q: F.hypot(q["max_x"] - q["min_x"], q["max_z"] - q["min_z"])
    area = lambda q: F.greatest(F.lit(0.01), (q["max_x"] - q["min_x"]) * (q["max_z"] - q["min_z"]))
    far = F.hypot(cx(a) - cx(b), cz(a) - cz(b)) / F.greatest(F.lit(8.0), diag(a), diag(b))
    near = F.greatest(F.lit(0.0), 1 - far)
    scale = F.least(area(a), area(b)) / F.greatest(area(a), area(b))
    w = weights
    return clamp(w[0] * box_overlap(a, b) + w[1] * near + w[2] * scale + w[3] * F.when(same_family, 1.0).otherwise(other_family))


def planning_match_score(a: dict[str, Column], b: dict[str, Column], shape_distance: Column, same_name: Column, tolerance: float) -> Column:
    """The edit match: .30 + .25 overlap + .25 shape + .10 centre + .10 name."""
    cx = lambda q: (q["min_x"] + q["max_x"]) / 2
    cz = lambda q: (q["min_z"] + q["max_z"]) / 2
    shape = F.greatest(F.lit(0.0), 1 - F.least(shape_distance, F.lit(tolerance * 2)) / (tolerance * 2))
    centre = F.greatest(F.lit(0.0), 1 - F.hypot(cx(a) - cx(b), cz(a) - cz(b)) / max(1.0, tolerance * 3))
    return half_up(0.30 + 0.25 * box_overlap(a, b) + 0.25 * shape + 0.10 * centre + F.when(same_name, 0.10).otherwise(0.0), 3)


def best_of(scored: DataFrame, key: list[str], target: str, score: str, minimum: float, gap: float, smaller_is_better: bool = False) -> DataFrame:
    """One row per key: target, score, second_score, status 'accepted', 'below-score-gate' or 'ambiguous'.

    Fails closed: a runner-up nearer than ``gap`` rejects the winner. Ties go to the smaller target and then are ambiguous anyway.
    The window's limit of two rows a key is pushed below the shuffle, so candidates are thinned where they are made.
    """
    sign = 1 if smaller_is_better else -1
    pair = F.struct((F.col(score) * sign).alias("s"), F.col(target).alias("t"))
    w = Window.partitionBy(*key).orderBy("p.s", "p.t")
    two = scored.select(*key, pair.alias("p")).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    best = two.groupBy(*key).agg(F.min(F.when(F.col("rn") == 1, F.col("p"))).alias("b"), F.min(F.when(F.col("rn") == 2, F.col("p"))).alias("c"))
    s, c = F.col("b.s") * sign, F.col("c.s") * sign
    bad = s > minimum if smaller_is_better else s < minimum
    status = F.when(bad, "below-score-gate").when(F.col("c").isNotNull() & (F.abs(s - c) < gap), "ambiguous").otherwise("accepted")
    return best.select(*key, F.col("b.t").alias(target), s.alias(score), c.alias(f"second_{score}"), status.alias("status"))


def near_boxes(left: DataFrame, right: DataFrame, size: float, least: float = 8.0) -> DataFrame:
    """Pairs of rows (structs l and r) whose boxes overlap or whose centres are nearer than the longer of ``least`` and both diagonals.

    Boxes have classes by their diagonal, each with a grid twice as coarse as the one before. Two boxes meet in the grid of the larger one's
    class, where their centres lie in the same or neighbouring cells. So a box takes nine cells of its own class and one for each coarser
    class that there is, however large other boxes are.
    """
    diag = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(float(least)), diag) / size))).cast("int")
    ok = " and ".join(f"{c} is not null" for c in BOX)
    a, b = (df.where(ok).select(F.struct(*df.columns).alias(name), level.alias("_lv"), ((F.col("min_x") + F.col("max_x")) / 2).alias("_x"), ((F.col("min_z") + F.col("max_z")) / 2).alias("_z")) for df, name in ((left, "l"), (right, "r")))
    known = sorted(r[0] for r in a.select("_lv").union(b.select("_lv")).distinct().collect())  # a few dozen at most: sizes double

    def cells(df, around, floor):
        """Cells of each box: with neighbours in its own class, or alone in all classes from ``floor`` above its own on."""
        if around:
            step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
            d = df.withColumn("_m", F.col("_lv")).withColumn("_s", F.explode(step))
        else:
            d = df.withColumn("_m", F.explode(F.filter(F.array(*map(F.lit, known)), lambda k: k >= F.col("_lv") + floor))).withColumn("_s", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        cell = lambda c, k: (F.floor(F.col(c) / (size * F.pow(F.lit(2.0), F.col("_m")))) + F.col(f"_s.{k}")).cast("bigint")
        return d.select("_m", cell("_x", "i").alias("_cx"), cell("_z", "j").alias("_cz"), *[c for c in ("l", "r") if c in df.columns])

    if not known:
        return a.select("l").join(b.select("r"), F.lit(False))
    met = cells(a, True, 0).join(cells(b, False, 0), ["_m", "_cx", "_cz"]).unionByName(cells(a, False, 1).join(cells(b, True, 0), ["_m", "_cx", "_cz"]))
    p, q = F.col("l"), F.col("r")
    touch = (p["min_x"] <= q["max_x"]) & (p["max_x"] >= q["min_x"]) & (p["min_z"] <= q["max_z"]) & (p["max_z"] >= q["min_z"])
    centre = F.hypot((p["min_x"] + p["max_x"] - q["min_x"] - q["max_x"]) / 2, (p["min_z"] + p["max_z"] - q["min_z"] - q["max_z"]) / 2)
    long = lambda c: F.hypot(c["max_x"] - c["min_x"], c["max_z"] - c["min_z"])
    return met.where(touch | (centre < F.greatest(F.lit(float(least)), long(p), long(q)))).select("l", "r")


def match_boxes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float, minimum: float = 0.66, gap: float = 0.08, compatible: Column | None = None, **score) -> DataFrame:
    """Best right box for each left box. ``compatible`` is over structs l and r; family columns of either side are called ``family``.

    Only boxes that could still reach the minimum can matter: with neither overlap nor closeness a score stays below .28, so only the
    pairs of ``near_boxes`` are formed.
    """
    pairs = near_boxes(left, right, size)
    if compatible is not None:
        pairs = pairs.where(compatible)
    scored = pairs.select(F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id), box_match_score(_box(F.col("l")), _box(F.col("r")), F.col("l.family") == F.col("r.family"), **score).alias("score"))
    return best_of(scored, [left_id], right_id, "score", minimum, gap)


def nearest_point(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tolerance: float = 12.0, ambiguity: float = 1.5) -> DataFrame:
    """As-of join in space: the nearest right point (x, z) within ``tolerance``, unless the second is within ``ambiguity`` of it."""
    box = lambda df: df.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    pairs = box_join(box(left), box(right), tolerance * 2, tolerance)
    d = F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.z") - F.col("r.z"))
    near = pairs.select(F.col(f"l.{left_id}").alias(left_id), F.col(f"r.{right_id}").alias(right_id), d.alias("distance")).where(F.col("distance") <= tolerance)
    return best_of(near, [left_id], right_id, "distance", tolerance, ambiguity, smaller_is_better=True)


def overlap_fraction(samples: DataFrame, segments: DataFrame, line_id: str, tolerance: float, key: list[str] | None = None) -> DataFrame:
    """(line, fraction): how many samples (line_id, x, z) lie within ``tolerance`` of any segment (ax, az, bx, bz)."""
    p = samples.withColumns({"_s": F.monotonically_increasing_id(), "min_x": F.col("x"), "max_x": F.col("x"), "min_z": F.col("z"), "max_z": F.col("z")})
    s = segments.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_z": F.least("az", "bz"), "max_z": F.greatest("az", "bz")})
    pairs = box_join(p, s, max(8.0, tolerance * 2), tolerance)
    d = segment_distance(F.col("l.x"), F.col("l.z"), F.col("r.ax"), F.col("r.az"), F.col("r.bx"), F.col("r.bz"))
    if key:
        for k in key:
            pairs = pairs.where(F.col(f"l.{k}") == F.col(f"r.{k}"))
    hit = pairs.where(d <= tolerance).groupBy(F.col(f"l.{line_id}").alias(line_id), F.col("l.x").alias("x"), F.col("l.z").alias("z")).agg(F.lit(1).alias("hit"))
    known = samples.join(hit, [line_id, "x", "z"], "left")
    return known.groupBy(line_id).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("fraction"))


def overlap_decision(fraction: Column) -> Column:
    return F.when(fraction >= 0.8, "duplicate").when(fraction >= 0.2, "partial-overlap").otherwise("accept")


def relations_over_ways(features: DataFrame, size: float = 32.0, least: float = 0.9, eps: float = 1e-9) -> DataFrame:
    """Features (id, element, kind, subtype, name, box) without the ways that a relation of the same kind, subtype and name covers to ``least`` on both axes.

    Names are compared trimmed, in lower case, with single spaces; features without a name stay.
    """
    name = F.regexp_replace(F.lower(F.trim("name")), r"\s+", " ")
    named = features.select("id", "element", F.when(name != "", F.concat_ws("|", F.coalesce("kind", F.lit("")), F.coalesce("subtype", F.lit("")), name)).alias("_key"), *BOX).where("_key is not null")
    p, q = F.col("l"), F.col("r")

    def covered(a, b):
        span = p[b] - p[a]
        inside = (p[a] >= q[a] - eps) & (p[a] <= q[b] + eps)
        return F.when(span <= eps, inside.cast("double")).otherwise((F.least(p[b], q[b]) - F.greatest(p[a], q[a])) / span)

    pairs = near_boxes(named.where("element = 'way'"), named.where("element = 'relation'"), size)
    gone = pairs.where((p["_key"] == q["_key"]) & (covered("min_x", "max_x") >= least) & (covered("min_z", "max_z") >= least)).select(p["id"].alias("id")).distinct()
    return features.join(gone, "id", "left_anti")
