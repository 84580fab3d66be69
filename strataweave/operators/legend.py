"""Legends of drawings: what material a code, a fill or a hatch means on one page, and where else on the page it occurs.

Everything stays on its page, and nothing here sets geometry: the results are observations. Labels meet codes and swatches in bands of a page, strokes meet
shapes in cells, so a page of many items is not one group and no pair of far items is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage
from strataweave.functions.scalars import half_up
from strataweave.operators.details import legend_code

# Fixed values, in points: a code's line and distance from its label, a swatch's distance and span, the cell of strokes; strokes that make a hatch of a swatch and of a shape.
LINE, CODE_REACH, SWATCH_REACH, LEAST_SPAN, MOST_SPAN, CELL = 4.0, 180.0, 190.0, 3.0, 84.0, 64.0
SWATCH_HEIGHT = max(30.0, MOST_SPAN * 0.55)
SWATCH_STROKES, SHAPE_STROKES = 2, 3


def _bands(y: str, size: float) -> Column:
    band = F.floor(F.col(y) / size)
    return F.sequence(band - 1, band + 1)


def nearby_codes(labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(page, label, code, code_item, code_size): the code in a label's line that is nearest, those on its left first; texts that are the label itself don't count."""
    t = texts.withColumn("code", legend_code(F.col("text"))).where("code is not null and x is not null and y is not null")
    t = t.select("page", "item", "code", "size", F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("y") / LINE).alias("_band"))
    l = labels.where("x is not null and y is not null").select("page", "label", "items", "x", "y", F.explode(_bands("y", LINE)).alias("_band"))
    dx, dy = F.abs(F.col("_x") - F.col("x")), F.abs(F.col("_y") - F.col("y"))
    own = F.coalesce(F.array_contains("items", F.col("item")), F.lit(False))
    p = l.join(t, ["page", "_band"]).where((dy <= LINE) & (dx <= CODE_REACH) & ~own)
    score = dy * 12 + dx + F.when(F.col("_x") > F.col("x"), 8.0).otherwise(0.0)
    return p.groupBy("page", "label").agg(F.min(F.struct(score.alias("s"), "item", "code", "size")).alias("_b")).select("page", "label", F.col("_b.code").alias("code"), F.col("_b.item").alias("code_item"), F.col("_b.size").alias("code_size"))


def strokes_inside(shapes: DataFrame, strokes: DataFrame) -> DataFrame:
    """(page, path, hatch_key, n): strokes by key whose middle lies in the box of each shape, the shape's own path apart."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    s = strokes.select("page", F.col("path").alias("_stroke"), "hatch_key", ((F.col("min_x") + F.col("max_x")) / 2).alias("_x"), ((F.col("min_z") + F.col("max_z")) / 2).alias("_z"))
    s = s.withColumns({"_cx": F.floor(F.col("_x") / CELL), "_cz": F.floor(F.col("_z") / CELL)})
    b = shapes.select("page", "path", "min_x", "min_z", "max_x", "max_z", F.explode(F.sequence(cell("min_x"), cell("max_x"))).alias("_cx"))
    b = b.withColumn("_cz", F.explode(F.sequence(cell("min_z"), cell("max_z"))))
    inside = F.col("_x").between(F.col("min_x"), F.col("max_x")) & F.col("_z").between(F.col("min_z"), F.col("max_z")) & (F.col("_stroke") != F.col("path"))
    return b.join(s, ["page", "_cx", "_cz"]).where(inside).groupBy("page", "path", "hatch_key").agg(F.count("*").alias("n"))


def nearby_swatches(labels: DataFrame, paths: DataFrame) -> DataFrame:
    """(page, label, swatch, fill, hatch): the nearest small closed path with a fill or a hatch; a fill or hatch brings it nearer, lying on the right sets it back."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z")
    small = paths.where(F.col("closed") & w.between(LEAST_SPAN, MOST_SPAN) & h.between(LEAST_SPAN, MOST_SPAN))
    counted = strokes_inside(small, paths.where("hatch_key is not null")).where(F.col("n") >= SWATCH_STROKES)
    hatch = counted.groupBy("page", "path").agg(F.min(F.struct((-F.col("n")).alias("n"), "hatch_key")).alias("_h")).select("page", "path", F.col("_h.hatch_key").alias("hatch"))
    s = small.join(hatch, ["page", "path"], "left").where("fill_key is not null or hatch is not null")
    s = s.select("page", "path", F.col("fill_key").alias("fill"), "hatch", ((F.col("min_x") + F.col("max_x")) / 2).alias("_x"), ((F.col("min_z") + F.col("max_z")) / 2).alias("_y"))
    s = s.withColumn("_band", F.floor(F.col("_y") / SWATCH_HEIGHT))
    l = labels.where("x is not null and y is not null").select("page", "label", "x", "y", F.explode(_bands("y", SWATCH_HEIGHT)).alias("_band"))
    dx, dy = F.col("_x") - F.col("x"), F.col("_y") - F.col("y")
    far = F.hypot(dx, dy)
    score = far + F.when(dx > 0, 12.0).otherwise(0.0) - F.when(F.col("fill").isNotNull(), 3.0).otherwise(0.0) - F.when(F.col("hatch").isNotNull(), 4.0).otherwise(0.0)
    p = l.join(s, ["page", "_band"]).where((far <= SWATCH_REACH) & (F.abs(dy) <= SWATCH_HEIGHT))
    return p.groupBy("page", "label").agg(F.min(F.struct(score.alias("s"), "path", "fill", "hatch")).alias("_b")).select("page", "label", F.col("_b.path").alias("swatch"), "_b.fill", "_b.hatch")


def legend_entries(labels: DataFrame, texts: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries (page, label, material, confidence, eligible, code..., swatch, fill, hatch, code_ok, fill_ok, hatch_ok) of labels with a code or a swatch.

    ``labels`` (page, label, material, role, confidence, x, y, items), ``texts`` (page, item, text, x, y, size), ``paths`` (page, path, closed, fill_key, hatch_key, box).
    Only surfaces are eligible. A key that stands for several materials on a page is a conflict and not accepted.
    """
    e = labels.join(nearby_codes(labels, texts), ["page", "label"], "left").join(nearby_swatches(labels, paths), ["page", "label"], "left").where("code is not null or swatch is not null")
    both = F.col("code").isNotNull() & (F.col("fill").isNotNull() | F.col("hatch").isNotNull())
    sure = half_up(F.coalesce("confidence", F.lit(0.72)) * F.when(both, 0.98).otherwise(0.94), 3)
    e = e.withColumns({"confidence": sure, "eligible": F.coalesce(F.lower("role"), F.lit("surface")) == "surface"}).drop("role", "items")
    found = e = cut_lineage(e)  # read once for each key below
    for key in ("code", "fill", "hatch"):
        many = found.where(F.col("eligible") & F.col(key).isNotNull()).groupBy("page", key).agg((F.count_distinct("material") > 1).alias("_many"))
        e = e.join(many, ["page", key], "left").withColumn(f"{key}_ok", F.col(key).isNotNull() & ~F.coalesce("_many", F.lit(False))).drop("_many")
    return cut_lineage(e)  # read for each way of use


def _meanings(entries: DataFrame, key: str) -> DataFrame:
    """The most certain accepted entry of each key of a page, ties to the smaller label."""
    e = entries.where(F.col("eligible") & F.col(f"{key}_ok")).groupBy("page", key)
    e = e.agg(F.min(F.struct((-F.col("confidence")).alias("_c"), "label", "material", "code_item", "code_size")).alias("_e"))
    return e.select("page", key, F.col("_e.label").alias("label"), F.col("_e.material").alias("material"), (-F.col("_e._c")).alias("confidence"), "_e.code_item", "_e.code_size")


def legend_observations(entries: DataFrame, texts: DataFrame, paths: DataFrame) -> DataFrame:
    """(page, x, y, material, confidence, source, label): other places of a page where an accepted code stands or an accepted fill or hatch is used.

    A code in letters of less than .45 or more than 2.4 times the legend's is another one. A shape whose fill and hatches mean several materials gives none.
    """
    t = texts.withColumn("code", legend_code(F.col("text"))).where("code is not null and x is not null and y is not null")
    ratio = F.col("size") / F.greatest(F.lit(0.01), F.col("code_size"))
    fits = F.coalesce(ratio.between(0.45, 2.4), F.lit(True))
    c = t.join(_meanings(entries, "code"), ["page", "code"]).where((F.col("item") != F.col("code_item")) & fits)
    codes = c.select("page", "x", "y", "material", F.least(F.lit(0.82), F.col("confidence") * 0.88).alias("confidence"), F.lit("pdf-legend-code-material").alias("source"), "label")

    used = entries.where("swatch is not null").select("page", F.col("swatch").alias("path")).distinct()
    shapes = paths.where("closed").join(used, ["page", "path"], "left_anti")
    fill = shapes.withColumnRenamed("fill_key", "fill").join(_meanings(entries, "fill"), ["page", "fill"])
    fill = fill.select("page", "path", "material", F.least(F.lit(0.8), F.col("confidence") * 0.86).alias("confidence"), F.lit("pdf-legend-fill-material").alias("source"), "label")
    known = _meanings(entries, "hatch").withColumnRenamed("hatch", "hatch_key")
    strokes = paths.where("hatch_key is not null").join(known.select("page", "hatch_key"), ["page", "hatch_key"], "left_semi")
    hatch = strokes_inside(shapes, strokes).where(F.col("n") >= SHAPE_STROKES).join(known, ["page", "hatch_key"])
    hatch = hatch.select("page", "path", "material", F.least(F.lit(0.76), F.col("confidence") * 0.8).alias("confidence"), F.lit("pdf-legend-hatch-material").alias("source"), "label")
    best = fill.unionByName(hatch).groupBy("page", "path").agg(F.count_distinct("material").alias("_n"), F.min(F.struct((-F.col("confidence")).alias("_c"), "source", "label", "material")).alias("_b")).where("_n = 1")
    at = paths.select("page", "path", ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_z") + F.col("max_z")) / 2).alias("y"))
    styles = best.join(at, ["page", "path"]).select("page", "x", "y", F.col("_b.material").alias("material"), (-F.col("_b._c")).alias("confidence"), F.col("_b.source").alias("source"), F.col("_b.label").alias("label"))

    every = codes.unionByName(styles).withColumn("confidence", half_up("confidence", 3))
    first = F.min(F.struct((-F.col("confidence")).alias("_c"), "source", "x", "y", "label")).alias("_b")
    d = every.groupBy("page", "material", half_up("x", 1).alias("_x"), half_up("y", 1).alias("_y")).agg(first)
    return d.select("page", "_b.x", "_b.y", "material", (-F.col("_b._c")).alias("confidence"), "_b.source", "_b.label")
