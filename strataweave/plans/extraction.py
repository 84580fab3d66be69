"""The extraction chain of drawings: class, legend, texts and objects, then what is kept.

Pages, texts and paths come in as tables (decoding them is another program's work), in page space. Learned templates of ride supports are not part of this chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.core.session import cut_lineage
from strataweave.functions import vocabulary as V
from strataweave.operators.details import reclassify
from strataweave.operators.legend import legend_entries, legend_observations
from strataweave.sources import web

# Classes of the queue under the names that the extractor uses; others only change their dashes.
ALIASES = {"landscape": "landscape_plan", "demolition": "demolition_plan"}


def _strongest(m: DataFrame) -> DataFrame:
    """Of the runs of texts that name one material and share an item the most certain stays, then the longer, then the left one."""
    rank = F.struct("confidence", "n", -F.coalesce("x", F.lit(0.0)), -F.col("first"))
    d = m.withColumn("_rank", rank).withColumn("_item", F.explode("items"))
    d = d.withColumn("_top", F.col("_rank") == F.max("_rank").over(Window.partitionBy("page", "material", "_item")))
    beaten = d.where("not _top").select("page", "material", "first", "n").distinct()
    return m.join(beaten, ["page", "material", "first", "n"], "left_anti")


def extract(pages: DataFrame, texts: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, evidence): a summary row a page, and the normalised evidence of all pages, each once, without raw texts and paths.

    ``pages`` (page, class, title, images), ``texts`` (page, item, text, x, y, size, width), ``paths`` (page, path, closed, meaningful, fill_key, hatch_key, box).
    Evidence is (page, kind, name, value, confidence, x, y, source); kinds: material, legend, level, object. A page without texts and paths stays, with zeros.
    """
    body = texts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda t: t["text"]), " ").alias("body"), F.sum(F.length("text")).alias("characters"))
    drawn = paths.groupBy("page").agg(F.count("*").alias("vectors"), F.count_if("meaningful").alias("meaningful"))
    named = F.lower(F.trim(F.coalesce("class", F.lit("unknown"))))
    known = F.replace(named, F.lit("-"), F.lit("_"))
    for old, new in ALIASES.items():
        known = F.when(named == old, new).otherwise(known)
    p = pages.join(body, "page", "left").join(drawn, "page", "left").withColumn("_r", reclassify(known, F.col("title"), F.col("body")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    p = p.select("page", F.col("_r.classification").alias("class"), web.title_block(F.coalesce("body", F.lit(""))).alias("title_block"), zero("characters"), zero("vectors"), zero("meaningful"), zero("images"))
    p = p.withColumn("raster_fallback", web.raster_fallback(F.col("class"), F.col("characters"), F.col("vectors"), F.col("meaningful"), F.col("images")))

    windows = V.text_windows(texts.where("text is not null"), ["page"], with_items=True)
    m = windows.select("page", "first", "n", "x", "y", "items", "factor", F.explode(V.materials(F.col("raw"))).alias("m"))
    m = _strongest(m.select("page", "first", "n", "x", "y", "items", "m.material", "m.role", (F.col("m.confidence") * F.col("factor")).alias("confidence")))
    m = cut_lineage(m.withColumn("label", F.concat_ws("|", F.col("first").cast("string"), F.col("n").cast("string"), "material")).drop("first", "n"))
    entries = legend_entries(m, texts.select("page", "item", "text", "x", "y", "size"), paths)
    learned = legend_observations(entries, texts.select("page", "item", "text", "x", "y", "size"), paths)

    none = F.lit(None).cast("double")
    row = lambda kind, name, value, sure, source, x="x", y="y": ("page", F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), sure.alias("confidence"), F.col(x).alias("x"), F.col(y).alias("y"), source.alias("source"))
    direct = m.select(*row("material", F.col("material"), none, F.col("confidence"), F.lit("pdf-text-material")))
    inferred = learned.select(*row("legend", F.col("material"), none, F.col("confidence"), F.col("source")))
    levels = web.levels(texts.where("text is not null"), "text", ["page", "x", "y"]).select(*row("level", F.col("label"), F.col("value_m"), F.col("confidence"), F.lit("pdf-text-level")))
    objects = texts.select("page", "x", "y", V.object_class(F.coalesce("text", F.lit(""))).alias("o")).where("o is not null").select(*row("object", F.col("o.object_type"), none, F.col("o.confidence"), F.lit("pdf-text-object")))
    evidence = direct.unionByName(inferred).unionByName(levels).unionByName(objects)

    n = evidence.groupBy("page").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("material", "legend", "level", "object")])
    p = p.join(n, "page", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("materials", "legends", "levels", "objects")})
    return p.withColumn("status", F.when(F.col("raster_fallback").isNotNull(), "raster-fallback-required").otherwise("extracted")), evidence
