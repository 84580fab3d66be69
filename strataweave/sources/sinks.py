"""Results as tables and small reports: chunked cells, batches, GeoJSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import floor_div


def write_chunks(cells: DataFrame, path: str) -> None:
    """Cells (x, y, z, phase, block) as files ordered by chunk: range-partitioned on (cx, cz), so that a chunk lies in one file and readers skip the rest."""
    c = cells.withColumns({"cx": floor_div("x", 16), "cz": floor_div("z", 16)})
    c.repartitionByRange("cx", "cz").sortWithinPartitions("cx", "cz", "phase", "y", "z", "x").write.mode("overwrite").parquet(path)


def sub_chunks(cells: DataFrame, palette: DataFrame) -> DataFrame:
    """(cx, sy, cz, cells): 4,096 palette numbers per 16-cube, in the order x, z, y; cells that are not given are -1."""
    if palette.limit(65_537).count() > 65_536:
        raise ValueError("a palette has at most 65,536 entries")
    p = cells.join(F.broadcast(palette), "block")
    at = (F.pmod("x", F.lit(16)) * 16 + F.pmod("z", F.lit(16))) * 16 + F.pmod("y", F.lit(16))
    keyed = p.select(floor_div("x", 16).alias("cx"), floor_div("y", 16).alias("sy"), floor_div("z", 16).alias("cz"), F.struct(at.cast("int").alias("at"), F.col("palette_id").cast("int").alias("id")).alias("c"))
    g = keyed.groupBy("cx", "sy", "cz").agg(F.map_from_entries(F.collect_set("c")).alias("m"))  # at most 4,096 entries
    return g.select("cx", "sy", "cz", F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(-1))).alias("cells"))


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per row of (id, kind, family, parts), keys sorted."""
    pts = F.transform("parts", lambda r: F.transform(r, lambda p: F.array(p["x"], p["z"])))
    kind = F.when(F.col("family") == "area", "Polygon").when(F.col("family") == "line", "MultiLineString").otherwise("MultiPoint")
    coords = F.when(F.col("family") == "point", F.to_json(F.flatten(pts))).otherwise(F.to_json(pts))
    head = F.to_json(F.struct("id", "kind"))
    return features.select(F.concat(F.lit('{"geometry":{"coordinates":'), coords, F.lit(',"type":"'), kind, F.lit('"},"properties":'), head, F.lit(',"type":"Feature"}')).alias("value"))


def batches(df: DataFrame, order: list[str], size: int = 64) -> DataFrame:
    """Rows numbered into batches of ``size`` within their chunk column ``cx``, for add-on parts."""
    from pyspark.sql import Window

    w = Window.partitionBy("cx").orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
