"""Map features from JSON: Overpass elements, GeoJSON collections, point clouds. One schema comes out of all of them.

Geometry is an array of parts of rings or lines of points (lon, lat); ``family`` says point, line or area.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.ladders import PEDESTRIAN, feature_kind

POINT = "struct<lat:double,lon:double>"
ELEMENT = f"type string, id bigint, timestamp string, version int, tags map<string,string>, lat double, lon double, geometry array<{POINT}>, members array<struct<type:string,ref:bigint,role:string,geometry:array<{POINT}>>>"
FEATURE = "id string, name string, kind string, family string, tags map<string,string>, parts array<array<struct<x:double,z:double>>>, provider string, observed_at string, authority_rank int"


def overpass_query(south: float, west: float, north: float, east: float, selectors: list[str], timeout: int = 180) -> str:
    """The bounding box goes into the query: the server prunes."""
    box = f"({south},{west},{north},{east})"
    return f"[out:json][timeout:{timeout}];(" + "".join(f"{s}{box};" for s in selectors) + ");out meta geom;"


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """Elements of Overpass snapshots, one row each."""
    doc = spark.read.schema(f"elements array<struct<{_as_struct(ELEMENT)}>>").json(path, multiLine=True)
    return doc.select(F.explode("elements").alias("e")).select("e.*")


def _as_struct(ddl: str) -> str:
    depth, out, word = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("z")))


def is_area(tags: Column) -> Column:
    t = lambda k: F.try_element_at(tags, F.lit(k))
    yes = F.coalesce(t("building"), t("landuse"), t("leisure"), t("natural"), t("landcover"), t("area:highway"), t("tourism")).isNotNull()
    return F.coalesce(t("area") != "no", F.lit(True)) & (yes | F.coalesce(t("area") == "yes", F.lit(False)))


def stitch(lines: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Joins lines end to end into closed rings; what never closes is left out."""
    todo, rings = [list(x) for x in lines if len(x) > 1], []
    while todo:
        ring = todo.pop(0)
        while ring[0] != ring[-1]:
            for k, other in enumerate(todo):
                if other[0] == ring[-1]:
                    ring += other[1:]
                elif other[-1] == ring[-1]:
                    ring += other[::-1][1:]
                else:
                    continue
                todo.pop(k)
                break
            else:
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring)
    return rings


def assemble(members: list[dict]) -> list[list[tuple[float, float]]]:
    """Rings of a multipolygon: each outer followed by the holes whose smallest containing outer it is."""
    def of(role):
        return stitch([[(p["lon"], p["lat"]) for p in m["geometry"] or []] for m in members if (m["role"] or "outer") == role])

    def area(r):
        p = np.array(r)
        return abs(np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1])) / 2

    def inside(pt, r):
        hit = False
        for (ax, az), (bx, bz) in zip(r, r[1:]):
            if (az > pt[1]) != (bz > pt[1]) and pt[0] < (bx - ax) * (pt[1] - az) / (bz - az) + ax:
                hit = not hit
        return hit

    outers = sorted(of("outer"), key=area)
    holes = {k: [] for k in range(len(outers))}
    for h in of("inner"):
        for k, o in enumerate(outers):
            if inside(h[0], o):
                holes[k].append(h)
                break
    return [r for k, o in enumerate(outers) for r in (o, *holes[k])]


def overpass_features(elements: DataFrame) -> DataFrame:
    """Elements with a kind and a geometry, as features; relations are stitched from their members."""
    def rings(batches):
        for b in batches:
            got = [[[{"x": x, "z": z} for x, z in r] for r in assemble(m or [])] for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("z", pa.float64())]))))], names=["rid", "parts"])

    e = elements.withColumn("kind", feature_kind(F.col("tags"))).where("kind is not null")
    simple = e.where("type != 'relation'")
    closed = (F.size("geometry") > 3) & (F.col("geometry")[0] == F.element_at("geometry", -1)) & is_area(F.col("tags"))
    parts = F.when(F.col("type") == "node", F.array(F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("z"))))).otherwise(F.array(_points(F.col("geometry"))))
    family = F.when(F.col("type") == "node", "point").when(closed, "area").otherwise("line")
    simple = simple.withColumn("parts", parts).withColumn("family", family)
    rel = e.where("type = 'relation'")
    made = rel.select("id", "members").mapInArrow(rings, "rid bigint, parts array<array<struct<x:double,z:double>>>")
    rel = rel.join(made, rel["id"] == made["rid"]).withColumn("family", F.lit("area"))
    cols = [F.concat(F.lit("osm:"), "type", F.lit(":"), "id").alias("id"), F.try_element_at("tags", F.lit("name")).alias("name"), "kind", "family", "tags", "parts", F.lit("OpenStreetMap").alias("provider"), F.col("timestamp").alias("observed_at"), F.lit(100).alias("authority_rank")]
    return simple.select(*cols).unionByName(rel.select(*cols)).where("size(parts) > 0 and size(parts[0]) > 0")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(source map, properties map of strings, geometry_type, coordinates JSON) of FeatureCollections."""
    doc = spark.read.schema("source map<string,string>, features array<struct<id:string,properties:map<string,string>,geometry:string>>").json(path, multiLine=True)
    f = doc.select("source", F.explode("features").alias("f")).select("source", "f.id", "f.properties", F.col("f.geometry").alias("g"))
    return f.select("source", "id", "properties", F.get_json_object("g", "$.type").alias("geometry_type"), F.get_json_object("g", "$.coordinates").alias("coordinates"))


def geojson_parts(kind: Column, coordinates: Column) -> Column:
    """Parts from coordinates JSON; types other than the five known ones give null."""
    pt = lambda p: F.struct(p[0].alias("x"), p[1].alias("z"))
    line = lambda c: F.transform(c, pt)
    j = lambda s: F.from_json(coordinates, s)
    return (
        F.when(kind == "Point", F.array(F.array(pt(j("array<double>")))))
        .when(kind == "LineString", F.array(line(j("array<array<double>>"))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(j("array<array<array<double>>>"), line))
        .when(kind == "MultiPolygon", F.transform(F.flatten(j("array<array<array<array<double>>>>")), line))
    )


def geojson_family(kind: Column) -> Column:
    return F.when(kind.contains("Polygon"), "area").when(kind.contains("Line"), "line").when(kind == "Point", "point")


def overture_kind(theme: Column, kind: Column, subtype: Column, cls: Column, geometry: Column) -> Column:
    """Kind of an Overture row; null where it has none."""
    cover = F.coalesce(F.nullif(cls, F.lit("")), F.nullif(subtype, F.lit("")), kind)
    moving = (F.coalesce(theme == "transportation", F.lit(False)) | F.coalesce(kind == "segment", F.lit(False))) & (geometry == "LineString")
    land = kind.isin("land", "land_cover", "land_use")
    return (
        F.when(moving & (subtype == "road"), F.when(cls.isin(*PEDESTRIAN), "path").otherwise("road")).when(moving & subtype.isin("rail", "water"), subtype)
        .when((theme == "buildings") | (kind == "building"), "building").when((theme == "base") & (kind == "water"), "water")
        .when((theme == "base") & land, F.when(cover.isin("forest", "wood", "trees", "tree_cover", "scrub", "shrubs", "orchard"), "vegetation").otherwise("surface"))
        .when((theme == "base") & (kind == "infrastructure"), "structure").when((theme == "places") | (kind == "place"), "amenity")
    )


def portable_kind(p: Column, geometry: Column) -> Column:
    """Kind of a public observation: its own word first, then an order that differs from that of map features."""
    t = lambda k: F.try_element_at(p, F.lit(k))
    isin = lambda k, *vs: F.coalesce(t(k).isin(*vs), F.lit(False))
    return (
        F.when(t("kind").isNotNull(), t("kind")).when(isin("roller_coaster", "track"), "ride_track").when(isin("roller_coaster", "support"), "ride_support").when(t("building").isNotNull(), "building")
        .when(isin("natural", "rock", "stone", "boulder", "cliff") | isin("geological", "outcrop", "boulder"), "terrain_detail")
        .when(isin("barrier", "hedge") | isin("natural", "tree", "tree_row", "wood", "scrub", "shrub", "bush") | isin("landuse", "forest", "orchard", "vineyard", "plant_nursery") | isin("landcover", "trees", "tree_cover", "shrubs", "scrub"), "vegetation")
        .when(t("highway").isNotNull(), F.when(t("highway").isin(*PEDESTRIAN), "path").otherwise("road"))
        .when(isin("natural", "water") | t("water").isNotNull() | t("waterway").isNotNull(), "water")
        .when(t("landuse").isNotNull() | t("landcover").isNotNull() | (geometry.contains("Polygon") & t("natural").isNotNull()), "surface")
        .when(t("barrier").isNotNull(), "barrier").when(t("man_made").isNotNull(), "structure")
    )


def public_features(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, rejects): provider, address and licence are mandatory, the feature's own before the collection's; every reject has its reason."""
    own = lambda k, c: F.coalesce(F.try_element_at("properties", F.lit(k)), F.try_element_at("source", F.lit(c)))
    d = raw.withColumns({"provider": own("source_name", "name"), "source_url": own("source_url", "url"), "license": own("license", "license"), "kind": portable_kind(F.col("properties"), F.col("geometry_type")), "parts": geojson_parts(F.col("geometry_type"), F.col("coordinates"))})
    reason = F.when(F.col("provider").isNull(), "missing-provider").when(F.col("source_url").isNull(), "missing-source-url").when(F.col("license").isNull(), "missing-license").when(F.col("parts").isNull(), "unsupported-geometry").when(F.col("kind").isNull(), "unclassified")
    d = d.withColumn("reason", reason).withColumn("family", geojson_family(F.col("geometry_type")))
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame:
    """(crs, x, y, z, classification, intensity) from JSON point clouds."""
    doc = spark.read.schema("crs string, points array<array<double>>").json(path, multiLine=True)
    p = doc.select("crs", F.explode("points").alias("p"))
    return p.select("crs", *[F.try_element_at("p", F.lit(i + 1)).alias(n) for i, n in enumerate(("x", "y", "z", "classification", "intensity"))])


def manifest_observations(spark: SparkSession, path: str) -> DataFrame:
    """Planning observations of manifests with ``applications``: one row per feature with its application, operation and target."""
    feature = "struct<id:string,properties:map<string,string>,geometry:string>"
    doc = spark.read.schema(f"applications array<struct<reference:string,source_url:string,license:string,features:array<{feature}>>>, features array<{feature}>").json(path, multiLine=True)
    apps = doc.select(F.explode(F.coalesce("applications", F.array(F.struct(F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("license"), F.col("features"))))).alias("a"))
    f = apps.select("a.reference", "a.source_url", "a.license", F.explode_outer("a.features").alias("f"))
    prop = lambda k: F.try_element_at("f.properties", F.lit(k))
    return f.select("reference", "source_url", "license", F.col("f.id").alias("id"), F.coalesce(prop("operation"), F.lit("auto")).alias("operation"), prop("target").alias("target"), prop("kind").alias("kind"), F.get_json_object("f.geometry", "$.type").alias("geometry_type"), F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"))
