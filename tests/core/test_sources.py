import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from strataweave.sources import geo, web

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def geom(points):
    return [{"lat": float(z), "lon": float(x)} for x, z in points]


def test_overpass_features(spark, tmp_path):
    half = len(SQUARE) // 2 + 1
    doc = {"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"natural": "tree"}}, {"type": "way", "id": 2, "tags": {"building": "yes", "name": "Hall"}, "geometry": geom(SQUARE)},
        {"type": "way", "id": 3, "tags": {"highway": "footway"}, "geometry": geom(SQUARE[:3])}, {"type": "way", "id": 4, "tags": {"note": "none"}, "geometry": geom(SQUARE)},
        {"type": "relation", "id": 5, "tags": {"natural": "water"}, "members": [{"type": "way", "ref": 7, "role": "outer", "geometry": geom(SQUARE[:half])}, {"type": "way", "ref": 8, "role": "outer", "geometry": geom(SQUARE[half - 1 :])}, {"type": "way", "ref": 9, "role": "inner", "geometry": geom([(2, 2), (4, 2), (4, 4), (2, 2)])}]}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    got = {r.id: r for r in geo.overpass_features(geo.read_overpass(spark, str(tmp_path / "o.json"))).collect()}
    assert {k: (r.kind, r.family, len(r.parts)) for k, r in got.items()} == {"osm:node:1": ("vegetation", "point", 1), "osm:way:2": ("building", "area", 1), "osm:way:3": ("path", "line", 1), "osm:relation:5": ("water", "area", 2)}
    assert got["osm:way:2"].name == "Hall"


def test_public_features_fail_closed(spark, tmp_path):
    fc = {"source": {"name": "Survey", "url": "https://example.org"}, "features": [
        {"properties": {"kind": "path", "license": "CC0"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}}, {"properties": {"building": "yes"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
        {"properties": {"license": "CC0", "x": "y"}, "geometry": {"type": "Point", "coordinates": [0, 0]}}, {"properties": {"license": "CC0", "kind": "path"}, "geometry": {"type": "GeometryCollection"}}]}
    (tmp_path / "p.json").write_text(json.dumps(fc))
    ok, bad = geo.public_features(geo.read_geojson(spark, str(tmp_path / "p.json")))
    assert [(r.kind, r.family, len(r.parts[0])) for r in ok.collect()] == [("path", "line", 2)]
    assert sorted(r.reason for r in bad.collect()) == ["missing-license", "unclassified", "unsupported-geometry"]


def test_manifest_and_points(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"applications": [{"reference": "A/1", "features": [{"id": "f", "properties": {"operation": "delete", "target": "t"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}, {"reference": "A/2", "features": []}]}))
    got = [(r.reference, r.id, r.operation, r.target) for r in geo.manifest_observations(spark, str(tmp_path / "m.json")).orderBy("reference").collect()]
    assert got == [("A/1", "f", "delete", "t"), ("A/2", None, "auto", None)]
    (tmp_path / "c.json").write_text(json.dumps({"crs": "EPSG:27700", "points": [[1, 2, 3, 2, 9], [4, 5, 6]]}))
    assert [tuple(r) for r in geo.read_point_cloud(spark, str(tmp_path / "c.json")).collect()] == [("EPSG:27700", 1, 2, 3, 2, 9), ("EPSG:27700", 4, 5, 6, None, None)]


def test_links(spark):
    html = """<a href="/a b.pdf#x">Site <b>plan</b></a><a class=q href='doc?id=1&amp;k=2'>Download</a><A HREF=//cdn.example.org/z>z</A><a href="mailto:x@y">m</a><a href="#top">t</a><a href="http://127.0.0.1/x">l</a>"""
    pages = spark.createDataFrame([(1, "https://example.org/dir/page?q=1", html), (2, None, None)], "page_id int, url string, html string")
    links = web.page_links(pages)
    assert sorted((r.url, r.label) for r in links.collect()) == [("http://127.0.0.1/x", "l"), ("https://cdn.example.org/z", "z"), ("https://example.org/a b.pdf", "Site plan"), ("https://example.org/dir/doc?id=1&k=2", "Download")]
    docs = {r.url: (r.classification, r.direct) for r in web.document_links(links).collect()}
    assert docs == {"https://example.org/a b.pdf": ("site-plan", True), "https://cdn.example.org/z": ("unknown", False), "https://example.org/dir/doc?id=1&k=2": ("unknown", True)}
    q = web.queue_items(web.document_links(links).withColumn("app", F.lit("A1")), "app")
    assert q.union(q).dropDuplicates(["item_id"]).count() == 3 and all(0 <= r.shard < 256 for r in q.collect())
    rows = web.table_rows(spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr><td>x &amp; y</td><td>2</td></tr></table>")], "i int, h string"), "i", "h")
    assert [r.cells for r in rows.orderBy("row").collect()] == [["A"], ["x & y", "2"]]


def test_archives(spark):
    cdx = [["timestamp", "original", "statuscode"], ["20200102030405", "https://example.org/", "200"], ["2020", "https://example.org/", "200"], ["20200102030405", "http://localhost/", "200"], ["short"]]
    got = web.cdx_captures(spark.createDataFrame([(json.dumps(cdx),), ("nonsense",)], "j string"), "j").collect()
    assert [(r.replay_url, r.captured_at) for r in got] == [("https://web.archive.org/web/20200102030405id_/https://example.org/", dt.datetime(2020, 1, 2, 3, 4, 5))]
    ok = {"url": "https://example.org/", "timestamp": "1", "status": "200", "filename": "crawl-data/x.warc.gz", "offset": "5", "length": "7"}
    lines = [json.dumps(x) for x in (ok, {**ok, "status": "404"}, {**ok, "filename": "x"}, {**ok, "offset": "-1"})] + ["{"]
    got = web.crawl_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.offset, r.length) for r in got] == [(5, 7)]


def test_drawing_text(spark):
    df = spark.createDataFrame([(1, "SCALE 1:500 Drawing No: AB-12 Rev: C Status: As Built"), (2, "scale 1:100 scale 1:200"), (3, "FFL 101.5 RIDGE: 110 99.25m AOD FFL 101.5"), (4, "height 12 m width 900 m pitch 35 deg RAL 7016 gradient 5% dia 150 mm")], "i int, t string")
    t = {r.i: r.b for r in df.withColumn("b", web.title_block(F.col("t"))).collect()}
    assert (t[1].scale, t[1].drawing_number, t[1].revision, t[1].status) == (500, "AB-12", "C", "as built") and t[2].scale is None and t[2].scale_ambiguous
    lv = sorted((r.label, r.value_m, r.confidence) for r in web.levels(df.where("i = 3"), "t", ["i"]).collect())
    assert lv == [("AOD", 99.25, 0.82), ("FFL", 101.5, 0.9), ("RIDGE", 110.0, 0.9)]
    a = df.where("i = 4").select(web.object_attributes(F.col("t")).alias("a")).first().a
    assert (a.height_m, a.width_m, a.pitch_deg, a.ral, a.gradient_percent, a.diameter_mm) == (12, None, 35, 7016, 5, 150)
    rules = spark.createDataFrame([(1, "red_asphalt", r"\bred asphalt\b", 0.92, ["asphalt"]), (2, "asphalt", r"\basphalt\b", 0.8, []), (3, "brick", r"\bbricks?\b", 0.8, [])], "rule_no int, name string, pattern string, confidence double, suppresses array<string>")
    m = web.rule_matches(spark.createDataFrame([(1, "Red asphalt and bricks"), (2, "asphalt")], "i int, t string"), "i", "t", rules)
    assert sorted((r.i, r.name, r.best) for r in m.collect()) == [(1, "brick", False), (1, "red_asphalt", True), (2, "asphalt", True)]


def test_container(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    web.write_container(df, str(tmp_path / "c"), "k")
    assert web.read_container(spark, str(tmp_path / "c"), "k string, v int", "k").count() == 3
    df.limit(2).write.mode("overwrite").option("compression", "gzip").json(str(tmp_path / "c/rows"))
    with pytest.raises(ValueError):
        web.read_container(spark, str(tmp_path / "c"), "k string, v int", "k")


def test_streaming_changes(spark, tmp_path):
    from strataweave.streaming import crawl

    schema = "url string, content_hash string, seen_at timestamp, status int"
    rows = [("u", "h1", dt.datetime(2024, 1, 1, h), 200) for h in (1, 2)] + [("u", "h2", dt.datetime(2024, 1, 1, 3), 200), ("v", "h9", dt.datetime(2024, 1, 1, 3), 404)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("changes", crawl.content_changes(src)), ("fresh", crawl.fresh_captures(src))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.previous_hash, r.content_hash) for r in spark.table("changes").collect()] == [("h1", "h2")]
    assert spark.table("fresh").count() == 3
