import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.plans import build
from strataweave.sources import binary, paging, sinks

FEATURE = "id string, kind string, family string, parts array<array<struct<x:double,z:double>>>"


def box(x, z, s=4.0):
    return [[(x, z), (x + s, z), (x + s, z + s), (x, z + s), (x, z)]]


def test_fuse(spark):
    base = spark.createDataFrame([("a", "building", "area", box(0.0, 0.0)), ("b", "water", "area", box(50.0, 0.0))], FEATURE)
    gap = spark.createDataFrame([("g1", "building", "area", box(1.0, 1.0)), ("g2", "water", "area", box(0.0, 0.0)), ("g3", "building", "area", box(100.0, 0.0)), ("g4", "building", "area", box(101.0, 0.0))], FEATURE)
    public = spark.createDataFrame([("p", "path", "area", box(9.0, 9.0))], FEATURE)
    over = spark.createDataFrame([("o", "building", "area", box(0.0, 0.0), "a"), ("o2", "path", "area", box(0.0, 0.0), None)], FEATURE + ", replaces string")
    assert sorted(r.id for r in build.fuse(base, gap, public, over).collect()) == ["b", "g2", "g3", "o", "o2", "p"]


def test_evidence_graph(spark):
    f = spark.createDataFrame([("f1", "building", "completed", "osm"), ("f2", "water", None, "planning")], "id string, kind string, status string, layer string")
    o = spark.createDataFrame([("f1", "height", 9.0, "r1", 400.0, 1.0, 1.0, "2024-01-01", 0.25), ("f1", "height", 15.0, "r2", 380.0, 1.0, 1.0, "2024-01-01", 0.25), ("f1", "geometry", 1.0, "r3", 100.0, 0.7, 0.7, None, None)], "id string, attribute string, value double, ref string, rank double, directness double, confidence double, observed_at string, resolution_m double")
    res, gaps = build.evidence_graph(f, o, "2024-06-01")
    got = {(r.entity, r.attribute): (r.value, r.conflict, r.n_alternatives) for r in res.collect()}
    assert got == {("f1", "height"): (9.0, True, 1), ("f1", "geometry"): (1.0, False, 0)}
    assert {(r.entity, r.attribute, r.status) for r in gaps.collect()} == {("f1", "geometry", "low-confidence"), ("f1", "roof", "missing"), ("f1", "material", "missing"), ("f2", "geometry", "missing")}


def las(points, kind=0):
    size = {0: 20, 6: 30}[kind]
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4 if kind == 6 else 2))
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<BHI", head, 104, kind, size, 0 if kind == 6 else len(points))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    struct.pack_into("<Q", head, 247, len(points))
    body = b""
    for x, y, z, c, i in points:
        r = bytearray(size)
        struct.pack_into("<3iH", r, 0, round((x - 100) * 100), round((y - 200) * 100), round(z * 100), i)
        r[15 if kind == 0 else 16] = c
        body += bytes(r)
    return bytes(head) + body


@pytest.mark.parametrize("kind", [0, 6])
def test_las(spark, tmp_path, kind):
    pts = [(100.0 + k, 200.0 + k, k / 2, k % 5, k * 10) for k in range(20)]
    (tmp_path / "a.las").write_bytes(las(pts, kind))
    got = binary.read_las(spark, str(tmp_path / "a.las"), (103, 203, 110, 210)).orderBy("x").collect()
    assert [(round(r.x, 6), round(r.y, 6), r.z, r.classification, r.intensity) for r in got] == pts[3:11]
    assert len(binary.decode_las(las(pts, kind), skip=3)["x"]) == 7
    with pytest.raises(ValueError):
        binary.decode_las(las(pts, kind)[:104] + b"\x83" + las(pts, kind)[105:])


def test_grid_and_gml(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    got = {(r.gx, r.gz): (r.x, r.y, r.value) for r in binary.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert got[0, 0] == (11, 23, 1) and got[1, 1] == (13, 21, None) and len(got) == 6
    gml = '<os:featureMember><os:SurfaceWater_Area gml:id="w1"><gml:posList>1 2 3 4 5 6</gml:posList></os:SurfaceWater_Area></os:featureMember><os:featureMember><os:Road gml:id="r"><gml:posList>1 2 3 4</gml:posList></os:Road></os:featureMember>'
    rows = binary.gml_water(spark.createDataFrame([(gml,)], "t string"), "t").collect()
    assert [(r.feature_id, r.family, [(p.x, p.z) for p in r.ring]) for r in rows] == [("w1", "area", [(1, 2), (3, 4), (5, 6)])]
    grids = spark.createDataFrame([("a", 9, 9, 0.0, 0.0, 1.0), ("b", 9, 9, 0.0, 0.0, 1.0), ("c", 9, 9, 0.5, 0.0, 1.0)], "file string, width int, height int, origin_x double, origin_y double, step double")
    assert [r.file for r in binary.aligned(grids).collect()] == ["c"]


def test_paging(spark):
    def fetch(offset, limit):
        return [{"id": k, "name": f"n{k}", "extra": {"k": k}} for k in range(offset, min(offset + limit, 25))]

    spark.dataSource.register(paging.paged_source("paged_rows", "id int, name string, extra string", fetch, 10))
    df = spark.read.format("paged_rows").option("total", 25).load()
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.sum("id"), F.count("*")).first()[:] == (300, 25)
    assert paging.count_by_paging(fetch, 10) == 25
    waits, tries = [], []

    class Busy(Exception):
        status = 429

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "ok"

    assert paging.with_retries(call, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    z, tiles = paging.tile_plan(51.0, -2.0, 51.1, -1.9, 16, 40)
    assert z < 16 and 0 < len(tiles) <= 40


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(x, 3, z, 0, "stone" if x < 0 else "grass") for x in range(-20, 20) for z in range(0, 16)], "x int, y int, z int, phase int, block string")
    sinks.write_chunks(cells, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 640 and back.select("cx", "cz").distinct().count() == 4
    assert back.withColumn("f", F.input_file_name()).groupBy("cx", "cz").agg(F.count_distinct("f").alias("n")).where("n > 1").count() == 0
    pal = spark.createDataFrame([("stone", 0), ("grass", 1)], "block string, palette_id int")
    subs = {(r.cx, r.sy, r.cz): np.array(r.cells).reshape(16, 16, 16) for r in sinks.sub_chunks(cells, pal).collect()}
    assert set(subs) == {(-2, 0, 0), (-1, 0, 0), (0, 0, 0), (1, 0, 0)} and (subs[-1, 0, 0][:, :, 3] == 0).all() and (subs[-1, 0, 0][:, :, 4] == -1).all() and (subs[0, 0, 0][:, :, 3] == 1).all()
    line = sinks.geojson_lines(spark.createDataFrame([("a", "path", "line", [[(0.0, 1.0), (2.0, 3.0)]])], FEATURE)).first()[0]
    import json

    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]]]}, "properties": {"id": "a", "kind": "path"}}
