"""Binary inputs: uncompressed LAS point clouds and plain grids, read through Spark's binaryFile so that any store works."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at which classification lies, by point format; formats from 6 up have their own layout.
_OLD, _NEW = {0, 1, 2, 3}, {6, 7, 8}


def decode_las(data: bytes, bounds: tuple[float, float, float, float] | None = None, skip: int = 1) -> dict[str, np.ndarray]:
    """x, y, z, classification, intensity of a LAS file: formats 0-3 and 6-8, bounds before skipping. Compressed points are refused."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    at, = struct.unpack_from("<I", data, 96)
    kind, size, old = struct.unpack_from("<BHI", data, 104)
    if kind & 0x80 or kind & 0x40:
        raise ValueError("compressed points need a decoder that is not here")
    if kind not in _OLD | _NEW:
        raise ValueError(f"point format {kind}")
    n = struct.unpack_from("<Q", data, 247)[0] if minor >= 4 and not old else old
    scale, offset = np.array(struct.unpack_from("<3d", data, 131)), np.array(struct.unpack_from("<3d", data, 155))
    raw = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * scale + offset
    intensity = np.ascontiguousarray(raw[:, 12:14]).view("<u2")[:, 0]
    cls = raw[:, 15] & 0x1F if kind in _OLD else raw[:, 16]
    keep = np.ones(n, bool)
    if bounds:
        keep = (xyz[:, 0] >= bounds[0]) & (xyz[:, 1] >= bounds[1]) & (xyz[:, 0] <= bounds[2]) & (xyz[:, 1] <= bounds[3])
    at = np.flatnonzero(keep)[:: max(1, skip)]
    return {"x": xyz[at, 0], "y": xyz[at, 1], "z": xyz[at, 2], "classification": cls[at].astype(np.int32), "intensity": intensity[at].astype(np.int32)}


def read_las(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, skip: int = 1) -> DataFrame:
    """(file, x, y, z, classification, intensity): one task per file; only points within bounds leave it."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                got = decode_las(content.as_buffer().to_pybytes(), bounds, skip)
                for k in range(0, len(got["x"]), 50_000):
                    part = {c: pa.array(v[k : k + 50_000]) for c, v in got.items()}
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(part["x"])), **part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, x double, y double, z double, classification int, intensity int")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, gx, gz, x, y, value) of Esri ASCII grids; cells of the no-data value are null."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = content.decode().split()
                head = {words[i].lower(): float(words[i + 1]) for i in range(0, 12, 2) if re.match(r"[A-Za-z]", words[i])}
                w, h, cell = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
                v = np.array(words[2 * len(head) :], float).reshape(h, w)
                v[v == head.get("nodata_value", -9999)] = np.nan
                z, x = np.mgrid[0:h, 0:w]
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * v.size), "gx": pa.array(x.ravel()), "gz": pa.array(z.ravel()), "x": pa.array(head["xllcorner"] + (x.ravel() + 0.5) * cell), "y": pa.array(head["yllcorner"] + (h - z.ravel() - 0.5) * cell), "value": pa.array(v.ravel(), from_pandas=True)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, gx bigint, gz bigint, x double, y double, value double")


def gml_water(docs: DataFrame, text: str) -> DataFrame:
    """(feature_id, kind, ring) of water members in GML: easting and northing pairs of each posList."""
    member = F.regexp_extract_all(text, F.lit(r"(?s)<[\w:]*featureMember[^>]*>(.*?)</[\w:]*featureMember>"), F.lit(1))
    m = docs.select(F.explode(member).alias("m")).where(F.col("m").rlike("(?i)SurfaceWater|TidalWater"))
    numbers = F.transform(F.split(F.trim(F.regexp_extract("m", r"(?s)<[\w:]*posList[^>]*>(.*?)</", 1)), r"\s+"), lambda s: s.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("n", i * 2 + 1).alias("x"), F.element_at("n", i * 2 + 2).alias("z")))
    kind = F.when(F.col("m").rlike("(?i)_Line"), "line").otherwise("area")
    return m.select(F.regexp_extract("m", r'gml:id="([^"]+)"', 1).alias("feature_id"), kind.alias("family"), numbers.alias("n")).where("size(n) >= 4").select("feature_id", "family", pairs.alias("ring"))


def aligned(grids: DataFrame) -> DataFrame:
    """Rasters (file, width, height, origin_x, origin_y, step) that don't share the commonest frame."""
    frame = ["width", "height", "origin_x", "origin_y", "step"]
    best = grids.groupBy(*frame).agg(F.count("*").alias("n"), F.min("file").alias("f")).orderBy(F.desc("n"), "f").limit(1)
    return grids.join(F.broadcast(best.select(*frame)), frame, "left_anti")
