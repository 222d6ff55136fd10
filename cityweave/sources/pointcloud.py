"""Point clouds of 26-byte records (LAS point format 2) as a partitioned data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER, RECORD = 227, 26
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])


@dataclass
class Header:
    offset: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    #: Whole records that the file really holds.
    present: int

    @property
    def partial(self) -> bool:
        return self.present < self.count


def read_header(data: bytes, size: int) -> Header:
    """Header of the first 227 bytes; only point format 2 with 26-byte records is taken."""
    if data[:4] != b"LASF" or len(data) < HEADER:
        raise ValueError("no LAS file")
    offset, = struct.unpack_from("<I", data, 96)
    kind, length, count = struct.unpack_from("<BHI", data, 104)
    if kind & 0x3F != 2 or length != RECORD:
        raise ValueError(f"point format {kind & 0x3F} with {length} bytes isn't supported")
    v = struct.unpack_from("<12d", data, 131)
    return Header(offset, count, v[0:3], v[3:6], (v[7], v[9], v[11]), (v[6], v[8], v[10]), max(0, (size - offset) // RECORD))


def write_header(h: Header) -> bytes:
    out = bytearray(HEADER)
    out[:4], out[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HIIBHI", out, 94, HEADER, h.offset, 0, 2, RECORD, h.count)
    struct.pack_into("<12d", out, 131, *h.scale, *h.shift, h.high[0], h.low[0], h.high[1], h.low[1], h.high[2], h.low[2])
    return bytes(out)


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int


def _opened(path: str) -> pa.NativeFile:
    """A file by its URI, in any file system that Arrow knows; a bare path is a local one."""
    system, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


class PointReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.each = options["path"], int(options.get("chunkpoints", 2_000_000))
        with _opened(self.path) as f:
            self.header = read_header(f.read(HEADER), f.size())

    def partitions(self) -> list[Span]:
        n = min(self.header.count, self.header.present)
        return [Span(self.path, a, min(n, a + self.each)) for a in range(0, n, self.each)] or [Span(self.path, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        h = self.header
        with _opened(span.path) as f:
            f.seek(h.offset + span.start * RECORD)
            left = span.stop - span.start
            while left > 0:
                data = f.read(min(left, 1 << 16) * RECORD)
                p = np.frombuffer(data[: len(data) // RECORD * RECORD], POINT)
                if not len(p):
                    return  # the file got shorter
                left -= len(p)
                xyz = [pa.array(p[k] * h.scale[j] + h.shift[j]) for j, k in enumerate("xyz")]
                yield pa.RecordBatch.from_arrays([*xyz, *(pa.array(p[k].astype(np.int32)) for k in ("red", "green", "blue"))], ["x", "y", "z", "red", "green", "blue"])


class PointCloud(DataSource):
    """spark.read.format("pointcloud").load(path); the path is a URI that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "pointcloud"

    def schema(self) -> str:
        return "x double, y double, z double, red int, green int, blue int"

    def reader(self, schema) -> PointReader:
        return PointReader(self.options)


def read_points(spark: SparkSession, path: str, chunk: int = 2_000_000) -> DataFrame:
    spark.dataSource.register(PointCloud)
    return spark.read.format("pointcloud").option("chunkpoints", chunk).load(path)


def points_bytes(points: np.ndarray, header: Header) -> bytes:
    """Records of real coordinates (rows of x, y, z, red, green, blue)."""
    p = np.zeros(len(points), POINT)
    for j, k in enumerate("xyz"):
        p[k] = np.rint((points[:, j] - header.shift[j]) / header.scale[j])
    for j, k in enumerate(("red", "green", "blue")):
        p[k] = points[:, 3 + j]
    return p.tobytes()


def write_points(points: DataFrame, path: str, scale: tuple[float, float, float], shift: tuple[float, float, float]) -> None:
    """One file of points (x, y, z, red, green, blue): tasks make the records, the driver hands them on, a partition at a time."""
    from pyspark.sql import functions as F

    from cityweave.sources.sinks import write_parts

    names = ["x", "y", "z", "red", "green", "blue"]
    ends = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max)))).first()
    h = Header(HEADER, ends.n, scale, shift, *(tuple(float(ends[f"{k}{c}"] or 0.0) for c in "xyz") for k in ("lo", "hi")), ends.n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([points_bytes(rows, h)], pa.binary())], ["data"])

    parts = points.select(*names).mapInArrow(each, "data binary")
    write_parts(points.sparkSession, path, [write_header(h)], parts)


def cell_floor(points: DataFrame, minx: float, maxy: float, res: float, above: float = 0.30) -> DataFrame:
    """Per cell the least and greatest height, points, mean colour (8 bits), and the points within `above` of the floor."""
    from pyspark.sql import functions as F

    from cityweave.functions.raster import cell

    c, r = cell(F.col("x"), F.col("y"), minx, maxy, res)
    p = points.withColumn("row", r).withColumn("col", c)
    low = p.groupBy("row", "col").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.count("*").alias("n"), *(F.avg(F.col(k) / 256).alias(k) for k in ("red", "green", "blue")))
    near = p.join(low.select("row", "col", "zmin"), ["row", "col"]).where(F.col("z") <= F.col("zmin") + above).groupBy("row", "col").agg(F.count("*").alias("floor_points"))
    return low.join(near, ["row", "col"])
