"""Tiled elevation rasters (TIFF): files to tiles, tiles to cells, cells to heights at points.

Files come through Spark's binary reader, so from any store that Spark reads. A first step reads each file's directory and
cuts it into its tiles or strips, still compressed; these are dealt out anew and decoded one by one, so a file's work isn't
one task's. Only the public baseline format is read: one image a file, one band, classic offsets, integer or float samples,
no compression or deflate, no predictor, horizontal differences or the float predictor.

Defined cases: a file that is no such TIFF, or ends early, raises with its path; cells equal to the file's no-data value and
NaN are null; an empty list of files gives no tiles, and Spark passes over files without a byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = "path string, width int, height int, row0 int, col0 int, tile_rows int, tile_cols int, sample string, deflate boolean, predictor int, x0 double, y0 double, dx double, dy double, nodata double, data binary"
CELLS = "path string, row int, col int, x double, y double, value double"
#: Tags of the format and bytes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
DEFLATE = (8, 32946)


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in FIELD:
            continue
        size = struct.calcsize(FIELD[kind]) * count
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place)
    return order, tags


def cut(data: bytes) -> Iterator[tuple]:
    """The tiles of a file, as rows of TILES without the path."""
    order, t = directory(data)
    one = lambda tag, other=None: t[tag][0] if tag in t else other
    if one(BANDS, 1) != 1 or one(COMPRESSION, 1) not in (1, *DEFLATE):
        raise ValueError("one band, without compression or deflated, is read")
    width, height = one(WIDTH), one(HEIGHT)
    sample = order + {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)] + str(one(BITS) // 8)
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    nodata = float(b"".join(t[NODATA]).rstrip(b"\0 ")) if NODATA in t else None
    about = (sample, one(COMPRESSION, 1) in DEFLATE, one(PREDICTOR, 1), tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], nodata)
    if TILE_OFFSETS in t:
        tile_rows, tile_cols, offsets, sizes = one(TILE_HEIGHT), one(TILE_WIDTH), t[TILE_OFFSETS], t[TILE_BYTES]
    else:
        tile_rows, tile_cols, offsets, sizes = min(one(STRIP_ROWS, height), height), width, t[STRIPS], t[STRIP_BYTES]
    across = -(-width // tile_cols)
    for k, (offset, size) in enumerate(zip(offsets, sizes)):
        row0, col0 = k // across * tile_rows, k % across * tile_cols
        if offset + size > len(data):
            raise ValueError(f"tile {k} lies behind the file's end")
        rows = tile_rows if TILE_OFFSETS in t else min(tile_rows, height - row0)  # the last strip is shorter
        yield width, height, row0, col0, rows, tile_cols, *about, data[offset : offset + size]


def samples(tile: dict) -> np.ndarray:
    """The values of a tile, no-data as NaN."""
    raw = zlib.decompress(tile["data"]) if tile["deflate"] else tile["data"]
    rows, cols, kind = tile["tile_rows"], tile["tile_cols"], np.dtype(tile["sample"])
    if tile["predictor"] == 3:  # bytes of a row apart by significance, and their differences
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols)
        values = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols)
    else:
        values = np.frombuffer(raw, kind).reshape(rows, cols)
        if tile["predictor"] == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    out = values.astype(float)
    if tile["nodata"] is not None:
        out[out == tile["nodata"]] = np.nan
    return out


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {c: b.column(c)[k].as_py() for c in b.schema.names}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])


def files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


def tiles(found: DataFrame) -> DataFrame:
    """The tiles of files (path, content), one a row, dealt out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _by_row(batches):
            try:
                for tile in cut(f["content"]):
                    yield _batch([(f["path"], *tile)], TILES)
            except (KeyError, IndexError, struct.error, ValueError) as fault:
                raise ValueError(f"{f['path']}: {fault}") from fault

    return found.select("path", "content").mapInArrow(each, TILES).repartition("path", "row0", "col0")


def cells(found: DataFrame) -> DataFrame:
    """The cells of tiles: path, row, col, the place of their centre, and the value; what lies behind the image's edge goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_row(batches):
            v = samples(t)[: max(0, t["height"] - t["row0"]), : max(0, t["width"] - t["col0"])]
            r, c = (a.ravel() for a in np.indices(v.shape, dtype=np.int32))
            r, c = r + np.int32(t["row0"]), c + np.int32(t["col0"])
            x, y = t["x0"] + (c + 0.5) * t["dx"], t["y0"] - (r + 0.5) * t["dy"]
            yield pa.RecordBatch.from_arrays([pa.array([t["path"]] * len(r), pa.string()), pa.array(r), pa.array(c), pa.array(x), pa.array(y), pa.array(v.ravel(), from_pandas=True)], [k.split()[0] for k in CELLS.split(", ")])

    return found.mapInArrow(each, CELLS)


def merged(found: DataFrame, dx: float, dy: float, least: float = -500.0) -> DataFrame:
    """row, col, value of one grid of all files (row 0 at y = 0, rows going up): values below `least` are 0, of files that
    overlap the largest value counts, nulls only where no file has a value."""
    value = F.when(F.col("value") < least, 0.0).otherwise(F.col("value"))
    return found.groupBy(F.floor(F.col("y") / dy).alias("row"), F.floor(F.col("x") / dx).alias("col")).agg(F.max(value).alias("value"))


def heights(grid: DataFrame, points: DataFrame, dx: float, dy: float, key: str) -> DataFrame:
    """key, z of points (x, y): bilinear between the centres of the four cells around; null where one of them is missing."""
    at = lambda c, d: F.col(c) / d - 0.5
    p = points.select(F.col(key).alias("key"), at("x", dx).alias("u"), at("y", dy).alias("v"))
    p = p.select("key", "u", "v", F.floor("u").alias("c0"), F.floor("v").alias("r0"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("n"))
    share = lambda c, c0, n: F.abs(1 - F.col(n) - (F.col(c) - F.col(c0)))
    p = p.select("key", (F.col("r0") + F.col("n.i")).alias("row"), (F.col("c0") + F.col("n.j")).alias("col"), (share("v", "r0", "n.i") * share("u", "c0", "n.j")).alias("w"))
    z = p.join(grid, ["row", "col"], "left").groupBy("key").agg(F.count("value").alias("n"), F.sum(F.col("value") * F.col("w")).alias("z"))
    return z.select(F.col("key").alias(key), F.when(F.col("n") == 4, F.col("z")).alias("z"))


def encode(values: np.ndarray, tile: int, sample: str = "<f4", deflate: bool = True, predictor: int = 1, origin: tuple[float, float] = (0.0, 0.0), scale: tuple[float, float] = (1.0, 1.0), nodata: float | None = None) -> bytes:
    """A tiled file of a small array; NaN becomes the no-data value."""
    kind = np.dtype(sample)
    order = ">" if sample[0] == ">" else "<"
    rows, cols = values.shape
    full = np.where(np.isnan(values), 0 if nodata is None else nodata, values)
    parts = []
    for r in range(0, rows, tile):
        for c in range(0, cols, tile):
            block = np.zeros((tile, tile))
            piece = full[r : r + tile, c : c + tile]
            block[: piece.shape[0], : piece.shape[1]] = piece
            data = block.astype(kind)
            if predictor == 2:
                data = np.diff(data, axis=1, prepend=np.zeros((tile, 1), kind)).astype(kind)
            raw = data.tobytes()
            if predictor == 3:
                planes = data.astype(kind.newbyteorder(">")).view(np.uint8).reshape(tile, tile, kind.itemsize).transpose(0, 2, 1).reshape(tile, -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((tile, 1), np.uint8)).astype(np.uint8).tobytes()
            parts.append(zlib.compress(raw) if deflate else raw)
    entries = [(WIDTH, "I", [cols]), (HEIGHT, "I", [rows]), (BITS, "H", [kind.itemsize * 8]), (COMPRESSION, "H", [DEFLATE[0] if deflate else 1]), (BANDS, "H", [1]), (PREDICTOR, "H", [predictor]), (TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile])]
    entries += [(TILE_OFFSETS, "I", [0] * len(parts)), (TILE_BYTES, "I", [len(p) for p in parts]), (SAMPLE_FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]]), (PIXEL_SCALE, "d", [*scale, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    if nodata is not None:
        entries.append((NODATA, "c", [bytes([b]) for b in f"{nodata:g}\0".encode()]))
    kinds = {v: k for k, v in FIELD.items()}
    head = 8 + 2 + 12 * len(entries) + 4
    tail = sum(s for _, k, v in entries if (s := struct.calcsize(k) * len(v)) > 4)
    at = head + tail
    for k, p in enumerate(parts):
        entries[8][2][k], at = at, at + len(p)
    out, extra = struct.pack(order + "2sHI", b"MM" if order == ">" else b"II", 42, 8) + struct.pack(order + "H", len(entries)), b""
    for tag, k, v in sorted(entries):
        body = struct.pack(f"{order}{len(v)}{k}", *v)
        out += struct.pack(order + "HHI", tag, kinds[k], len(v)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", head + len(extra)))
        extra += body if len(body) > 4 else b""
    return out + struct.pack(order + "I", 0) + extra + b"".join(parts)
