"""Writers: text grids, network XML, documents, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators.network import has_reverse


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver, written beside its place and renamed, by the file system that owns the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to, tmp = hadoop(path), hadoop(path + ".tmp")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(tmp, to):
        raise OSError(f"can't rename to {path}")


def write_parts(spark: SparkSession, path: str, head: list[bytes], parts: DataFrame) -> None:
    """One file of a head and the parts' bytes (one column), of which the driver holds one partition at a time."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to, tmp = hadoop(path), hadoop(path + ".tmp")
    system = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(tmp, True)
    try:
        for data in head:
            out.write(bytearray(data))
        for row in parts.toLocalIterator():
            out.write(bytearray(row[0]))
    finally:
        out.close()
    system.delete(to, False)
    if not system.rename(tmp, to):
        raise OSError(f"can't rename to {path}")


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, indent=1, sort_keys=True, default=float))


def grid_rows(cells: DataFrame, layer: str, width: int, nodata: float = -9999.0) -> DataFrame:
    """row, line: one text line for each row of a grid, gaps and nulls as nodata, three decimals."""
    m = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce(layer, F.lit(nodata)).alias("v")))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.format_string("%.3f", F.coalesce(F.try_element_at("m", c.cast(dict(cells.dtypes)["col"])), F.lit(nodata))))
    return m.select("row", F.concat_ws(" ", values).alias("line"))


def write_ascii_grid(cells: DataFrame, layer: str, header: dict[str, float], path: str, nodata: float = -9999.0) -> None:
    """A text grid of one file; meant for grids that fit the driver (the format has no parts)."""
    lines = grid_rows(cells, layer, int(header["ncols"]), nodata).orderBy("row").select("line")
    head = "".join(f"{k} {header[k]:g}\n" for k in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize")) + f"NODATA_value {nodata:g}\n"
    write_text(cells.sparkSession, path, head + "".join(r.line + "\n" for r in lines.toLocalIterator()))


def edge_elements(edges: DataFrame) -> DataFrame:
    """Attributes of network edges for XML: lanes are shared between both directions where the reverse exists and neither is one-way."""
    e = has_reverse(edges)
    lanes = F.when(F.col("has_reverse") & ~F.col("oneway"), F.greatest(F.lit(1), F.floor(F.col("lanes") / 2))).otherwise(F.greatest(F.lit(1), F.col("lanes")))
    return e.select(F.col("edge_id").alias("_id"), F.col("u").alias("_from"), F.col("v").alias("_to"), lanes.cast("int").alias("_numLanes"), F.round("speed_ms", 2).alias("_speed"))


def write_xml(elements: DataFrame, path: str, root: str, row: str) -> None:
    elements.write.format("xml").options(rootTag=root, rowTag=row, declaration="").save(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table of at most `limit` rows."""
    rows = [["" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
