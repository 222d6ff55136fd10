"""Readers of transit, raster and series files, and of map features, as DataFrames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityweave.functions import parse

#: Seconds of a time unit's name.
UNITS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}


def transit_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A timetable file of a folder or a .zip, all columns text; a missing file gives no rows and no columns but `missing`."""
    if root.endswith(".zip"):
        files = spark.read.format("binaryFile").load(root).select("content")

        def lines(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for data in b.column("content").to_pylist():
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for member in sorted(z.namelist()):
                            if member == name or member.endswith("/" + name):
                                text = z.read(member).decode("utf-8-sig").splitlines()
                                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["value"])
                                break

        text = files.mapInArrow(lines, "value string")
        head = text.first()
        if head is None:
            return spark.createDataFrame([], "missing string")
        names = [c.strip() for c in head.value.split(",")]
        row = F.from_csv("value", ", ".join(f"`{c}` string" for c in names))
        return text.where(F.col("value") != head.value).select(row.alias("r")).select("r.*")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "missing string")
    t = spark.read.csv(f"{root}/{name}", header=True, inferSchema=False, encoding="UTF-8")
    return t.toDF(*(c.lstrip("﻿").strip() for c in t.columns))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n, value: the lines of one text file in order. The file is read as one row."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "value"))


def ascii_grid(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """(header, cells) of a text grid with six header lines; cells have row, col, value, nodata becomes null."""
    lines = numbered_lines(spark, path)
    head = {p[0].lower(): float(p[1]) for p in (r.value.split() for r in lines.where("n < 6").orderBy("n").collect())}
    body = lines.where("n >= 6 AND trim(value) <> ''")
    cells = body.select((F.col("n") - 6).alias("row"), F.posexplode(F.split(F.trim("value"), "\\s+")).alias("col", "v"))
    value = F.col("v").try_cast("double")
    return head, cells.select("row", "col", F.when(value != head.get("nodata_value", -9999.0), value).alias("value"))


def series(spark: SparkSession, path: str, value_first: bool = True) -> DataFrame:
    """t (seconds), value of a rain or boundary series: pairs under a line with a count and a unit of time."""
    lines = numbered_lines(spark, path)
    unit = lines.select(F.lower(F.regexp_extract("value", "(?i)(seconds|minutes|hours)", 1)).alias("unit"), "n").where("unit <> ''").orderBy("n").first()
    p = F.filter(F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    rows = lines.withColumn("p", p).where((F.size("p") == 2) & (F.size(F.split(F.trim("value"), "\\s+")) == 2))
    t, v = (F.col("p")[1], F.col("p")[0]) if value_first else (F.col("p")[0], F.col("p")[1])
    return rows.select((t * UNITS[unit.unit if unit else "seconds"]).alias("t"), v.alias("value"), "n").orderBy("t", "n").drop("n")


def number_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """n, values of the lines that hold exactly `width` numbers."""
    lines = numbered_lines(spark, path)
    v = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.try_cast("double"))
    return lines.withColumn("values", v).where((F.size("values") == width) & ~F.exists("values", lambda x: x.isNull())).select("n", "values")


def storm_steps(spark: SparkSession, path: str) -> DataFrame:
    """storm, t0, t1, mmh of storm documents (files of one JSON document, or of an array of them)."""
    s = spark.read.schema("name string, steps array<array<double>>").json(path, multiLine=True).withColumn("file", F.input_file_name())
    name = F.coalesce("name", F.regexp_extract("file", "([^/]+)\\.json$", 1))
    return s.select(name.alias("storm"), F.explode("steps").alias("s")).select("storm", F.col("s")[0].alias("t0"), F.col("s")[1].alias("t1"), F.col("s")[2].alias("mmh"))


# map features
def read_features(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features whose bbox struct meets a box (west, south, east, north); the predicate reaches the scan."""
    t = spark.read.option("mergeSchema", "true").parquet(path)
    if box is None or "bbox" not in t.columns:
        return t
    w, s, e, n = box
    return t.where((F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s))


def has(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its dotted name, or null of a kind if the table lacks it."""
    schema: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.names:
            return F.lit(None).cast(kind)
        schema = schema[part].dataType
    return F.col(name)


def buildings(features: DataFrame, default_height: float = 10.0) -> DataFrame:
    col = lambda n, k: F.coalesce(has(features, n, k), has(features, f"properties.{n}", k))
    h, n = has(features, "height", "double"), has(features, "num_floors", "int")
    return features.where("geometry is not null").select("id", "geometry", parse.height(h, n, default_height).alias("height_m"), n.alias("num_floors"), has(features, "subtype", "string").alias("subtype"), col("facade_material", "string").alias("facade_material"), col("roof_shape", "string").alias("roof_shape"))


def street_segments(features: DataFrame) -> DataFrame:
    """One-way flag, speed limit, surface, lanes, connectors of street segments, with defaults."""
    road = lambda n, k: has(features, f"road.{n}", k)
    limits = road("speed_limits", "array<struct<max_speed:struct<value:double,unit:string>,when:string>>")
    lanes = road("lanes", "array<struct<direction:string>>")
    return features.where("geometry is not null").select(
        "id", "geometry", F.coalesce(has(features, "subtype", "string"), F.lit("road")).alias("subtype"), F.coalesce(has(features, "class", "string"), F.lit("unclassified")).alias("class"),
        parse.is_one_way(road("is_oneway", "boolean"), road("flags", "array<string>"), F.transform(lanes, lambda x: x["direction"])).alias("oneway"),
        parse.default_limit(parse.speed_limits(limits)).alias("maxspeed_kmh"), F.get(road("road_surface", "array<struct<value:string>>"), F.lit(0))["value"].alias("surface"),
        F.get(road("width_rules", "array<struct<value:double>>"), F.lit(0))["value"].alias("width_m"), F.greatest(F.size(lanes), F.lit(1)).alias("lanes"),
        F.transform(has(features, "connectors", "array<struct<connector_id:string>>"), lambda x: x["connector_id"]).alias("connectors"),
    )


def prohibited_turns(connectors: DataFrame) -> DataFrame:
    return connectors.select(F.explode("prohibited_transitions").alias("t")).select("t.from_segment_id", "t.to_segment_id").distinct()


def places(features: DataFrame, least_confidence: float = 0.9) -> DataFrame:
    """Names, categories and first address of places; a null confidence is kept."""
    name = F.coalesce(F.col("names.primary"), F.get("names.common", F.lit(0))["value"])
    cats = F.array_compact(F.concat(F.array("categories.primary"), F.coalesce("categories.alternate", F.array().cast("array<string>"))))
    address = F.get("addresses", F.lit(0))
    c = F.col("confidence")
    return features.where(c.isNull() | (c >= least_confidence)).select("geometry", name.alias("name"), cats.alias("categories"), "confidence", F.concat_ws(", ", address["freeform"], address["locality"]).alias("address"))


def bus_stop_times(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame, least_stops: int = 2) -> DataFrame:
    """Stops of bus trips (route type 3; without such routes, of all) in order, with their dwell time."""
    bus = routes.where(F.trim("route_type") == "3").select("route_id")
    any_bus = bus.limit(1).agg((F.count("*") > 0).alias("_some"))
    chosen = routes.select("route_id", "route_type").crossJoin(F.broadcast(any_bus)).where(~F.col("_some") | (F.trim("route_type") == "3")).select("route_id").distinct()
    arr, dep = parse.clock_seconds(F.col("arrival_time")), parse.clock_seconds(F.col("departure_time"))
    j = trips.join(chosen, "route_id").join(stop_times, "trip_id").join(stops.select("stop_id", F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")), "stop_id")
    j = j.select("route_id", "trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("seq"), "lat", "lon", arr.alias("arrival_s"), F.greatest(F.lit(0.0), dep - arr).alias("dwell_s"))
    return j.withColumn("_n", F.count("*").over(Window.partitionBy("trip_id"))).where(F.col("_n") >= least_stops).drop("_n")
