"""Records of features, designs, runs and snapshots: cleaning, keys, catalogues, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.operators.spatial import nearest
from cityweave.session import shared_folder

#: Metres of a storey, and the least height of a building.
LEVEL_M, LEAST_M = 3.0, 2.5


def access_rules(rules: Column) -> Column:
    """Array of (access_type, vehicles) of a feature's restrictions; vehicles come from the first of three keys that has some."""
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.transform(F.coalesce(rules, F.array()), lambda r: F.struct(r["access_type"].alias("access_type"), F.coalesce(some(r["vehicle_types"]), some(r["vehicle"]), some(r["vehicle_categories"])).alias("vehicles")))


def lane_count(number: Column, lanes: Column, counts: Column) -> Column:
    """Lanes of a road: a positive number, else the length of a list, else the first of count, value, total that is there."""
    positive = lambda c: F.when(c > 0, c)
    named = F.coalesce(*(F.try_element_at(counts, F.lit(k)) for k in ("count", "value", "total")))
    return F.coalesce(positive(number), F.when(F.size(lanes) > 0, F.size(lanes)), positive(named.try_cast("int")))


def connector_ids(connectors: Column) -> Column:
    """Ids of connectors, each under one of two names; those without are left out."""
    return F.filter(F.transform(connectors, lambda c: F.coalesce(F.nullif(c["connector_id"], F.lit("")), c["id"])), lambda x: x.isNotNull())


def building_height(levels: Column, plain_levels: Column, height: Column, building_height: Column, default: float) -> Column:
    """Height from storeys, else from plain storeys, heights, or the default; never under the least."""
    number = lambda c: F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.greatest(F.lit(LEAST_M), F.coalesce(number(levels) * LEVEL_M, number(plain_levels) * LEVEL_M, number(height), number(building_height), F.lit(default)))


def land_use(*keys: Column) -> Column:
    """The first of the keys that says something, in lower case."""
    return F.coalesce(*(F.lower(F.nullif(k, F.lit(""))) for k in keys))


def day_class(road: Column, shaded: Column) -> Column:
    return F.when(road, F.when(shaded, 0).otherwise(1)).otherwise(F.when(shaded, 2).otherwise(3))


def night_class(road: Column, lights: Column) -> Column:
    return F.when(road, F.least(lights, F.lit(2))).otherwise(3 + F.least(lights, F.lit(2)))


def clamped_materials(m: DataFrame) -> DataFrame:
    """Materials with every property within its range (fixed values) and labels of 60 characters at most."""
    hold = lambda c, lo, hi: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(lo)), F.lit(hi)).alias(c)
    return m.select("id", F.substring("label", 1, 60).alias("label"), hold("infil_mmh", 0.0, 1000.0), hold("manning_n", 0.01, 0.5), hold("depression_m", 0.0, 1.0), hold("erodible_frac", 0.0, 1.0))


def content_key(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, length)


def design_hash(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, sha256 of a design's cells: rows are hashed first, so that the digest of a design is taken over short, sorted keys per block."""
    block = cells.groupBy(*by, F.floor(F.col("row") / 16).alias("block")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", F.format_string("%06d", F.col("row")), F.format_string("%06d", F.col("col")), F.col("value").cast("string"))))).cast("binary"), 256).alias("h"))
    return block.groupBy(*by).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", F.format_string("%06d", F.col("block")), F.col("h"))))).cast("binary"), 256).alias("sha256"))


def storm_title(name: Column, total_mm: Column) -> Column:
    return F.format_string("%s (%.0f mm)", name, total_mm)


def vehicle_snapshot(rows: DataFrame) -> DataFrame:
    """Snapshot rows; classes that say nothing are passenger cars."""
    c = F.col("vclass")
    return rows.withColumn("vclass", F.when(c.isNull() | c.isin("DEFAULT", "ignoring", ""), "passenger").otherwise(c))


def link_states(signals: DataFrame, links: DataFrame) -> DataFrame:
    """signal, lon, lat, state: the state string of a signal, letter by letter, at its links (signal, position, lon, lat)."""
    s = signals.select("signal", F.posexplode(F.filter(F.split("state", ""), lambda x: x != "")).alias("position", "state"))
    return links.join(s, ["signal", "position"]).select("signal", "lon", "lat", "state")


def place_of(address: Column, presets: DataFrame, cache: DataFrame, rows: DataFrame) -> DataFrame:
    """key, address, lat, lon: a literal "lat,lon", else the preset, else what the cache knows, else null."""
    number = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    literal = lambda k: F.regexp_extract(address, number, k).try_cast("double")
    p = presets.select(F.lower("address").alias("_a"), F.col("lat").alias("_pla"), F.col("lon").alias("_plo"))
    c = cache.select(F.lower("address").alias("_b"), F.col("lat").alias("_cla"), F.col("lon").alias("_clo"))
    name = F.lower(F.trim(address))
    j = rows.withColumn("_n", name).join(F.broadcast(p), F.col("_n") == F.col("_a"), "left").join(c, F.col("_n") == F.col("_b"), "left")
    return j.select(*rows.columns, F.coalesce(literal(1), "_pla", "_cla").alias("lat"), F.coalesce(literal(2), "_plo", "_clo").alias("lon"))


def parts_of(features: DataFrame, key: str, parts: str) -> DataFrame:
    """Features of several polygons as one row per polygon, numbered."""
    return features.select(key, F.posexplode(parts).alias("part", "ring"))


def profile(samples: DataFrame, frames: DataFrame, categories: list[str]) -> DataFrame:
    """category, grain, n, mean, top of timed calls (frame, category, seconds): per call, and per frame (zero where not called)."""
    calls = samples.groupBy("category").agg(F.lit("call").alias("grain"), F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("top"))
    every = frames.select("frame", F.explode(F.array(*(F.lit(c) for c in categories))).alias("category"))
    per = every.join(samples.groupBy("frame", "category").agg(F.sum("seconds").alias("s")), ["frame", "category"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return calls.unionByName(per.groupBy("category").agg(F.lit("frame").alias("grain"), F.count("*").alias("n"), F.avg("s").alias("mean"), F.max("s").alias("top")))


def frames_saved(steps: DataFrame, by: list[str], t: str, every: float) -> DataFrame:
    """Of each run the first step at or after every saving time, and its last step."""
    w = Window.partitionBy(*by).orderBy(t)
    due = F.floor(F.col(t) / every) > F.coalesce(F.floor(F.lag(t).over(w) / every), F.lit(0))
    last = F.lead(t).over(w).isNull()
    return steps.withColumn("_due", due | last).where("_due").drop("_due")


def changes_only(progress: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*by).orderBy(t)
    return progress.withColumn("_b", F.lag(value).over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def latest(progress: DataFrame, by: list[str], t: str) -> DataFrame:
    """The newest row of each group (the largest time; times tell rows apart)."""
    rest = [c for c in progress.columns if c not in by]
    return progress.groupBy(*by).agg(F.max_by(F.struct(*rest), t).alias("m")).select(*by, "m.*")


def stale(polls: DataFrame, by: list[str], t: str, ok: str, interval: float, most: float = 3.0) -> DataFrame:
    """Polls with failures in a row, age of the last success, and a warning once when it gets older than `most` intervals."""
    w = Window.partitionBy(*by).orderBy(t)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    p = polls.withColumn("_last", F.max(F.when(F.col(ok), F.col(t))).over(up)).withColumn("_good", F.sum(F.col(ok).cast("int")).over(up))
    p = p.withColumn("failures", F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(*by, "_good").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("age", F.col(t) - F.col("_last"))
    old = F.coalesce(F.col("age") > most * interval, F.lit(False))
    return p.withColumn("warn", old & ~F.coalesce(F.lag("age").over(w) > most * interval, F.lit(False))).drop("_last", "_good")


def one_active(jobs: DataFrame, design: str, order: str) -> DataFrame:
    """Queued jobs in order, one for each design: later ones of a design that waits are refused."""
    return jobs.withColumn("accepted", F.row_number().over(Window.partitionBy(design).orderBy(order)) == 1)


def created(designs: DataFrame, wanted: DataFrame, templates: list[str]) -> DataFrame:
    """Wanted designs (name, template) with what becomes of them: created, duplicate (of a design or of an earlier wish), or unknown template."""
    have = designs.select("name").distinct().withColumn("_have", F.lit(True))
    known = designs.select(F.col("name").alias("template")).distinct().withColumn("_known", F.lit(True))
    j = wanted.join(have, "name", "left").join(known, "template", "left").withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("wish")))
    result = F.when(F.col("_have") | (F.col("_n") > 1), "duplicate").when(F.col("template").isin(*templates) | F.col("_known"), "created").otherwise("unknown template")
    return j.select("wish", "name", "template", result.alias("result"))


def first_found(*catalogues: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the first catalogue that has it."""
    every = None
    for k, c in enumerate(catalogues):
        c = c.withColumn("_rank", F.lit(k))
        every = c if every is None else every.unionByName(c)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def own_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def affine_document(grids: DataFrame) -> DataFrame:
    """Grid records (grid, minx, miny, res, width, height) with their upper edge."""
    return grids.withColumn("maxy", F.col("miny") + F.col("height") * F.col("res"))


def through_json(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """df written as JSON documents, one folder for each value of `by`, and read back with its schema."""
    path = own_folder(df.sparkSession, tag)
    w = df.write.option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def through_csv(df: DataFrame, tag: str) -> DataFrame:
    path = own_folder(df.sparkSession, tag)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("enforceSchema", False).csv(path)


def through_xml(df: DataFrame, tag: str, row: str) -> DataFrame:
    path = own_folder(df.sparkSession, tag)
    df.write.format("xml").option("rowTag", row).option("rootTag", f"{row}s").save(path)
    return df.sparkSession.read.schema(df.schema).format("xml").option("rowTag", row).load(path)


def read_through(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path; computed and written first where there is none yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def grid_stats(cells: DataFrame, by: list[str], layer: str) -> DataFrame:
    """cells, least, top, n, total by group; built-in aggregates, combined before the shuffle."""
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.min(layer).alias("least"), F.max(layer).alias("top"), F.count(layer).alias("n"), F.sum(layer).alias("total"))


def inundation_crop(points: DataFrame, box: tuple[float, float, float, float], inside: Column) -> DataFrame:
    """Points in a box (a filter that reaches the scan) and then in a shape."""
    return points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).where(inside)


def found_files(spark: SparkSession, folder: str, patterns: dict[str, str]) -> DataFrame:
    """role, file: the first file (by name) of a folder that fits each role's pattern; names alone are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("pattern")) for r, p in patterns.items()))).alias("r")
    hit = names.select("file", roles).where(F.expr("file RLIKE r.pattern"))
    return hit.groupBy(F.col("r.role").alias("role")).agg(F.min("file").alias("file"))


def with_settings(document: Column, values: dict[str, str]) -> Column:
    """An XML configuration with the value attribute of the named elements replaced."""
    for name, value in values.items():
        document = F.regexp_replace(document, f'(<{name}\\s[^>]*value=")[^"]*(")', f"$1{value}$2")
    return document


def shaded(value: Column, most: float, stops: list[tuple[int, int, int]], least: float = 0.01) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue, alpha of a value between colour stops; clear below `least`."""
    at = F.least(F.greatest(value / most, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    k = F.least(F.floor(at), F.lit(len(stops) - 2))
    table = lambda c: F.array(*(F.lit(float(s[c])) for s in stops))
    part = lambda c: F.round(F.get(table(c), k.cast("int")) + (at - k) * (F.get(table(c), (k + 1).cast("int")) - F.get(table(c), k.cast("int")))).cast("int")
    return part(0), part(1), part(2), F.when(value < least, 0).otherwise(255)


def retried(call, places: list, errors: tuple = (OSError,)):
    """What the first of several places gives whose call doesn't fail with one of the errors; the last error else."""
    last = None
    for place in places:
        try:
            return call(place)
        except errors as e:
            last = e
    raise last if last else ValueError("no place to try")


def observed(df: DataFrame, sink, **metrics: Column) -> dict:
    """Run sink(df) and return metrics of the rows that went by, gathered while it ran."""
    from pyspark.sql import Observation

    o = Observation(uuid.uuid4().hex)
    sink(df.observe(o, *(c.alias(k) for k, c in metrics.items())))
    return o.get


def flattened(regions: DataFrame, region: str, mark: Column, keep: DataFrame, least_share: float = 0.5) -> DataFrame:
    """region, share of the regions of which at least a share of cells is marked, less those to keep."""
    s = regions.groupBy(region).agg(F.avg(mark.cast("int")).alias("share")).where(F.col("share") >= least_share)
    return s.join(keep, region, "left_anti")


def borrowed_height(buildings: DataFrame, others: DataFrame, building_id: str, own: Column, default: float, radius: float = 30.0) -> DataFrame:
    """building_id, height: a building's own, else that of the nearest of the others (px, py, height) closer than the radius
    (of equally near ones the lowest), else the default. Only buildings without a height are looked up."""
    without = buildings.where(own.isNull()).select(building_id, "x", "y")
    near = nearest(without, others.where("height > 0"), building_id, "height", radius, strict=True).select(building_id, F.col("height").alias("_near"))
    return buildings.join(near, building_id, "left").select(building_id, F.coalesce(own, "_near", F.lit(default)).alias("height"))


def with_buildings(places: DataFrame, centroids: DataFrame) -> DataFrame:
    """Places (name, categories, confidence, x, y) and a residential one at each building's centroid (x, y); empty buildings add none."""
    own = [F.lit("Residential Building").alias("name"), F.array(F.lit("residential")).alias("categories"), F.lit(1.0).alias("confidence")]
    homes = centroids.where("x IS NOT NULL AND y IS NOT NULL").select(*own, "x", "y")
    return places.select("name", "categories", F.col("confidence").cast("double").alias("confidence"), "x", "y").unionByName(homes)
