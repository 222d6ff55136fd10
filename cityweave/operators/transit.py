"""Trips, demand, stops, arrivals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.motion import outbound_share


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that the seed and the keys fix."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**53)) / float(2**53)


def gravity(origins: DataFrame, zones: DataFrame, beta: float, digits: int | None = None) -> DataFrame:
    """origin, zone, p: probability by attraction * exp(-beta * distance), rounded to digits; a sum of 0 gives equal shares.

    origins (origin, x, y) meet all zones (zone, px, py, attraction); the zones are few and broadcast. Sums are taken first,
    for each place of origins over the places of zones, so only origins are shuffled, never the pairs. A share is worked out
    once for up to 32 origins of one place and the zones of one place and attraction, and then copied to their pairs.
    """
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    weight = F.col("attraction") * F.exp(-beta * d)
    n = max(origins.sparkSession.sparkContext.defaultParallelism, int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spots = zones.groupBy("px", "py").agg(F.sum("attraction").alias("attraction"), F.count("*").alias("_n"))
    sums = origins.select("x", "y").distinct().repartition(n, "x", "y").crossJoin(F.broadcast(spots)).groupBy("x", "y").agg(F.sum(weight).alias("_s"), F.sum("_n").alias("_n"))
    w = Window.partitionBy("origin")
    met = origins.join(sums.toDF("_x", "_y", "_s", "_n"), F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")))
    met = met.select("origin", "x", "y", F.sum("_s").over(w).alias("_s"), F.sum("_n").over(w).alias("_n"))
    met = _in_runs(met, 32, "x", "y", "_s", "_n", "origin").groupBy("_run", "x", "y", "_s", "_n").agg(_listed("origin")).repartition(n)
    held = _in_runs(zones, 512, "px", "py", "attraction", "zone").groupBy("_run", "px", "py", "attraction").agg(_listed("zone"))
    blocks = held.groupBy("_run").agg(F.collect_list(F.struct("px", "py", "attraction", "_zones")).alias("_spots")).select("_spots")
    # generated code keeps all rows that come of one row it takes in; coalesce, which merges nothing here, makes that one block of zones
    j = met.crossJoin(F.broadcast(blocks)).coalesce(2**20).withColumn("_spot", F.explode("_spots")).select("x", "y", "_s", "_n", "_origins", "_spot.*")
    p = F.when(F.col("_s") > 0, F.try_divide(weight, F.col("_s"))).otherwise(1.0 / F.col("_n"))
    j = j.select("_origins", "_zones", (p if digits is None else F.round(p, digits)).alias("p"))
    return j.select(F.explode("_origins").alias("origin"), "_zones", "p").select("origin", F.explode("_zones").alias("zone"), "p")


def _in_runs(df: DataFrame, most: int, *order: str) -> DataFrame:
    """_run: the same for rows next to each other in the order, for `most` (a power of 2) rows at most."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), most.bit_length() - 1))


def _listed(c: str) -> Column:
    return F.collect_list(F.struct(c))[c].alias(f"_{c}s")  # structs, since lists leave out nulls


def choose(shares: DataFrame, by: str, item: str, p: str, u: Column) -> DataFrame:
    """The item of each group whose cumulative share first exceeds u (the last one at the latest)."""
    w = Window.partitionBy(by).orderBy(item)
    c = shares.withColumn("_c", F.sum(p).over(w)).withColumn("_last", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(item))) == 1)
    return c.where((F.col("_c") > u) | F.col("_last")).groupBy(by).agg(F.min(item).alias(item))


def direction(trips: DataFrame, hour: Column, u: Column) -> DataFrame:
    """Whether a trip leaves home, by hour and a uniform number."""
    return trips.withColumn("outbound", u < outbound_share(hour))


def chain(trips: DataFrame, agent: str, order: str) -> DataFrame:
    """Trips of an agent begin where the last one ended: origin becomes the destination before it."""
    before = F.lag("destination").over(Window.partitionBy(agent).orderBy(order))
    return trips.withColumn("origin", F.coalesce(before, F.col("origin")))


def arrivals(buses: DataFrame, stops: DataFrame, within_s: float = 300.0) -> DataFrame:
    """stop_id, eta_s: the soonest bus of each stop. buses (route_id, at, speed_ms, desired_ms), stops (route_id, stop_id, along, route_length)."""
    way = F.col("along") - F.col("at")
    way = F.when(way < 0, way + F.col("route_length")).otherwise(way)
    eta = way / F.greatest(F.col("speed_ms"), 0.3 * F.col("desired_ms"))
    return buses.join(stops, "route_id").withColumn("eta_s", eta).where(F.col("eta_s") < within_s).groupBy("stop_id").agg(F.min("eta_s").alias("eta_s"))


def stop_distances(legs: DataFrame, trip: str, order: str, length: str) -> DataFrame:
    """along: distance of each stop from the trip's first; a trip with a leg of unknown length goes."""
    w = Window.partitionBy(trip).orderBy(order)
    whole = F.count(F.when(F.col(length).isNull(), 1)).over(Window.partitionBy(trip)) == 0
    return legs.withColumn("_ok", whole).where("_ok").drop("_ok").withColumn("along", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def next_stop(stops: DataFrame, trip: str, along: str, start: float) -> DataFrame:
    """The first stop farther than start on each trip."""
    return stops.where(F.col(along) > start).groupBy(trip).agg(F.min(F.struct(along, "stop_id")).alias("x")).select(trip, F.col("x.stop_id").alias("stop_id"), F.col(f"x.{along}").alias(along))


def travel_time_lookup(edges: DataFrame, measured: DataFrame, simulated: DataFrame) -> DataFrame:
    """tt of an edge: measured by its way id, else by 'way#key', else simulated by (u, v), else free flow."""
    a = measured.select(F.col("id").alias("_a"), F.col("tt").alias("_ta"))
    b = measured.select(F.col("id").alias("_b"), F.col("tt").alias("_tb"))
    s = simulated.groupBy("u", "v").agg(F.min("tt").alias("_ts"))
    j = edges.join(a, F.col("osmid") == F.col("_a"), "left").join(b, F.concat("osmid", F.lit("#"), "key") == F.col("_b"), "left").join(s, ["u", "v"], "left")
    return j.withColumn("tt", F.coalesce("_ta", "_tb", "_ts", F.col("length") / F.col("speed_ms"))).drop("_a", "_ta", "_b", "_tb", "_ts")


def congested_times(edges: DataFrame, paths: DataFrame, agents: DataFrame) -> DataFrame:
    """tt of edges from the mean speed on their path (at least 0.5 m/s), the last path of (u, v) counting; else free flow."""
    mean = agents.groupBy("path_id").agg(F.greatest(F.lit(0.5), F.avg("speed_ms")).alias("m"))
    p = paths.join(mean, "path_id", "left").withColumn("pt", F.col("length") / F.coalesce("m", "maxspeed_ms"))
    last = p.groupBy("u", "v").agg(F.max_by(F.struct("pt", "m"), "path_id").alias("x"))
    return edges.join(last, ["u", "v"], "left").withColumn("tt", F.when(F.col("x.m").isNotNull(), F.col("length") / F.col("x.m")).otherwise(F.col("length") / F.col("speed_ms"))).drop("x")


def place_on_path(agents: DataFrame, paths: DataFrame) -> DataFrame:
    """x, y and heading of agents (path_id, dist) on polylines (points array<struct<x,y>>, cum_len array<double>)."""
    j = agents.join(paths, "path_id")
    total = F.try_element_at("cum_len", F.lit(-1))
    d = F.least(F.greatest(F.col("dist"), F.lit(0.0)), total)
    k = F.greatest(F.lit(0), F.least(F.size(F.filter("cum_len", lambda c: c <= d)) - 1, F.size("points") - 2))
    j = j.withColumn("_d", d).withColumn("_k", k)
    a, b = F.get("points", F.col("_k")), F.get("points", F.col("_k") + 1)
    ca, cb = F.get("cum_len", F.col("_k")), F.get("cum_len", F.col("_k") + 1)
    t = F.coalesce(F.try_divide(F.col("_d") - ca, cb - ca), F.lit(0.0))
    heading = F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])) + 540.0, F.lit(360.0))
    return j.withColumn("x", a["x"] + t * (b["x"] - a["x"])).withColumn("y", a["y"] + t * (b["y"] - a["y"])).withColumn("heading", heading).drop("_d", "_k")


def points_along(segments: DataFrame, spacing: float, segment_id: str = "segment_id") -> DataFrame:
    """Points every `spacing` from the start of each segment (ax, ay, bx, by)."""
    n = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    s = segments.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / spacing).cast("int"))))
    t = F.coalesce(F.try_divide(F.col("k") * spacing, F.col("_n")), F.lit(0.0))
    return s.select(segment_id, "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
