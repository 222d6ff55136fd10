"""Registered queries of reports, selections and set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions import motion, raster, solar
from cityweave.operators import designs, flood, grids, network, spatial, traffic
from cityweave.operators.numbering import numbered
from cityweave.plans.catalogue import rounded
from cityweave.plans.registry import Views, query


@query("""WITH c AS (SELECT v.row_id, min(CASE WHEN sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) < 12 AND n.node_id % 2 = 0 THEN 1.4 WHEN sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) < 30 AND n.node_id % 7 = 0 THEN 9 END) AS x,
min(CASE WHEN n.node_id % 2 = 0 AND sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) < 12 THEN 1.4 END) AS a, min(CASE WHEN n.node_id % 7 = 0 AND sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) < 30 THEN 0.5 END) AS b FROM veh v, nodes n GROUP BY v.row_id)
SELECT row_id AS agent_id, least(a, b) AS cap_ms FROM c""", "veh nodes")
def speed_caps(v: Views) -> DataFrame:
    n = v.nodes.select("node_id", F.col("x").alias("px"), F.col("y").alias("py"))
    a = v.veh.select(F.col("row_id").alias("agent_id"), "x", "y")
    return traffic.speed_caps(a, n.where("node_id % 2 = 0"), n.where("node_id % 7 = 0")).select("agent_id", "cap_ms")


@query("""SELECT path_id, arg_max(row_id, CASE WHEN speed_ms < 2 THEN 1e12 ELSE 0 END + (power(x - 500, 2) + power(y - 500, 2)) * 1e5 + row_id * 1e-3) AS agent_id FROM veh WHERE row_id % 9 <> 0 GROUP BY path_id""", "veh")
def recycle_pick(v: Views) -> DataFrame:
    a = v.veh.withColumn("idle", F.col("speed_ms") < 2).withColumn("chosen", F.col("row_id") % 9 == 0).withColumnRenamed("row_id", "agent_id")
    return traffic.recycle_pick(a, ["path_id"], "idle", "chosen", 500.0, 500.0)


@query("""WITH g AS (SELECT run, t_s // 86400 AS day, count(*) FILTER (speed_ms <= 20) AS running, count(*) FILTER (speed_ms > 20) AS a, avg(x) AS l, avg(y) AS w FROM veh GROUP BY 1, 2)
SELECT run, CAST(day AS BIGINT) AS day, CAST(running AS BIGINT) AS running, round(l, 6) AS mean_time_loss, round(w, 6) AS mean_waiting, CAST(sum(a) OVER (PARTITION BY run ORDER BY day) AS BIGINT) AS arrived_total FROM g""", "veh")
def live_kpis(v: Views) -> DataFrame:
    s = v.veh.select("run", F.floor(F.col("t_s") / 86400).alias("day"), (F.col("speed_ms") > 20).alias("arrived"), F.col("x").alias("time_loss"), F.col("y").alias("waiting"))
    return rounded(traffic.kpis(s, ["run"], "day"))


@query("SELECT path_id, CAST(count(*) FILTER (row_id % 3 = 0) AS BIGINT) AS injuries, CAST(count(*) FILTER (row_id % 3 = 0 AND speed_ms >= 8.3) AS BIGINT) AS severe, CAST(count(DISTINCT vehicle_id) AS BIGINT) AS exposed FROM veh GROUP BY path_id", "veh")
def safety_totals(v: Views) -> DataFrame:
    e = v.veh.select("path_id", F.col("vehicle_id").alias("ped_id"), F.when(F.col("row_id") % 3 == 0, F.col("speed_ms")).alias("impact"))
    return traffic.safety_totals(e, ["path_id"])


@query("""WITH l AS (SELECT CASE vclass WHEN 'passenger' THEN 'Cars' WHEN 'bus' THEN 'Transit' WHEN 'tram' THEN 'Transit' ELSE vclass END AS label FROM veh), g AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT label, n, CAST(row_number() OVER (ORDER BY CASE label WHEN 'Transit' THEN 0 WHEN 'Cars' THEN 1 ELSE 2 END, label) AS BIGINT) AS position FROM g""", "veh")
def label_counts(v: Views) -> DataFrame:
    g = traffic.label_counts(v.veh, "vclass", {"passenger": "Cars", "bus": "Transit", "tram": "Transit"}, ["Transit", "Cars"])
    return g.select("label", "n", F.col("position").cast("long").alias("position"))


@query("""SELECT path_id, t0, t1, value FROM (SELECT path_id, row_id AS t0, lead(row_id) OVER (PARTITION BY path_id ORDER BY row_id) AS t1, speed_ms AS value FROM veh) WHERE value > 0 AND t1 - t0 > 0.01""", "veh")
def rain_intervals(v: Views) -> DataFrame:
    return traffic.rain_intervals(v.veh, ["path_id"], "row_id", "speed_ms")


@query("""SELECT row_id AS agent_id, row_id % 4 = 0 AND 1000 - x <= 1e-3 AS at_stop, round(CASE WHEN row_id % 4 = 0 AND 1000 - x <= 1e-3 THEN NULL WHEN row_id % 4 = 0 THEN least(coalesce(CASE WHEN row_id % 5 > 0 THEN y / 2 END, greatest(0.1, 998 - x)), greatest(0.1, 998 - x)) ELSE CASE WHEN row_id % 5 > 0 THEN y / 2 END END, 6) AS gap FROM veh""", "veh")
def stopline_gaps(v: Views) -> DataFrame:
    a = v.veh.select(F.col("row_id").alias("agent_id"), F.when(F.col("row_id") % 5 > 0, F.col("y") / 2).alias("gap"), (1000 - F.col("x")).alias("to_stop"), (F.col("row_id") % 4 == 0).alias("red"))
    return rounded(traffic.stopline_gap(a, "to_stop", "red").select("agent_id", "at_stop", "gap"))


@query("""SELECT "row", col, depth FROM (SELECT *, row_number() OVER (ORDER BY depth DESC, "row", col) AS k FROM cells WHERE NOT building) WHERE k <= 25""", "cells")
def top_ponding(v: Views) -> DataFrame:
    return v.cells.where(~F.col("building")).orderBy(F.desc("depth"), "row", "col").limit(25).select("row", "col", "depth")


@query("""(SELECT "row", col FROM cells WHERE building UNION SELECT "row", col FROM cells WHERE band = 1) INTERSECT SELECT "row", col FROM cells WHERE depth > 0.5 EXCEPT SELECT "row", col FROM cells WHERE water""", "cells")
def component_algebra(v: Views) -> DataFrame:
    c = lambda p: v.cells.where(p).select("row", "col")
    return c("building").union(c("band = 1")).distinct().intersect(c("depth > 0.5")).exceptAll(c("water"))


@query("SELECT CAST(count(*) + 2 AS BIGINT) AS n, max(seq) + 2 AS top, round(sum(length) + 240, 4) AS total FROM edges", "edges")
def bridge_edges(v: Views) -> DataFrame:
    b = network.bridge(v.edges, 1, 2, 120.0)
    return b.agg(F.count("*").alias("n"), F.max("seq").alias("top"), F.round(F.sum("length"), 4).alias("total"))


@query("""WITH q AS (SELECT CAST(o_orderkey AS BIGINT) AS query_id, CAST(o_custkey % 100 AS BIGINT) AS a, CAST(o_orderkey * 7 % 100 AS BIGINT) AS b FROM orders), e AS (SELECT DISTINCT u, v FROM edges WHERE highway = 'primary')
SELECT query_id, CASE WHEN f.u IS NOT NULL OR r.u IS NOT NULL THEN f.u IS NULL OR r.u IS NULL END AS one_way, CASE WHEN f.u IS NOT NULL OR r.u IS NOT NULL THEN f.u IS NOT NULL END AS forward FROM q LEFT JOIN e f ON f.u = q.a AND f.v = q.b LEFT JOIN e r ON r.u = q.b AND r.v = q.a""", "edges")
def road_directions(v: Views) -> DataFrame:
    q = v.orders.select(F.col("o_orderkey").cast("long").alias("query_id"), (F.col("o_custkey") % 100).cast("long").alias("a"), (F.col("o_orderkey") * 7 % 100).cast("long").alias("b"))
    return network.resolve_direction(q, v.edges.where("highway = 'primary'"))


@query("""WITH e AS (SELECT *, key % 3 + 1 AS n FROM edges WHERE highway <> 'footway'), l AS (SELECT *, unnest(range(n)) AS i FROM e) SELECT u, CAST(count(*) AS BIGINT) AS lanes, round(sum((i - (n - 1) / 2.0) * 3.2 * length), 3) AS moment FROM l GROUP BY u""", "edges")
def drivable_lane_rows(v: Views) -> DataFrame:
    l = network.drivable_lanes(v.edges.withColumn("lanes", (F.col("key") % 3 + 1).cast("int")))  # noqa: E741
    return l.groupBy("u").agg(F.count("*").alias("lanes"), F.round(F.sum(F.col("offset_m") * F.col("length")), 3).alias("moment"))


@query("""WITH p AS (SELECT row_id, y / 30.0 AS r, x / 25.0 AS c FROM veh), n AS (SELECT row_id, CAST(floor(r) AS BIGINT) + i AS rr, CAST(floor(c) AS BIGINT) + j AS cc, (CASE WHEN i = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE WHEN j = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS w FROM p, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT row_id AS point_id, round(sum(w * coalesce(dem, 0)), 6) AS value FROM n LEFT JOIN cells ON cells."row" = rr AND cells.col = cc GROUP BY row_id""", "veh cells")
def bilinear_samples(v: Views) -> DataFrame:
    p = v.veh.select(F.col("row_id").alias("point_id"), (F.col("y") / 30.0).alias("row"), (F.col("x") / 25.0).alias("col"))
    return rounded(grids.bilinear(v.cells, "dem", p))


@query("""SELECT "row", col, round(CASE WHEN band > 0 THEN band * 10.0 ELSE infil END, 6) AS infil, round(dem - CASE WHEN band > 0 THEN band * 0.1 ELSE 0 END + CASE WHEN col = 7 THEN 0.5 ELSE 0 END, 6) AS dem FROM cells""", "cells")
def baked_design(v: Views) -> DataFrame:
    m = v.spark.range(1, 4).select(F.col("id").alias("cls"), (F.col("id") * 10.0).alias("infil"), (F.col("id") / 50.0).alias("manning"), (F.col("id") * 0.1).alias("depression"))
    d = v.cells.where("col = 7").select("row", "col", F.lit(0.5).alias("delta"))
    return rounded(grids.bake(v.cells.withColumn("manning", F.lit(0.03)), m, "band", d).select("row", "col", "infil", "dem"))


@query("SELECT band, round(avg(CASE WHEN depth > 0.2 THEN 1.0 ELSE 0 END) * 100, 6) AS covered_pct, avg(CASE WHEN depth > 0.2 THEN 1.0 ELSE 0 END) * 100 < 95 AS short FROM cells GROUP BY band", "cells")
def coverage_share(v: Views) -> DataFrame:
    return rounded(grids.covered_share(v.cells.withColumn("points", (F.col("depth") > 0.2).cast("int")), ["band"], "points"))


@query("SELECT CASE WHEN node_id % 4 = 0 THEN 'present' WHEN node_id % 4 = 1 THEN 'absent' ELSE 'uncertain' END AS status, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(x - y, 0.5), 6) AS median_dh, round(quantile_cont(abs(x - y), 0.9), 6) AS p90_abs_dh FROM nodes GROUP BY 1", "nodes")
def reconciliation_counts(v: Views) -> DataFrame:
    k = F.col("node_id") % 4
    n = v.nodes.withColumn("status", F.when(k == 0, "present").when(k == 1, "absent").otherwise("uncertain")).withColumn("dh", F.col("x") - F.col("y"))
    return rounded(n.groupBy("status").agg(F.count("*").alias("n"), F.percentile("dh", F.lit(0.5)).alias("median_dh"), F.percentile(F.abs("dh"), F.lit(0.9)).alias("p90_abs_dh")))


@query("""WITH s AS (SELECT node_id AS storm, node_id % 4 AS k FROM nodes) SELECT storm, CASE k WHEN 0 THEN 'no steps' WHEN 1 THEN 'a step needs three values' ELSE 'a step ends before it begins' END AS error FROM s WHERE k < 3""", "nodes")
def storm_errors(v: Views) -> DataFrame:
    k = F.col("node_id") % 4
    arr = lambda *x: F.array(F.array(*(F.lit(float(y)) for y in x)))
    s = v.nodes.select(F.col("node_id").alias("storm"), F.when(k == 0, F.array().cast("array<array<double>>")).when(k == 1, arr(0, 10)).when(k == 2, arr(10, 5, 1)).otherwise(arr(0, 10, 1)).alias("steps"))
    return designs.storm_errors(s)


@query("""SELECT node_id, x FROM nodes WHERE node_id % 2 = 0 UNION ALL SELECT node_id, y FROM nodes WHERE node_id % 2 = 1 AND node_id % 3 = 0""", "nodes")
def built_in_then_custom(v: Views) -> DataFrame:
    n = v.nodes
    return designs.first_of(n.where("node_id % 2 = 0").select("node_id", "x"), n.where("node_id % 3 = 0").select("node_id", F.col("y").alias("x")), "node_id")


@query("SELECT n.node_id, n.x FROM nodes n WHERE n.node_id IN (SELECT u FROM edges WHERE highway = 'primary')", "nodes edges")
def alive_objects(v: Views) -> DataFrame:
    return designs.retire(v.nodes.select("node_id", "x"), v.edges.where("highway = 'primary'").select(F.col("u").alias("node_id")), "node_id")


@query("SELECT row_id, round(degrees(acos(least(greatest((x - 500.5) / sqrt(power(x - 500.5, 2) + power(y - 500.5, 2)), -1), 1))), 6) AS angle FROM veh", "veh")
def turn_angles(v: Views) -> DataFrame:
    return rounded(v.veh.select("row_id", motion.turn_angle(F.lit(1.0), F.lit(0.0), F.col("x") - 500.5, F.col("y") - 500.5).alias("angle")))


@query("""WITH t AS (SELECT row_id, (t_s % 86400) / 3600.0 AS hour FROM veh WHERE t_s % 43200 <> 21600), h AS (SELECT row_id, sin(pi() * (hour - 6) / 12) AS e, 2 * pi() * (hour - 6) / 24 AS a FROM t) SELECT row_id, round(CASE WHEN e <= 0 THEN 0 ELSE cos(a) * sqrt(1 - e * e) END, 6) AS x, round(CASE WHEN e <= 0 THEN -1 ELSE e END, 6) AS z FROM h""", "veh")
def simple_sun(v: Views) -> DataFrame:
    h = v.veh.where("t_s % 43200 <> 21600").select("row_id", (F.col("t_s") % 86400 / 3600.0).alias("hour"))
    s = solar.simple_sun(F.col("hour"))
    return rounded(h.select("row_id", s["x"].alias("x"), s["z"].alias("z")))


@query("""SELECT "row", col, CAST(least(greatest(round_even((dem - 20) / 0.01, 0), 0), 65535) AS INTEGER) AS q FROM cells""", "cells")
def quantized_heights(v: Views) -> DataFrame:
    return v.cells.select("row", "col", raster.quantized(F.col("dem"), 20.0, 0.01).alias("q"))


@query("SELECT a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.node_id <> b.node_id AND b.x >= a.x - 20 AND b.x + 10 <= a.x + 120 AND b.y >= a.y - 20 AND b.y + 10 <= a.y + 120", "nodes")
def box_containment(v: Views) -> DataFrame:
    n = v.nodes
    a = n.select(F.col("node_id").alias("a"), (F.col("x") - 20).alias("ax0"), (F.col("y") - 20).alias("ay0"), (F.col("x") + 120).alias("ax1"), (F.col("y") + 120).alias("ay1"))
    b = n.select(F.col("node_id").alias("b"), F.col("x").alias("bx0"), F.col("y").alias("by0"), (F.col("x") + 10).alias("bx1"), (F.col("y") + 10).alias("by1"))
    j = a.withColumn("c", F.explode(spatial.segment_cells(F.col("ax0"), F.col("ay0"), F.col("ax1"), F.col("ay1"), 150.0))).join(b.withColumn("c", spatial.grid_cell(F.col("bx0"), F.col("by0"), 150.0)), "c")
    box = lambda p: {k: F.col(f"{p}{k}") for k in ("x0", "y0", "x1", "y1")}
    return j.where((F.col("a") != F.col("b")) & spatial.box_contains(box("a"), box("b"))).select("a", "b")


@query("""WITH s AS (SELECT node_id % 10 AS g, node_id, x FROM nodes), k AS (SELECT g, list(x ORDER BY node_id) AS l FROM s GROUP BY g)
SELECT g, round(list_reduce(l, lambda acc, p : CASE WHEN p > 0 THEN CASE WHEN p * 1.1 > acc OR p * 1.1 < acc * 0.5 THEN greatest(p * 1.1, 1e-6) ELSE greatest(p * 1.1, acc * 0.9, 1e-6) END ELSE acc END, CAST(0 AS DOUBLE)), 6) AS scale FROM k""", "nodes")
def display_scale(v: Views) -> DataFrame:
    s = designs.scale_series(v.nodes.withColumn("g", F.col("node_id") % 10), ["g"], "node_id", "x")
    return rounded(s.groupBy("g").agg(F.max_by("scale", "node_id").alias("scale")))


@query("SELECT node_id, x, row_number() OVER (ORDER BY x DESC, node_id) AS k FROM nodes", "nodes")
def ordered_nodes(v: Views) -> DataFrame:
    return numbered(v.nodes.select("node_id", "x"), F.desc("x"), F.col("node_id"), name="k", start=1)


_FLOW = """n AS (SELECT a."row", a.col, b."row" AS tr, b.col AS tc, (a.dem - b.dem) / sqrt(power(a."row" - b."row", 2) + power(a.col - b.col, 2)) AS s FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) WHERE a.dem > b.dem),
best AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY s DESC, tr, tc) AS k FROM n)"""


@query(f"""WITH RECURSIVE {_FLOW}, u(r, c) AS (SELECT "row", col FROM cells WHERE water UNION SELECT b."row", b.col FROM u JOIN best b ON b.k = 1 AND b.tr = u.r AND b.tc = u.c) SELECT r AS "row", c AS col FROM u""", "cells")
def upstream_cells(v: Views) -> DataFrame:
    return grids.upstream(grids.receivers(v.cells), v.cells.where("water"))


@query("""WITH q AS (SELECT band, quantile_cont(depth, 0.5) FILTER (depth > 0.1) AS p50, quantile_cont(depth, 0.9) FILTER (depth > 0.1) AS p90, quantile_cont(depth, 0.99) FILTER (depth > 0.1) AS p99, count(*) FILTER (depth > 1.8 + 0.01) AS over_fill, count(*) FILTER (depth > 3) AS very_deep, quantile_cont(speed, 0.999) AS s, count(*) AS n FROM cells GROUP BY band)
SELECT band, round(coalesce(p50, 0), 6) AS p50_depth, round(coalesce(p90, 0), 6) AS p90_depth, round(coalesce(p99, 0), 6) AS p99_depth, over_fill, very_deep, round(coalesce(s, 0), 6) AS p999_speed, n, CASE WHEN over_fill > 0.01 * n THEN 'fill' ELSE '' END AS reasons, CASE WHEN over_fill > 0.01 * n THEN 'WARN' ELSE 'PASS' END AS verdict FROM q""", "cells")
def run_quality(v: Views) -> DataFrame:
    return rounded(flood.run_quality(v.cells.withColumn("fill_depth", F.lit(1.8)), 1e-12, ["band"]))


@query("""WITH s AS (SELECT col AS x, avg(depth) AS depth FROM cells GROUP BY col), b AS (SELECT x, 0.9 AS low, 1.0 AS high FROM s WHERE x % 3 = 0) SELECT count(*) FILTER (depth BETWEEN low - 0.02 AND high + 0.02) AS inside, count(low) AS points, max(s.x) FILTER (depth >= 0.15) AS front_x FROM s LEFT JOIN b ON b.x = s.x""", "cells")
def section_check(v: Views) -> DataFrame:
    s = v.cells.groupBy(F.col("col").alias("x")).agg(F.avg("depth").alias("depth"))
    return flood.section_check(s, s.where("x % 3 = 0").select("x", F.lit(0.9).alias("low"), F.lit(1.0).alias("high")))


@query("""WITH r AS (SELECT 1.0 + band AS res, CASE WHEN water THEN 'after' ELSE 'before' END AS state, depth, speed FROM cells), t AS (SELECT res, sum(CASE WHEN state = 'before' AND depth > 0.05 THEN res * res ELSE 0 END) AS b, sum(CASE WHEN state = 'after' AND depth > 0.05 THEN res * res ELSE 0 END) AS a, quantile_cont(speed, 0.99) FILTER (state = 'before') AS p FROM r GROUP BY res)
SELECT CAST(res AS DOUBLE) AS res, CAST(b AS DOUBLE) AS before_m2, CAST(a AS DOUBLE) AS after_m2, round(p, 6) AS p99_speed, round(-100 * (a - b) / b, 6) AS reduction_pct FROM t""", "cells")
def resolution_table(v: Views) -> DataFrame:
    r_ = v.cells.select((1.0 + F.col("band")).alias("res"), F.when(F.col("water"), "after").otherwise("before").alias("state"), "depth", "speed")
    return rounded(flood.resolution_table(r_, "res"))


@query("WITH p AS (SELECT band, sum(depth) AS injuries FROM cells GROUP BY band) SELECT band, round(injuries, 6) AS injuries, round(injuries - (SELECT arg_min(injuries, band) FROM p), 6) AS delta FROM p", "cells")
def preset_table(v: Views) -> DataFrame:
    p = v.cells.groupBy("band").agg(F.sum("depth").alias("injuries"))
    return rounded(flood.preset_table(p, "band", "band", "injuries"))


@query("""SELECT "row", col, CASE WHEN building THEN 'building' WHEN water THEN 'water' WHEN dem > 25 AND speed < 0.75 THEN 'paved' WHEN speed >= 0.75 THEN 'rough' WHEN infil > 0.2 THEN 'vegetation' WHEN depth < 0.5 THEN 'soil' ELSE 'ground' END AS cover FROM cells""", "cells")
def land_cover(v: Views) -> DataFrame:
    c = v.cells.withColumns({"exg": F.col("infil"), "relief": F.col("depth"), "std": F.col("speed"), "brightness": F.col("dem")})
    return grids.land_cover(c, 0.2, 0.75, 25.0).select("row", "col", "cover")
