"""Queries on records of features, designs, runs and snapshots, and their round trips through files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators import records
from cityweave.plans.registry import Views, query


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'denied' WHEN 1 THEN NULL ELSE 'allowed' END AS access_type, CASE WHEN o_orderkey % 5 = 0 THEN 'bus|car' WHEN o_orderkey % 3 = 0 THEN 'hgv' WHEN o_orderkey % 7 = 0 THEN 'foot' END AS vehicles FROM orders WHERE o_orderkey % 6 <> 5""")
def access_restrictions(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rule = F.struct(
        F.when(k % 4 == 0, "denied").when(k % 4 == 1, None).otherwise("allowed").alias("access_type"), F.when(k % 5 == 0, F.array(F.lit("bus"), F.lit("car"))).otherwise(none).alias("vehicle_types"),
        F.when(k % 3 == 0, F.array(F.lit("hgv"))).alias("vehicle"), F.when(k % 7 == 0, F.array(F.lit("foot"))).otherwise(none).alias("vehicle_categories"),
    )
    rows = v.orders.select(k.alias("id"), records.access_rules(F.when(k % 6 != 5, F.array(rule))).alias("r")).select("id", F.explode("r").alias("r"))
    return rows.select("id", "r.access_type", F.array_join("r.vehicles", "|").alias("vehicles"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 - 1 > 0 THEN o_orderkey % 5 - 1 WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 > 0 THEN o_orderkey % 4 WHEN o_orderkey % 3 = 2 AND o_orderkey % 6 > 0 THEN o_orderkey % 6 END AS lanes FROM orders""")
def lane_counts(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 0, (k % 5 - 1).cast("int"))
    lanes = F.when(k % 3 == 1, F.array_repeat(F.lit("lane"), (k % 4).cast("int")))
    name = F.when(k % 2 == 0, "count").otherwise("total")
    counts = F.when(k % 3 == 2, F.create_map(name, (k % 6).cast("string"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return v.orders.select(k.alias("id"), records.lane_count(number, lanes, counts).cast("long").alias("lanes"))


@query("""SELECT l_orderkey AS id, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'c' ELSE 'i' END || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1""")
def connector_lists(v: Views) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    c = F.struct(n.alias("n"), F.when(n == 3, None).when(n % 2 == 0, F.concat(F.lit("c"), p)).otherwise("").alias("connector_id"), F.when(n == 3, None).otherwise(F.concat(F.lit("i"), p)).alias("id"))
    rows = v.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(c)).alias("c")).select("id", records.connector_ids(F.col("c")).alias("ids"))
    return rows.where(F.size("ids") > 0).select("id", F.array_join("ids", ",").alias("ids"))


@query("""SELECT p_partkey AS id, round(greatest(2.5, CASE p_partkey % 5 WHEN 0 THEN p_size * 3.0 WHEN 1 THEN (p_size % 4) * 3.0 WHEN 2 THEN p_size * 0.5 WHEN 3 THEN p_size % 20 ELSE 9.0 END), 6) AS height FROM part""")
def resolved_heights(v: Views) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size")
    text = lambda n, x: F.when(k == n, x)
    h = records.building_height(text(0, s.cast("string")), text(1, F.concat((s % 4).cast("string"), F.lit(" st"))), text(2, F.concat((s * 0.5).cast("string"), F.lit(" m"))), text(3, (s % 20).cast("string")), 9.0)
    return v.part.select(F.col("p_partkey").alias("id"), F.round(h, 6).alias("height"))


@query("""WITH f AS (SELECT o_orderkey AS id, lower(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 'Grass' END, CASE WHEN o_orderkey % 6 = 1 THEN 'Wood' END, CASE WHEN o_orderkey % 5 = 2 THEN 'Park' END, CASE WHEN o_orderkey % 3 = 0 THEN 'odd' END)) AS category FROM orders), p AS (SELECT unnest(['grass', 'wood', 'park', 'water']) AS category, unnest([1, 2, 3, 4]) AS colour)
SELECT id, f.category, colour FROM f JOIN p ON p.category = f.category""")
def land_categories(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    f = v.orders.select(k.alias("id"), records.land_use(F.when(k % 4 == 0, "Grass").otherwise(""), F.when(k % 6 == 1, "Wood"), F.when(k % 5 == 2, "Park").otherwise(""), F.when(k % 3 == 0, "odd")).alias("category"))
    palette = v.spark.createDataFrame([("grass", 1), ("wood", 2), ("park", 3), ("water", 4)], "category string, colour int")
    return f.join(F.broadcast(palette), "category").select("id", "category", "colour")


@query("""SELECT "row", col, CASE WHEN band = 0 THEN CASE WHEN building THEN 0 ELSE 1 END ELSE CASE WHEN building THEN 2 ELSE 3 END END AS day, CASE WHEN band = 0 THEN least(col % 4, 2) ELSE 3 + least(col % 4, 2) END AS night FROM cells""", "cells")
def surface_classes(v: Views) -> DataFrame:
    road = F.col("band") == 0
    return v.cells.select("row", "col", records.day_class(road, F.col("building")).alias("day"), records.night_class(road, F.col("col") % 4).alias("night"))


@query("""SELECT p_partkey AS id, left(p_name || ' of the long and winding list of materials kept here', 60) AS label, least(greatest(CAST(p_retailprice - 100 AS DOUBLE), 0), 1000) AS infil_mmh, least(greatest(p_size / 50.0, 0.01), 0.5) AS manning_n, least(greatest((p_size - 20) / 10.0, 0), 1) AS depression_m, least(coalesce(CASE WHEN p_size % 2 = 0 THEN p_size / 20.0 END, 0.0), 1) AS erodible_frac FROM part""")
def clamped_materials(v: Views) -> DataFrame:
    s = F.col("p_size")
    m = v.part.select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" of the long and winding list of materials kept here")).alias("label"), (F.col("p_retailprice") - 100).cast("double").alias("infil_mmh"),
        (s / 50.0).alias("manning_n"), ((s - 20) / 10.0).alias("depression_m"), F.when(s % 2 == 0, s / 20.0).alias("erodible_frac"),
    )
    return records.clamped_materials(m)


@query("SELECT c_custkey AS id, left(sha1(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR))), 12) AS key FROM customer")
def content_keys(v: Views) -> DataFrame:
    return v.customer.select(F.col("c_custkey").alias("id"), records.content_key(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("key"))


@query("""WITH b AS (SELECT band AS design, "row" // 16 AS block, sha256(string_agg(format('{:06d}:{:06d}:', "row", col) || CAST(col % 7 AS VARCHAR), ',' ORDER BY format('{:06d}:{:06d}:', "row", col) || CAST(col % 7 AS VARCHAR))) AS h FROM cells GROUP BY 1, 2) SELECT design, sha256(string_agg(format('{:06d}=', block) || h, ',' ORDER BY block)) AS sha256 FROM b GROUP BY 1""", "cells")
def design_hashes(v: Views) -> DataFrame:
    return records.design_hash(v.cells.select(F.col("band").alias("design"), "row", "col", (F.col("col") % 7).alias("value")), ["design"])


@query("SELECT n_nationkey AS storm, n_name || ' (' || CAST(n_nationkey * 3 + 10 AS VARCHAR) || ' mm)' AS title, round(12.0 * (1 - n_nationkey % 5 * 0.1) * 1.5, 6) AS desired FROM nation")
def storm_titles_and_speeds(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    return v.nation.select(k.alias("storm"), records.storm_title(F.col("n_name"), (k * 3 + 10).cast("double")).alias("title"), F.round(F.lit(12.0) * (1 - k % 5 * 0.1) * 1.5, 6).alias("desired"))


@query("SELECT row_id, CASE WHEN vclass IN ('tram', 'other') THEN 'passenger' ELSE vclass END AS vclass, CAST(CASE WHEN row_id % 3 = 0 THEN 2 ELSE row_id % 3 END AS BIGINT) AS stage FROM veh", "veh")
def live_snapshots(v: Views) -> DataFrame:
    """Vehicles whose class says nothing are passenger cars; persons without a stage walk (2)."""
    raw = v.veh.withColumn("vclass", F.when(F.col("vclass") == "tram", "DEFAULT").when(F.col("vclass") == "other", "").otherwise(F.col("vclass")))
    stage = F.coalesce(F.when(F.col("row_id") % 3 != 0, F.col("row_id") % 3), F.lit(2)).cast("long")
    return records.vehicle_snapshot(raw).select("row_id", "vclass", stage.alias("stage"))


@query("""WITH s AS (SELECT n_nationkey AS signal, replace(replace(left(n_name || 'GGGG', 4), 'A', 'r'), 'I', 'y') AS state FROM nation) SELECT signal, signal * 0.5 + i AS lon, 30.0 + i AS lat, substr(state, i + 1, 1) AS state FROM s, (SELECT unnest(range(4)) AS i)""")
def signal_link_states(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    s = v.nation.select(k.alias("signal"), F.translate(F.substring(F.concat("n_name", F.lit("GGGG")), 1, 4), "AI", "ry").alias("state"))
    links = v.nation.select(k.alias("signal"), F.explode(F.array(*(F.lit(j) for j in range(4)))).alias("position")).select("signal", "position", (F.col("signal") * 0.5 + F.col("position")).alias("lon"), (30.0 + F.col("position")).alias("lat"))
    return records.link_states(s, links)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 90 + 0.5 WHEN c_custkey % 4 = 1 THEN n_nationkey * 2.0 WHEN c_custkey % 4 = 2 AND r_regionkey IS NOT NULL THEN r_regionkey + 40.0 END AS lat, CASE WHEN c_custkey % 4 = 0 THEN -(c_custkey % 70) * 1.0 WHEN c_custkey % 4 = 1 THEN n_nationkey * 3.0 WHEN c_custkey % 4 = 2 AND r_regionkey IS NOT NULL THEN r_regionkey + 50.0 END AS lon
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_custkey % 9""")
def geocoded_addresses(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    place = lambda a, key, x, dx, y, dy: v.__getattr__(a).select(F.col(key).alias("address"), (F.col(x) * dx[0] + dx[1]).alias("lat"), (F.col(y) * dy[0] + dy[1]).alias("lon"))
    presets = place("nation", "n_name", "n_nationkey", (2.0, 0.0), "n_nationkey", (3.0, 0.0))
    cache = place("region", "r_name", "r_regionkey", (1.0, 40.0), "r_regionkey", (1.0, 50.0))
    c = v.customer.join(F.broadcast(v.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(v.region), k % 9 == F.col("r_regionkey"), "left")
    a = F.when(k % 4 == 0, F.concat((k % 90 + 0.5).cast("string"), F.lit(" , "), (-(k % 70)).cast("string"))).when(k % 4 == 1, F.concat(F.lit(" "), F.lower("n_name"))).when(k % 4 == 2, F.col("r_name")).otherwise("nowhere")
    rows = c.select(k.alias("id"), a.alias("address"))
    return records.place_of(F.col("address"), presets, cache, rows).select("id", "lat", "lon")


@query("""WITH w AS (SELECT s_suppkey AS id, unnest(range(s_suppkey % 4)) AS part FROM supplier) SELECT id, CAST(part AS INT) AS part, CAST(3 + part AS INT) AS corners FROM w""")
def water_parts(v: Views) -> DataFrame:
    """Water features of several polygons, one row each; features without any give none."""
    k = F.col("s_suppkey")
    n = (k % 4).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_repeat(F.lit(0.5), 3 + i))).otherwise(F.array().cast("array<array<double>>"))
    return records.parts_of(v.supplier.select(k.alias("id"), parts.alias("parts")), "id", "parts").select("id", "part", F.size("ring").alias("corners"))


@query("""WITH s AS (SELECT event_id % 40 AS frame, CASE event_id % 3 WHEN 0 THEN 'agents' WHEN 1 THEN 'noise' ELSE 'draw' END AS category, value / 1000.0 AS seconds FROM events WHERE event_id % 5 <> 2), f AS (SELECT unnest(range(50)) AS frame), e AS (SELECT frame, unnest(['agents', 'noise', 'draw', 'idle']) AS category FROM f),
p AS (SELECT e.category, coalesce(sum(seconds), 0.0) AS s FROM e LEFT JOIN s ON s.frame = e.frame AND s.category = e.category GROUP BY e.frame, e.category)
SELECT category, 'call' AS grain, CAST(count(*) AS BIGINT) AS n, round(avg(seconds), 6) AS mean, round(max(seconds), 6) AS top FROM s GROUP BY 1 UNION ALL SELECT category, 'frame', CAST(count(*) AS BIGINT), round(avg(s), 6), round(max(s), 6) FROM p GROUP BY 1""")
def profile_grains(v: Views) -> DataFrame:
    k = F.col("event_id")
    s = v.events.where(k % 5 != 2).select((k % 40).alias("frame"), F.when(k % 3 == 0, "agents").when(k % 3 == 1, "noise").otherwise("draw").alias("category"), (F.col("value") / 1000.0).alias("seconds"))
    out = records.profile(s, v.spark.range(50).withColumnRenamed("id", "frame"), ["agents", "noise", "draw", "idle"])
    return out.select("category", "grain", "n", F.round("mean", 6).alias("mean"), F.round("top", 6).alias("top"))


_STEPS = "steps AS (SELECT o_custkey AS run, o_orderkey, CAST(sum(o_orderkey % 50 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS t FROM orders)"


def steps(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return v.orders.select(F.col("o_custkey").alias("run"), "o_orderkey", F.sum(F.col("o_orderkey") % 50 + 1).over(w).cast("double").alias("t"))


@query(f"""WITH {_STEPS}, x AS (SELECT run, t, floor(t / 60) > coalesce(floor(lag(t) OVER w / 60), 0) OR lead(t) OVER w IS NULL AS due FROM steps WINDOW w AS (PARTITION BY run ORDER BY t)) SELECT run, t FROM x WHERE due""")
def saved_frames(v: Views) -> DataFrame:
    return records.frames_saved(steps(v), ["run"], "t", 60.0).select("run", "t")


@query(f"""WITH {_STEPS}, p AS (SELECT run, t, CAST(floor(t / 40) AS BIGINT) AS done, lag(CAST(floor(t / 40) AS BIGINT)) OVER (PARTITION BY run ORDER BY t) AS b FROM steps) SELECT run, t, done FROM p WHERE b IS NULL OR b <> done""")
def pushed_progress(v: Views) -> DataFrame:
    return records.changes_only(steps(v).select("run", "t", F.floor(F.col("t") / 40).alias("done")), ["run"], "t", "done")


@query(f"""WITH {_STEPS} SELECT run, max(t) AS t, round(least(max(t) / 300.0, 1.0), 6) AS fraction, max(t) >= 300 AS finished FROM steps GROUP BY run""")
def latest_progress(v: Views) -> DataFrame:
    p = steps(v).select("run", "t", F.round(F.least(F.col("t") / 300.0, F.lit(1.0)), 6).alias("fraction"), (F.col("t") >= 300).alias("finished"))
    return records.latest(p, ["run"], "t")


@query(f"""WITH {_STEPS}, p AS (SELECT run, t, o_orderkey % 5 = 0 AS ok FROM steps), l AS (SELECT *, max(CASE WHEN ok THEN t END) OVER w AS last, sum(CAST(ok AS INT)) OVER w AS good FROM p WINDOW w AS (PARTITION BY run ORDER BY t)),
a AS (SELECT run, t, ok, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY run, good ORDER BY t) AS BIGINT) AS failures, t - last AS age FROM l)
SELECT *, coalesce(age > 45, false) AND NOT coalesce(lag(age) OVER (PARTITION BY run ORDER BY t) > 45, false) AS warn FROM a""")
def stale_feeds(v: Views) -> DataFrame:
    return records.stale(steps(v).select("run", "t", (F.col("o_orderkey") % 5 == 0).alias("ok")), ["run"], "t", "ok", 15.0)


@query("SELECT o_orderkey AS job, o_custkey AS design, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS accepted, CASE WHEN o_orderkey % 3 = 0 THEN 3600.0 ELSE 600.0 + o_custkey % 5 * 300.0 END AS duration FROM orders")
def queued_jobs(v: Views) -> DataFrame:
    """One waiting job for each design; runs without a duration take their storm's."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    storms = v.orders.select((c % 5).alias("storm")).distinct().withColumn("storm_s", 600.0 + F.col("storm") * 300.0)
    jobs = v.orders.select(k.alias("job"), c.alias("design"), (c % 5).alias("storm"), F.when(k % 3 == 0, F.lit(3600.0)).alias("asked")).join(F.broadcast(storms), "storm")
    return records.one_active(jobs, "design", "job").select("job", "design", "accepted", F.coalesce("asked", "storm_s").alias("duration"))


@query("""WITH w AS (SELECT c_custkey AS wish, 'd' || CAST(c_custkey % 61 AS VARCHAR) AS name, CASE c_custkey % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'official' WHEN 2 THEN 'd' || CAST(c_custkey % 35 AS VARCHAR) ELSE 'nothing' END AS template FROM customer), d AS (SELECT 'd' || CAST(n_nationkey AS VARCHAR) AS name FROM nation)
SELECT wish, name, template, CASE WHEN name IN (SELECT name FROM d) OR row_number() OVER (PARTITION BY name ORDER BY wish) > 1 THEN 'duplicate' WHEN template IN ('blank', 'official') OR template IN (SELECT name FROM d) THEN 'created' ELSE 'unknown template' END AS result FROM w""")
def design_creation(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    wanted = v.customer.select(k.alias("wish"), name(k % 61).alias("name"), F.when(k % 4 == 0, "blank").when(k % 4 == 1, "official").when(k % 4 == 2, name(k % 35)).otherwise("nothing").alias("template"))
    return records.created(v.nation.select(name(F.col("n_nationkey")).alias("name")), wanted, ["blank", "official"])


@query("SELECT n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'own' ELSE 'shipped' END AS source FROM nation ORDER BY 1")
def storm_catalogue(v: Views) -> DataFrame:
    """Storms by name: one's own folder comes before the shipped one."""
    n = v.nation.select(F.col("n_nationkey").alias("name"))
    return records.first_found(n.where("name % 3 = 0").withColumn("source", F.lit("own")), n.withColumn("source", F.lit("shipped")), key="name").orderBy("name")


@query("SELECT s_suppkey AS grid, CAST(s_suppkey * 100 AS DOUBLE) AS minx, CAST(s_suppkey * 50 AS DOUBLE) AS miny, 2.5 AS res, 40 + s_suppkey % 9 AS width, 30 + s_suppkey % 7 AS height, s_suppkey * 50 + (30 + s_suppkey % 7) * 2.5 AS maxy FROM supplier")
def affine_documents(v: Views) -> DataFrame:
    """Grid records written as JSON documents and read again."""
    k = F.col("s_suppkey")
    g = v.supplier.select(k.alias("grid"), (k * 100).cast("double").alias("minx"), (k * 50).cast("double").alias("miny"), F.lit(2.5).cast("double").alias("res"), (40 + k % 9).alias("width"), (30 + k % 7).alias("height"))
    return records.through_json(records.affine_document(g), "affine")


@query("SELECT c_nationkey AS slot, c_custkey AS edge, c_custkey % 7 = 0 AS blocked, c_name AS label FROM customer")
def scenario_slots(v: Views) -> DataFrame:
    """Scenario documents, one folder a slot, and the network's XML beside them."""
    s = v.customer.select(F.col("c_nationkey").alias("slot"), F.col("c_custkey").alias("edge"), (F.col("c_custkey") % 7 == 0).alias("blocked"))
    net = records.through_xml(v.customer.select(F.col("c_custkey").alias("edge"), F.col("c_name").alias("label")), "network", "edge_row")
    return records.through_json(s, "scenario", ["slot"]).join(net, "edge").select("slot", "edge", "blocked", "label")


@query("""SELECT CAST(tick AS BIGINT) AS tick, round(max(value) FILTER (g = 0), 6) AS h_0, round(max(value) FILTER (g = 1), 6) AS h_1, round(max(value) FILTER (g = 2), 6) AS h_2 FROM (SELECT event_id // 10 AS tick, event_id % 3 AS g, value FROM events) GROUP BY 1""")
def gauge_series(v: Views) -> DataFrame:
    """Gauges side by side by time, written as a table of text and read again."""
    e = v.events.select(F.floor(F.col("event_id") / 10).alias("tick"), (F.col("event_id") % 3).alias("g"), "value")
    wide = e.groupBy("tick").pivot("g", [0, 1, 2]).agg(F.round(F.max("value"), 6)).select("tick", *(F.col(str(k)).alias(f"h_{k}") for k in range(3)))
    return records.through_csv(wide, "gauges")


@query("""SELECT band, CAST(count(*) AS BIGINT) AS cells, round(min(dem), 6) AS least, round(max(dem), 6) AS top, CAST(count(CASE WHEN NOT water THEN dem END) AS BIGINT) AS n, round(sum(CASE WHEN NOT water THEN dem END), 4) AS total FROM (SELECT band, water, CASE WHEN water THEN NULL ELSE dem END AS dem FROM cells) GROUP BY band""", "cells")
def grid_statistics(v: Views) -> DataFrame:
    """Computed once and written; later calls read the table."""
    c = v.cells.withColumn("dem", F.when(~F.col("water"), F.col("dem")))
    path = records.own_folder(v.spark, "stats")
    for _ in range(2):
        out = records.read_through(v.spark, path, lambda: records.grid_stats(c, ["band"], "dem"))
    return out.select("band", "cells", F.round("least", 6).alias("least"), F.round("top", 6).alias("top"), "n", F.round("total", 4).alias("total"))


@query("""SELECT CAST(count(*) AS BIGINT) AS kept, min(z) AS least, max(z) AS top FROM (SELECT CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 91 % 1000 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part) WHERE x BETWEEN 100 AND 800 AND y BETWEEN 200 AND 900 AND x + y <= 1300""")
def cropped_cloud(v: Views) -> DataFrame:
    """Points in a box, then in the triangle under its diagonal."""
    k = F.col("p_partkey")
    p = v.part.select((k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    c = records.inundation_crop(p, (100, 200, 800, 900), F.col("x") + F.col("y") <= 1300)
    return c.agg(F.count("*").alias("kept"), F.min("z").alias("least"), F.max("z").alias("top"))


@query("""SELECT r.run, meta.storm, peak, closure FROM (SELECT o_custkey AS run, max(CAST(o_totalprice AS DOUBLE)) AS peak FROM orders GROUP BY 1) r JOIN (SELECT c_custkey AS run, c_nationkey AS storm FROM customer WHERE c_custkey % 3 <> 0) meta ON meta.run = r.run JOIN (SELECT o_custkey AS run, round(avg(o_orderkey % 10) / 10.0, 6) AS closure FROM orders GROUP BY 1 HAVING count(*) > 5) c ON c.run = r.run""")
def collected_runs(v: Views) -> DataFrame:
    """Summaries of complete runs: those that have results, a description and a check."""
    runs = v.orders.groupBy(F.col("o_custkey").alias("run")).agg(F.max(F.col("o_totalprice").cast("double")).alias("peak"))
    meta = v.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("storm"))
    check = v.orders.groupBy(F.col("o_custkey").alias("run")).agg(F.round(F.avg(F.col("o_orderkey") % 10) / 10.0, 6).alias("closure"), F.count("*").alias("n")).where("n > 5").drop("n")
    return records.through_json(runs, "summaries").join(records.through_json(meta, "meta"), "run").join(check, "run").select("run", "storm", "peak", "closure")


@query("""SELECT "row", col, round(dem, 6) AS dem, round(coalesce(CASE WHEN col % 3 = 0 THEN infil END, 0), 6) AS erodible, CASE WHEN "row" % 2 = 0 THEN round(band * 0.1, 6) END AS suction FROM cells""", "cells")
def raster_stack(v: Views) -> DataFrame:
    """Layers of a terrain joined by cell: a layer without a value is zero, an optional one stays empty."""
    c = v.cells
    erodible = c.where("col % 3 = 0").select("row", "col", F.col("infil").alias("e"))
    soil = c.where("row % 2 = 0").select("row", "col", F.round(F.col("band") * 0.1, 6).alias("suction"))
    out = c.select("row", "col", "dem").join(erodible, ["row", "col"], "left").join(soil, ["row", "col"], "left")
    return out.select("row", "col", F.round("dem", 6).alias("dem"), F.round(F.coalesce("e", F.lit(0.0)), 6).alias("erodible"), "suction")


@query("""SELECT row_id, CASE WHEN run = 0 THEN 'own' ELSE 'external' END AS engine, x, y, CASE WHEN run = 0 THEN speed_ms ELSE coalesce(CASE WHEN row_id % 4 <> 0 THEN speed_ms END, 0) END AS speed FROM veh""", "veh")
def engine_positions(v: Views) -> DataFrame:
    """Places and speeds of two engines as one relation; a missing speed is zero."""
    own = v.veh.where("run = 0").select("row_id", F.lit("own").alias("engine"), "x", "y", F.col("speed_ms").alias("speed"))
    other = v.veh.where("run <> 0").select("row_id", F.lit("external").alias("engine"), "x", "y", F.coalesce(F.when(F.col("row_id") % 4 != 0, F.col("speed_ms")), F.lit(0.0)).alias("speed"))
    return own.unionByName(other)


@query("""SELECT 'elevation' AS role, min(lower(replace(n_name, ' ', '-')) || '_dem.tif') AS file FROM nation UNION ALL SELECT 'image', min('ortho_' || n_nationkey || '.tif') FROM nation""")
def survey_files(v: Views) -> DataFrame:
    """Files of a survey by their names; roles without a file are missing."""
    from cityweave.sources.sinks import write_text

    root = records.own_folder(v.spark, "survey")
    names = v.nation.select(F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("_dem.tif")).alias("dem"), F.concat(F.lit("ortho_"), "n_nationkey", F.lit(".tif")).alias("image")).collect()
    for name in [*(f for r in names for f in r), "notes.txt"]:  # 25 nations
        write_text(v.spark, f"{root}/{name}", "x")
    return records.found_files(v.spark, root, {"elevation": "dem\\.tif$", "image": "^ortho", "cloud": "\\.las$"})


@query("""SELECT n_nationkey AS id, '<c><net-file value="n' || CAST(n_nationkey AS VARCHAR) || '"/><route-files value="new.rou"/><end value="9"/></c>' AS document FROM nation""")
def rewritten_settings(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    old = F.concat(F.lit('<c><net-file value="n'), k.cast("string"), F.lit('"/><route-files value="old.rou"/><end value="7"/></c>'))
    return v.nation.select(k.alias("id"), records.with_settings(old, {"route-files": "new.rou", "end": "9"}).alias("document"))


@query("""WITH a AS (SELECT "row", col, depth, least(greatest(depth / 2.0, 0), 1) * 2 AS t FROM cells), k AS (SELECT *, least(floor(t), 1) AS k FROM a)
SELECT "row", col, CAST(round(CASE k WHEN 0 THEN 250 + (t - k) * (60 - 250) ELSE 60 + (t - k) * (10 - 60) END) AS INT) AS red, CAST(round(CASE k WHEN 0 THEN 250 + (t - k) * (120 - 250) ELSE 120 + (t - k) * (20 - 120) END) AS INT) AS green, CAST(round(CASE k WHEN 0 THEN 255 + (t - k) * (220 - 255) ELSE 220 + (t - k) * (90 - 220) END) AS INT) AS blue, CASE WHEN depth < 0.01 THEN 0 ELSE 255 END AS alpha FROM k""", "cells")
def coloured_depths(v: Views) -> DataFrame:
    r, g, b, a = records.shaded(F.col("depth"), 2.0, [(250, 250, 255), (60, 120, 220), (10, 20, 90)])
    return v.cells.select("row", "col", r.alias("red"), g.alias("green"), b.alias("blue"), a.alias("alpha"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS top FROM orders")
def watched_write(v: Views) -> DataFrame:
    """What a job reports of the rows that pass while it writes them; a first place that can't be written is passed over."""
    path = records.own_folder(v.spark, "watched")

    def write(place: str) -> dict:
        if not place:
            raise OSError("no place")
        return records.observed(v.orders, lambda df: df.write.parquet(place), n=F.count("*"), top=F.max("o_orderkey"))

    got = records.retried(write, ["", path])
    return v.spark.createDataFrame([(got["n"], got["top"])], "n long, top long")


@query("""WITH f AS (SELECT "row" // 4 * 100 + col // 5 AS region, avg(CASE WHEN band >= 2 THEN 1 ELSE 0 END) AS share FROM cells WHERE building GROUP BY 1) SELECT region, round(share, 6) AS share FROM f WHERE share >= 0.5 AND region % 7 <> 0""", "cells")
def lots_to_flatten(v: Views) -> DataFrame:
    """Buildings of which half lies in the corridor, less those under protection."""
    b = v.cells.where("building").withColumn("region", F.floor(F.col("row") / 4) * 100 + F.floor(F.col("col") / 5))
    keep = b.where("region % 7 = 0").select("region").distinct()
    return records.flattened(b, "region", F.col("band") >= 2, keep).select("region", F.round("share", 6).alias("share"))
