"""Queries on street graphs, trips and points against spans and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators import network, trips
from cityweave.plans.bindings import CHAIN
from cityweave.plans.registry import Views, query

# lines of three points, one per order, that share ends; a street runs along the order's customer
_LINES = """pts AS (SELECT o_orderkey AS line, pos, CAST((o_custkey * 13 + pos * (3 + o_orderkey % 4)) % 61 - 30 AS DOUBLE) * 20 + 0.5 AS x, CAST((o_custkey * 29 + pos * (2 + o_orderkey % 3)) % 53 - 26 AS DOUBLE) * 20 + 0.25 AS y FROM orders, (SELECT unnest([0, 1, 2]) AS pos)),
pcs AS (SELECT line, pos, x AS x1, y AS y1, x2, y2, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS length FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY line ORDER BY pos)) WHERE x2 IS NOT NULL)"""


def lines(v: Views) -> DataFrame:
    p, o, c = F.col("pos"), F.col("o_orderkey"), F.col("o_custkey")
    e = v.orders.select(o, c, F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("pos"))
    x = (((c * 13 + p * (3 + o % 4)) % 61 - 30).cast("double") * 20 + 0.5).alias("x")
    y = (((c * 29 + p * (2 + o % 3)) % 53 - 26).cast("double") * 20 + 0.25).alias("y")
    return e.select(o.alias("line"), "pos", x, y)


def graph(v: Views) -> tuple[DataFrame, DataFrame]:
    rules = v.orders.select(F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 3 == 0).alias("oneway"), (F.col("o_orderkey") % 2 == 0).alias("legal_forward"))
    return trips.street_graph(trips.pieces(lines(v), "line"), rules, "line")


_GRAPH = f"""{_LINES}, ends AS (SELECT line, round(arg_min(x1, pos), 2) AS ax, round(arg_min(y1, pos), 2) AS ay, round(arg_max(x2, pos), 2) AS bx, round(arg_max(y2, pos), 2) AS ey, sum(length) AS length FROM pcs GROUP BY line),
places AS (SELECT ax AS x, ay AS y FROM ends UNION SELECT bx, ey FROM ends), nodes AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS node_id, x, y FROM places),
e AS (SELECT line, a.node_id AS u, b.node_id AS v, length, line % 3 = 0 AS oneway, line % 2 = 0 AS legal FROM ends JOIN nodes a ON a.x = ax AND a.y = ay JOIN nodes b ON b.x = bx AND b.y = ey)"""


@query(f"WITH {_GRAPH} SELECT u, v, line, round(length, 6) AS length, false AS reversed FROM e WHERE NOT oneway OR legal UNION ALL SELECT v, u, line, round(length, 6), true FROM e WHERE NOT oneway OR NOT legal")
def directed_street_edges(v: Views) -> DataFrame:
    return graph(v)[1].withColumn("length", F.round("length", 6))


@query(f"WITH {_GRAPH} SELECT node_id, x, y FROM nodes")
def street_nodes(v: Views) -> DataFrame:
    return graph(v)[0]


@query(f"""WITH {_LINES}, q AS (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS a, x1 * (x2 - x1) + y1 * (y2 - y1) AS b, x1 * x1 + y1 * y1 - 160000 AS c FROM pcs),
t AS (SELECT *, greatest(0.0, (-b - sqrt(b * b - a * c)) / a) AS t0, least(1.0, (-b + sqrt(b * b - a * c)) / a) AS t1 FROM (SELECT * FROM q WHERE a > 0 AND b * b - a * c > 0)), k AS (SELECT *, lag(pos) OVER w AS pp, lag(t1) OVER w AS pt FROM t WHERE t1 > t0 WINDOW w AS (PARTITION BY line ORDER BY pos)),
r AS (SELECT *, sum(CASE WHEN pp = pos - 1 AND pt = 1 AND t0 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY pos) AS run FROM k), s AS (SELECT line, run, sum(length * (t1 - t0)) AS total, count(*) AS n FROM r GROUP BY ALL)
SELECT line, round(total, 6) AS length, CAST(n AS BIGINT) AS pieces FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY total DESC, run) AS o FROM s) WHERE o = 1""")
def clipped_streets(v: Views) -> DataFrame:
    c = trips.clip_to_disc(trips.pieces(lines(v), "line"), "line", 400.0)
    return c.groupBy("line").agg(F.round(F.sum("length"), 6).alias("length"), F.count("*").alias("pieces"))


@query("""WITH l AS (SELECT o_orderkey AS line, o_custkey % 23 + 0.5 AS len FROM orders), d AS (SELECT line, len, unnest(range(CAST(ceil(len / 2.0) AS BIGINT))) AS number FROM l) SELECT line, number, round(number * 2.0, 6) AS start, round(least(number * 2.0 + 1, len), 6) AS "end" FROM d""")
def dashed_lines(v: Views) -> DataFrame:
    d = trips.dashes(v.orders.select(F.col("o_orderkey").alias("line"), (F.col("o_custkey") % 23 + 0.5).cast("double").alias("len")), "line", "len")
    return d.select("line", "number", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


# shortest times along the chains are prefix sums
_TIMES = f"""nodes AS (SELECT CAST(c_custkey AS BIGINT) AS node_id, CAST(c_custkey % {CHAIN} * 100 AS DOUBLE) AS x, CAST(c_custkey // {CHAIN} % 11 * 130 AS DOUBLE) AS y FROM customer),
f AS (SELECT node_id, coalesce(sum(length) OVER (PARTITION BY node_id // {CHAIN} ORDER BY node_id), 0) AS s FROM (SELECT n.node_id, length FROM nodes n LEFT JOIN streets e ON e.v = n.node_id AND dir = 1)),
g AS (SELECT node_id, coalesce(sum(length) OVER (PARTITION BY node_id // {CHAIN} ORDER BY node_id), 0) AS s FROM (SELECT n.node_id, length FROM nodes n LEFT JOIN streets e ON e.u = n.node_id AND dir = -1)),
times AS (SELECT a.node_id AS source, b.node_id, CASE WHEN b.node_id >= a.node_id THEN fb.s - fa.s ELSE ga.s - gb.s END AS cost FROM nodes a JOIN nodes b ON a.node_id // {CHAIN} = b.node_id // {CHAIN} JOIN f fa ON fa.node_id = a.node_id JOIN f fb ON fb.node_id = b.node_id JOIN g ga ON ga.node_id = a.node_id JOIN g gb ON gb.node_id = b.node_id)"""


def street_places(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    return v.customer.select(k.cast("long").alias("node_id"), (k % CHAIN * 100).cast("double").alias("x"), (F.floor(k / CHAIN) % 11 * 130).cast("double").alias("y"))


def od_pairs(v: Views) -> DataFrame:
    n = F.col("n")
    return trips.sample_pairs(street_places(v), 480, F.col("k") * 7919 % n, (F.col("k") * 7919 + F.col("k") % 9 + 2) % n)


_PAIRS = """place AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS p, count(*) OVER () AS n FROM nodes), tries AS (SELECT k, k * 7919 % n AS o, (k * 7919 + k % 9 + 2) % n AS d FROM (SELECT unnest(range(480)) AS k), (SELECT count(*) AS n FROM nodes)),
pairs AS (SELECT k, a.node_id AS u, b.node_id AS v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS beeline FROM tries JOIN place a ON a.p = o JOIN place b ON b.p = d WHERE o <> d)"""


@query(f"WITH {_TIMES} SELECT source, node_id, round(cost, 6) AS cost FROM times WHERE source % {CHAIN} = 0", "streets")
def street_chain_times(v: Views) -> DataFrame:
    """Times from the head of every chain: many hops, as many sources as chains."""
    heads = street_places(v).where(F.col("node_id") % CHAIN == 0).select("node_id")
    return network.shortest_paths(v.streets, heads, "length").withColumn("cost", F.round("cost", 6))


@query(f"WITH n AS (SELECT u FROM streets UNION SELECT v FROM streets) SELECT u AS node_id, min(u) OVER (PARTITION BY u // {CHAIN}) AS component FROM n", "streets")
def street_components(v: Views) -> DataFrame:
    return network.components(v.streets)


@query(f"WITH {_TIMES}, {_PAIRS} SELECT k, u, v, round(beeline, 6) AS beeline, round(t.cost, 6) AS sim_s, round(beeline * 0.12, 6) AS ref_s FROM (SELECT * FROM pairs WHERE beeline BETWEEN 200 AND 2500) JOIN times t ON t.source = u AND t.node_id = v ORDER BY k LIMIT 40", "streets")
def validation_pairs(v: Views) -> DataFrame:
    """The first 40 of 480 sampled pairs in the distance band that have a way; the reference engine is a function of the pair."""
    pairs = od_pairs(v)
    times = network.shortest_paths(v.streets, pairs.select(F.col("u").alias("node_id")).distinct(), "length")
    m = trips.first_matched(pairs, times, 40, "sim_s")
    return m.select("k", "u", "v", F.round("beeline", 6).alias("beeline"), F.round("sim_s", 6).alias("sim_s"), F.round(F.col("beeline") * 0.12, 6).alias("ref_s"))


_SLOW = "CASE WHEN u % 3 = 0 THEN 1.5 ELSE 1.0 END"


@query(f"""WITH slow AS (SELECT u, v, length * {_SLOW} AS length, dir FROM streets), {_TIMES.replace("JOIN streets", "JOIN slow")}, {_PAIRS}, m AS (SELECT u % 2 AS cls, t.cost AS sim_s, beeline * 0.12 AS ref_s FROM (SELECT * FROM pairs WHERE beeline BETWEEN 200 AND 2500) JOIN times t ON t.source = u AND t.node_id = v ORDER BY k LIMIT 30)
SELECT cls, CAST(count(*) AS BIGINT) AS n, round(avg(abs(sim_s - ref_s)), 6) AS mae, round(sqrt(avg((sim_s - ref_s) * (sim_s - ref_s))), 6) AS rmse, round(avg(100 * (sim_s - ref_s) / ref_s), 6) AS bias_pct FROM m GROUP BY cls""", "streets")
def congested_validation(v: Views) -> DataFrame:
    """Errors by class over times on congested streets."""
    pairs = od_pairs(v)
    slow = v.streets.withColumn("length", F.col("length") * F.when(F.col("u") % 3 == 0, 1.5).otherwise(1.0))
    m = trips.first_matched(pairs, network.shortest_paths(slow, pairs.select(F.col("u").alias("node_id")).distinct(), "length"), 30, "sim_s").withColumn("ref_s", F.col("beeline") * 0.12)
    e = F.col("sim_s") - F.col("ref_s")
    return m.groupBy((F.col("u") % 2).alias("cls")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(100 * e / F.col("ref_s")), 6).alias("bias_pct"))


@query(f"""WITH {_TIMES}, {_PAIRS}, a AS (SELECT k, u, v, t.cost AS first_s FROM (SELECT * FROM pairs WHERE beeline BETWEEN 200 AND 2500 AND k < 300) JOIN times t ON t.source = u AND t.node_id = v ORDER BY k LIMIT 30)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(first_s - (abs(u - v) * 16.5)), 6) AS mean_difference, round(corr(first_s, abs(u - v) * 16.5), 6) AS correlation FROM a""", "streets")
def engine_comparison(v: Views) -> DataFrame:
    """Two engines over shared pairs: times along streets, and a fixed time for each hop."""
    pairs = od_pairs(v).where("k < 300")
    a = trips.first_matched(pairs, network.shortest_paths(v.streets, pairs.select(F.col("u").alias("node_id")).distinct(), "length"), 30, "first_s").withColumn("second_s", F.abs(F.col("u") - F.col("v")) * 16.5)
    return a.agg(F.count("*").alias("n"), F.round(F.avg(F.col("first_s") - F.col("second_s")), 6).alias("mean_difference"), F.round(F.corr("first_s", "second_s"), 6).alias("correlation"))


_STOPS = f"stops AS (SELECT n_nationkey AS trip, i AS pos, CAST((n_nationkey * 7 + CASE WHEN n_nationkey % 4 = 3 THEN i * {CHAIN} ELSE i * 3 END) % 100 + 1 AS BIGINT) AS node_id FROM nation, (SELECT unnest(range(4)) AS i))"


@query(f"""WITH {_TIMES}, {_STOPS}, l AS (SELECT trip, node_id AS a, lead(node_id) OVER (PARTITION BY trip ORDER BY pos) AS b FROM stops) SELECT trip, CAST(count(*) AS BIGINT) AS legs, round(sum(cost), 6) AS cost FROM l LEFT JOIN times t ON t.source = a AND t.node_id = b WHERE b IS NOT NULL GROUP BY trip HAVING bool_and(cost IS NOT NULL)""", "streets")
def routed_bus_trips(v: Views) -> DataFrame:
    """Trips whose stops are all joined by a way; any leg without one drops the trip."""
    k, i = F.col("n_nationkey"), F.col("i")
    stops = v.nation.select(k, F.explode(F.array(*(F.lit(j) for j in range(4)))).alias("i")).select(k.alias("trip"), i.alias("pos"), ((k * 7 + F.when(k % 4 == 3, i * CHAIN).otherwise(i * 3)) % 100 + 1).cast("long").alias("node_id"))
    times = network.shortest_paths(v.streets, stops.select("node_id").distinct(), "length")
    return trips.routed_trips(stops, times, "trip", "pos").withColumn("cost", F.round("cost", 6))


@query("""WITH f AS (SELECT o_custkey % 24 AS hour, o_orderkey AS car FROM orders WHERE o_orderkey % 4 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY CASE WHEN car <= 500 THEN 1 ELSE 0 END, car) AS turn FROM f) SELECT hour, car, CAST(turn AS INT) AS turn FROM r WHERE turn <= 8""")
def reassigned_trips(v: Views) -> DataFrame:
    """Of the cars that finished, eight each hour are given a new trip, from the cursor on, round robin."""
    f = v.orders.where("o_orderkey % 4 = 1").select((F.col("o_custkey") % 24).alias("hour"), F.col("o_orderkey").alias("car"))
    return trips.budgeted(f, ["hour"], "car", F.lit(500), 8)


@query("""WITH t AS (SELECT o_custkey AS unit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, CAST(o_orderkey * 37 % 260 AS DOUBLE) AS m FROM orders), b AS (SELECT unit, min(k) FILTER (k < 20 AND m >= 200) AS g FROM t GROUP BY 1)
SELECT t.unit, CAST(t.k AS INT) AS k, m, g IS NULL AS fallback FROM t JOIN b ON b.unit = t.unit WHERE t.k = coalesce(g, 0)""")
def spawned_emergencies(v: Views) -> DataFrame:
    """The first of 20 tried routes of 200 m at least, else the first of all."""
    from pyspark.sql import Window

    k = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("k")
    t = v.orders.select(F.col("o_custkey").alias("unit"), k, (F.col("o_orderkey") * 37 % 260).cast("double").alias("m"))
    return trips.long_enough(t, "unit", "m")


@query("""WITH e AS (SELECT s_suppkey AS unit, CAST(s_suppkey % 5 AS DOUBLE) AS speed, 12.0 + s_suppkey % 7 AS target, 90.0 + s_suppkey % 11 AS route_m FROM supplier), s AS (SELECT *, unnest(range(1, 21)) AS step FROM e), w AS (SELECT *, least(target, speed + 3.0 * step) AS v FROM s), p AS (SELECT *, sum(v) OVER (PARTITION BY unit ORDER BY step) AS run FROM w)
SELECT unit, CAST(step AS DOUBLE) AS t, round(v, 6) AS speed, round(run - floor(run / route_m) * route_m, 6) AS along, CAST(floor(run / route_m) AS BIGINT) AS lap FROM p""")
def emergency_advance(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    e = v.supplier.select(k.alias("unit"), (k % 5).cast("double").alias("speed"), (12 + k % 7).cast("double").alias("target"), (90 + k % 11).cast("double").alias("route_m"))
    a = trips.advance(e, "unit", 20)
    return a.select("unit", "t", F.round("speed", 6).alias("speed"), F.round("along", 6).alias("along"), "lap")


@query("SELECT seq, u, v, CASE WHEN highway = 'footway' THEN 'pedestrian' ELSE 'vehicle' END AS layer, CASE WHEN highway = 'footway' THEN 0.3 ELSE 0.15 END AS z FROM edges", "edges")
def street_layers(v: Views) -> DataFrame:
    foot = F.col("highway") == "footway"
    return v.edges.select("seq", "u", "v", F.when(foot, "pedestrian").otherwise("vehicle").alias("layer"), F.when(foot, F.lit(0.3)).otherwise(F.lit(0.15)).alias("z"))


@query("SELECT 'kept' AS which, CAST(count(*) AS BIGINT) AS n FROM edges WHERE highway <> 'footway' UNION ALL SELECT 'whole', CAST(count(*) AS BIGINT) FROM edges", "edges")
def drivable_or_whole(v: Views) -> DataFrame:
    """A filter that keeps some edges, and one that keeps none and so gives the whole graph."""
    a = trips.subset_or_whole(v.edges, F.col("highway") != "footway").agg(F.lit("kept").alias("which"), F.count("*").alias("n"))
    return a.union(trips.subset_or_whole(v.edges, F.col("highway") == "canal").agg(F.lit("whole"), F.count("*")))


@query("""WITH c AS (SELECT DISTINCT path_id, (t_s // 3600) % 24 AS h FROM veh), w AS (SELECT DISTINCT path_id, unnest([3, 11, 18]) AS asked FROM veh), r AS (SELECT w.path_id, asked, h, h * 2 + w.path_id AS shade, row_number() OVER (PARTITION BY w.path_id, asked ORDER BY abs(h - asked), h) AS o FROM w JOIN c ON c.path_id = w.path_id) SELECT path_id, asked, h, shade FROM r WHERE o = 1""", "veh")
def nearest_cached_hour(v: Views) -> DataFrame:
    c = v.veh.select("path_id", (F.floor(F.col("t_s") / 3600) % 24).alias("h")).distinct().withColumn("shade", F.col("h") * 2 + F.col("path_id"))
    w = v.veh.select("path_id").distinct().withColumn("asked", F.explode(F.array(F.lit(3), F.lit(11), F.lit(18))))
    return trips.nearest_hour(c, w, ["path_id"], "h", "shade", "asked")


_SPANS = "spans AS (SELECT n_nationkey AS span, CAST(n_nationkey * 41 % 900 AS DOUBLE) AS x1, CAST(n_nationkey * 73 % 900 AS DOUBLE) AS y1, CAST(n_nationkey * 41 % 900 + 60 AS DOUBLE) AS x2, CAST(n_nationkey * 73 % 900 + n_nationkey % 9 * 11 AS DOUBLE) AS y2 FROM nation), tops AS (SELECT CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(p_partkey * 91 % 1000 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS z FROM part)"
_ST = "least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1)"


@query(f"""WITH {_SPANS}, near AS (SELECT span, max(z) AS top FROM spans, tops WHERE sqrt(pow(x - x1 - {_ST} * (x2 - x1), 2) + pow(y - y1 - {_ST} * (y2 - y1), 2)) < 12 GROUP BY span) SELECT s.span, greatest(6.0, coalesce(top + 3, 6.0)) AS deck FROM spans s LEFT JOIN near n ON n.span = s.span""")
def bridge_clearance(v: Views) -> DataFrame:
    k, p = F.col("n_nationkey"), F.col("p_partkey")
    d = lambda c: c.cast("double")
    spans = v.nation.select(k.alias("span"), d(k * 41 % 900).alias("x1"), d(k * 73 % 900).alias("y1"), d(k * 41 % 900 + 60).alias("x2"), d(k * 73 % 900 + k % 9 * 11).alias("y2"))
    tops = v.part.select(d(p * 37 % 1000).alias("x"), d(p * 91 % 1000).alias("y"), d(F.col("p_size")).alias("z"))
    return trips.clearance(tops, spans, "span")


_BOXES = "boxes AS (SELECT p_partkey AS box, CAST(p_partkey * 37 % 400 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 400 AS DOUBLE) AS y0, CAST(p_partkey * 37 % 400 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 91 % 400 + p_size % 13 + 1 AS DOUBLE) AS y1, CAST(p_size AS DOUBLE) AS z1 FROM part)"


def boxes(v: Views) -> DataFrame:
    p, s = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    return v.part.select(p.alias("box"), d(p * 37 % 400).alias("x0"), d(p * 91 % 400).alias("y0"), d(p * 37 % 400 + s).alias("x1"), d(p * 91 % 400 + s % 13 + 1).alias("y1"), d(s).alias("z1"))


def _slab(o: str, d: str, lo: str, hi: str) -> tuple[str, str]:
    return f"CASE WHEN {d} = 0 THEN CASE WHEN {o} BETWEEN {lo} AND {hi} THEN -1e300 ELSE 1e300 END ELSE least(({lo} - {o}) / nullif({d}, 0), ({hi} - {o}) / nullif({d}, 0)) END", f"CASE WHEN {d} = 0 THEN CASE WHEN {o} BETWEEN {lo} AND {hi} THEN 1e300 ELSE -1e300 END ELSE greatest(({lo} - {o}) / nullif({d}, 0), ({hi} - {o}) / nullif({d}, 0)) END"


_SLABS = [_slab("ox", "dx", "x0", "x1"), _slab("oy", "dy", "y0", "y1"), _slab("0.5", "dz", "0.0", "z1")]


@query(f"""WITH {_BOXES}, rays AS (SELECT box, (box * 17 % 400) * 1.0 AS ox, (box * 23 % 400) * 1.0 AS oy, CAST(box % 7 - 3 AS DOUBLE) AS dx, CAST(box % 5 - 2 AS DOUBLE) AS dy, CAST(box % 3 AS DOUBLE) * 0.1 AS dz FROM boxes)
SELECT b.box, greatest({', '.join(a for a, _ in _SLABS)}, 0.0) <= least({', '.join(b for _, b in _SLABS)}) AS hit FROM boxes b JOIN rays r ON r.box = b.box""")
def rays_on_boxes(v: Views) -> DataFrame:
    b, k = boxes(v), F.col("box")
    o = ((k * 17 % 400).cast("double"), (k * 23 % 400).cast("double"), F.lit(0.5))
    d = ((k % 7 - 3).cast("double"), (k % 5 - 2).cast("double"), (k % 3).cast("double") * 0.1)
    return b.select("box", trips.hits_box(o, d, (F.col("x0"), F.col("y0"), F.lit(0.0)), (F.col("x1"), F.col("y1"), F.col("z1"))).alias("hit"))


@query(f"""WITH {_BOXES}, c AS (SELECT box, x0, y0, x1, y1, bx, unnest(range(CAST(floor(y0 / 32) AS BIGINT), CAST(floor(y1 / 32) AS BIGINT) + 1)) AS "by" FROM (SELECT *, unnest(range(CAST(floor(x0 / 32) AS BIGINT), CAST(floor(x1 / 32) AS BIGINT) + 1)) AS bx FROM boxes))
SELECT bx, "by", CAST(count(*) AS BIGINT) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY bx, "by" """)
def plane_bucket_bounds(v: Views) -> DataFrame:
    return trips.bucket_bounds(trips.buckets(boxes(v), "box", 32.0))


@query(f"""WITH {_BOXES}, o AS (SELECT n_nationkey AS centre, CAST(n_nationkey * 31 % 400 AS DOUBLE) AS cx, CAST(n_nationkey * 57 % 400 AS DOUBLE) AS cy FROM nation), c AS (SELECT box, bx, unnest(range(CAST(floor(y0 / 32) AS BIGINT), CAST(floor(y1 / 32) AS BIGINT) + 1)) AS "by" FROM (SELECT *, unnest(range(CAST(floor(x0 / 32) AS BIGINT), CAST(floor(x1 / 32) AS BIGINT) + 1)) AS bx FROM boxes))
SELECT DISTINCT centre, box FROM o JOIN c ON pow(greatest(bx * 32 - cx, 0, cx - (bx + 1) * 32), 2) + pow(greatest("by" * 32 - cy, 0, cy - ("by" + 1) * 32), 2) <= 900""")
def boxes_in_reach(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    o = v.nation.select(k.alias("centre"), (k * 31 % 400).cast("double").alias("cx"), (k * 57 % 400).cast("double").alias("cy"))
    return trips.candidates(trips.buckets(boxes(v), "box", 32.0), o, "centre", "box", 30.0, 32.0)


@query("""WITH s AS (SELECT seq, CAST(u * 53 % 2000 AS DOUBLE) AS ax, CAST(u * 97 % 2000 AS DOUBLE) AS ay, CAST(v * 53 % 2000 AS DOUBLE) AS bx, CAST(v * 97 % 2000 AS DOUBLE) AS ey FROM edges), p AS (SELECT seq, k, ax + (bx - ax) * k / 4.0 AS x, ay + (ey - ay) * k / 4.0 AS y FROM s, (SELECT unnest(range(5)) AS k))
SELECT seq, round(avg(CASE WHEN CAST(floor(x / 250) AS BIGINT) % 2 = CAST(floor(y / 250) AS BIGINT) % 2 THEN 1.0 ELSE 0.0 END), 6) AS shaded FROM p GROUP BY seq""", "edges")
def edge_shadow_shares(v: Views) -> DataFrame:
    """Five places along each edge, the share of them in the shade of a chequered sky."""
    at = lambda c, m: (F.col(c) * m % 2000).cast("double")
    s = v.edges.select("seq", at("u", 53).alias("ax"), at("u", 97).alias("ay"), at("v", 53).alias("bx"), at("v", 97).alias("by"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    x, y = F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("k") / 4.0, F.col("ay") + (F.col("by") - F.col("ay")) * F.col("k") / 4.0
    return s.groupBy("seq").agg(F.round(F.avg(F.when(F.floor(x / 250) % 2 == F.floor(y / 250) % 2, 1.0).otherwise(0.0)), 6).alias("shaded"))


@query("""WITH l AS (SELECT s_suppkey AS path, s_suppkey % 40 + 0.5 AS r0, s_suppkey % 45 + 0.25 AS c0 FROM supplier), k AS (SELECT path, r0 + i * 0.8 AS r, c0 + i * 0.6 AS c, i FROM l, (SELECT unnest(range(6)) AS i))
SELECT path, CAST(i AS INT) AS i, round(dem, 6) AS z FROM k JOIN cells ON cells."row" = CAST(floor(r) AS BIGINT) AND cells.col = CAST(floor(c) AS BIGINT)""", "cells")
def path_heights(v: Views) -> DataFrame:
    """Heights of the ground every step along paths, by cell."""
    k = F.col("s_suppkey")
    p = v.supplier.select(k.alias("path"), (k % 40 + 0.5).alias("r0"), (k % 45 + 0.25).alias("c0"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    p = p.select("path", "i", F.floor(F.col("r0") + F.col("i") * 0.8).alias("row"), F.floor(F.col("c0") + F.col("i") * 0.6).alias("col"))
    return p.join(v.cells.select("row", "col", "dem"), ["row", "col"]).select("path", "i", F.round("dem", 6).alias("z"))


@query("""WITH RECURSIVE e AS (SELECT u, v FROM streets WHERE dir = 1 OR u % 3 = 0), n AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey * 37 % 500 AS DOUBLE) AS x, CAST(c_custkey * 91 % 333 AS DOUBLE) AS y FROM customer),
p AS (SELECT id AS pair_id, id AS origin, id + id % 40 - 20 AS destination FROM n), reach(s, id) AS (SELECT id, id FROM n UNION SELECT s, v FROM reach JOIN e ON e.u = reach.id),
near AS (SELECT p.pair_id, r.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p JOIN reach r ON r.s = p.origin AND r.id <> p.origin JOIN n a ON a.id = r.id JOIN n b ON b.id = p.destination),
best AS (SELECT pair_id, id, d2 FROM near QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY d2, id) = 1),
hit AS (SELECT p.pair_id FROM p JOIN reach r ON r.s = p.origin AND r.id = p.destination)
SELECT p.pair_id, CASE WHEN hit.pair_id IS NOT NULL THEN p.destination ELSE best.id END AS target, round(CASE WHEN hit.pair_id IS NOT NULL THEN 0.0 ELSE sqrt(best.d2) END, 6) AS distance, CASE WHEN hit.pair_id IS NOT NULL THEN false WHEN best.id IS NOT NULL THEN best.id <> p.destination END AS moved
FROM p LEFT JOIN hit ON hit.pair_id = p.pair_id LEFT JOIN best ON best.pair_id = p.pair_id""", "streets")
def reachable_targets(v: Views) -> DataFrame:
    """Trips on streets that are one-way in part: a target out of reach gives way to the nearest node within reach."""
    k = F.col("c_custkey").cast("long")
    nodes = v.customer.select(k.alias("node_id"), (k * 37 % 500).cast("double").alias("x"), (k * 91 % 333).cast("double").alias("y"))
    pairs = v.customer.select(k.alias("pair_id"), k.alias("origin"), (k + k % 40 - 20).alias("destination"))
    found = network.reachable_targets(v.streets.where("dir = 1 OR u % 3 = 0"), nodes, pairs)
    return found.withColumn("distance", F.round("distance", 6))
