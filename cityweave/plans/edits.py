"""Queries on edited street graphs: the customers' streets with edges turned, crossings made roundabouts, bridges, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators import edits
from cityweave.plans.registry import Views, query

_N = "n AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 97 * 10.5 + 100 AS DOUBLE) AS x, CAST(c_custkey // 97 * 11.25 + c_custkey * 3 % 9 + 100 AS DOUBLE) AS y FROM customer)"
# an edge's line has a bend; a quarter of them has none
_E = f"""{_N}, e AS (SELECT s.u, s.v, s.dir, CAST(s.length AS DOUBLE) AS length, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, (a.x + b.x) / 2 + 1 AS mx, (a.y + b.y) / 2 AS m_y, s.u % 4 <> 0 AS line, CASE s.u % 3 WHEN 1 THEN true WHEN 2 THEN false END AS oneway, CASE WHEN s.v % 5 <> 0 THEN s.v % 2 = 0 END AS legal FROM streets s JOIN n a ON a.id = s.u JOIN n b ON b.id = s.v)"""


def _nodes(v: Views) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return v.customer.select(k.cast("string").alias("node_id"), (k % 97 * 10.5 + 100).cast("double").alias("x"), (F.floor(k / 97) * 11.25 + k * 3 % 9 + 100).cast("double").alias("y"))


def _edges(v: Views) -> DataFrame:
    at = lambda n: _nodes(v).select(F.col("node_id").alias(n), F.struct("x", "y").alias(f"_{n}"))
    k, m, a, b = F.col("_k"), F.col("_m"), F.col("_u"), F.col("_v")
    s = v.streets.select(F.col("u").alias("_k"), F.col("v").alias("_m"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "length").join(at("u"), "u").join(at("v"), "v")
    bend = F.struct(((a["x"] + b["x"]) / 2 + 1).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return s.select(
        "u", "v", F.lit(0).alias("key"), "length", F.when(k % 4 != 0, F.array(a, bend, b)).alias("points"), F.when(k % 3 == 1, True).when(k % 3 == 2, False).alias("oneway"),
        F.when(m % 5 != 0, m % 2 == 0).alias("legal_forward"),
    )


def _shown(edges: DataFrame, *more: str | Column) -> DataFrame:
    at = lambda i, c: F.round(F.try_element_at("points", F.lit(i))[c], 6)
    return edges.select("u", "v", "key", F.round("length", 6).alias("length"), at(1, "x").alias("x0"), at(1, "y").alias("y0"), at(-1, "x").alias("x1"), at(-1, "y").alias("y1"), *more)


_ENDS = "CASE WHEN line THEN round({}, 6) END AS x0, CASE WHEN line THEN round({}, 6) END AS y0, CASE WHEN line THEN round({}, 6) END AS x1, CASE WHEN line THEN round({}, 6) END AS y1"


@query(f"""WITH {_E}, hit AS (SELECT * FROM e WHERE u % 6 = 1 AND v = u + 1), stay AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.u = e.u AND hit.v = e.v) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.u = e.v AND hit.v = e.u))
SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, 0 AS key, length, {_ENDS.format('ax', 'ay', 'bx', 'b_y')}, oneway, legal AS legal_forward FROM stay UNION ALL SELECT CAST(v AS VARCHAR), CAST(u AS VARCHAR), 0, length, {_ENDS.format('bx', 'b_y', 'ax', 'ay')}, CASE WHEN oneway IS NOT NULL THEN true END, NOT coalesce(legal, true) FROM hit""", "streets")
def turned_edges(v: Views) -> DataFrame:
    """Some edges turned round; each takes the place of the one that went the other way."""
    e = _edges(v)
    picks = v.streets.where("u % 6 = 1 AND v = u + 1").select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), F.lit(0).alias("key"))
    return _shown(edits.turned(e, picks), "oneway", "legal_forward")


_RING = """ring AS (SELECT id, k, 'ra_' || id || '_' || k AS name, x + 3 * cos(k * pi() / 4) AS x, y + 3 * sin(k * pi() / 4) AS y FROM n, (SELECT unnest(range(8)) AS k) WHERE id % 5 = 0)"""


@query(f"""WITH {_E}, {_RING}, ends AS (SELECT e.*, r.name, r.x AS rx, r.y AS ry, r.id = u AS at_u, row_number() OVER (PARTITION BY u, v ORDER BY round(power(r.x - CASE WHEN r.id = u THEN bx ELSE ax END, 2) + power(r.y - CASE WHEN r.id = u THEN b_y ELSE ay END, 2), 6), r.name) AS rn FROM e JOIN ring r ON r.id = e.u OR r.id = e.v),
moved AS (SELECT CASE WHEN at_u THEN name ELSE CAST(u AS VARCHAR) END AS u, CASE WHEN at_u THEN CAST(v AS VARCHAR) ELSE name END AS v, line, CASE WHEN at_u THEN rx ELSE ax END AS ax, CASE WHEN at_u THEN ry ELSE ay END AS ay, CASE WHEN at_u THEN bx ELSE rx END AS bx, CASE WHEN at_u THEN b_y ELSE ry END AS b_y, mx, m_y, length FROM ends WHERE rn = 1)
SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, 0 AS key, round(length, 6) AS length, {_ENDS.format('ax', 'ay', 'bx', 'b_y')} FROM e WHERE u % 5 <> 0 AND v % 5 <> 0
UNION ALL SELECT u, v, 0, round(CASE WHEN line THEN sqrt((mx - ax) * (mx - ax) + (m_y - ay) * (m_y - ay)) + sqrt((mx - bx) * (mx - bx) + (m_y - b_y) * (m_y - b_y)) ELSE length END, 6), {_ENDS.format('ax', 'ay', 'bx', 'b_y')} FROM moved
UNION ALL SELECT a.name, b.name, 0, round(6 * sin(pi() / 8), 6), round(a.x, 6), round(a.y, 6), round(b.x, 6), round(b.y, 6) FROM ring a JOIN ring b ON b.id = a.id AND b.k = (a.k + 1) % 8""", "streets")
def roundabout_edges(v: Views) -> DataFrame:
    """Every fifth node a roundabout: its edges end at the ring."""
    nodes = _nodes(v)
    return _shown(edits.roundabouts(nodes, _edges(v), nodes.where(F.col("node_id").cast("long") % 5 == 0), 3.0)[1])


@query(f"""WITH {_N}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS u, CAST(s_suppkey + 1 AS BIGINT) AS v, s_suppkey % 4 - 1 AS layer FROM supplier), b AS (SELECT * FROM p UNION ALL SELECT v, u, layer FROM p)
SELECT CAST(b.u AS VARCHAR) AS u, CAST(b.v AS VARCHAR) AS v, CAST(CASE WHEN s.u IS NULL THEN 0 ELSE 1 END AS INT) AS key, round(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)), 6) AS length, round(a.x, 6) AS x0, round(a.y, 6) AS y0, round(c.x, 6) AS x1, round(c.y, 6) AS y1, CAST(greatest(layer, 1) AS INT) AS layer, 'motorway' AS highway, false AS oneway, 100 AS maxspeed_kmh, 2 AS lanes
FROM b JOIN n a ON a.id = b.u JOIN n c ON c.id = b.v LEFT JOIN streets s ON s.u = b.u AND s.v = b.v""", "streets")
def new_bridges(v: Views) -> DataFrame:
    """Bridges between neighbours, there and back, beside the edges that are there."""
    k = F.col("s_suppkey").cast("long")
    pairs = v.supplier.select(k.cast("string").alias("u"), (k + 1).cast("string").alias("v"), (k % 4 - 1).cast("int").alias("layer"))
    return _shown(edits.bridges(_nodes(v), _edges(v), pairs), "layer", "highway", "oneway", "maxspeed_kmh", "lanes")


@query("""WITH r AS (SELECT o_orderkey AS route_id, pos, CAST(o_custkey + pos AS BIGINT) AS node FROM (SELECT o_orderkey, o_custkey, unnest(range(o_orderkey % 5 + 1)) AS pos FROM orders)),
h AS (SELECT a.route_id, a.pos, s.u * 2 + 1 AS id FROM r a JOIN r b ON b.route_id = a.route_id AND b.pos = a.pos + 1 LEFT JOIN streets s ON s.u = a.node AND s.v = b.node),
g AS (SELECT route_id, count(*) = count(id) AS whole, string_agg(id, ',' ORDER BY pos) AS edges FROM h GROUP BY 1)
SELECT CAST(o_orderkey AS BIGINT) AS route_id, CASE WHEN whole THEN edges ELSE '' END AS edges FROM orders LEFT JOIN g ON g.route_id = o_orderkey""", "streets")
def route_edge_lists(v: Views) -> DataFrame:
    """Edges along each order's route; a route with a gap has none."""
    k = F.col("o_orderkey")
    routes = v.orders.select(k.cast("long").alias("route_id"), "o_custkey", F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("pos")).select("route_id", "pos", (F.col("o_custkey") + F.col("pos")).cast("long").alias("node_id"))
    ids = v.streets.select("u", "v", (F.col("u") * 2 + (F.col("dir") == 1).cast("int")).alias("edge_id"))
    return edits.edges_of_routes(routes, ids).select("route_id", F.array_join("edges", ",").alias("edges"))
