"""Edits of a street graph, any number of them in one go: edges turned round, crossings made roundabouts, bridges, routes as edges.

Nodes are (node_id, x, y); edges are (u, v, key, length, points, oneway, legal_forward), told apart by (u, v, key). points, an
array of struct(x, y) from u to v, may be null. Node ids are texts, as the nodes of rings get names of their own.
Everything is joins on the nodes that change; no graph passes through the driver. Edits that name nothing in the graph change
nothing (unknown() lists them); a repeated edit counts once. Nulls in an edit's keys fit nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["u", "v", "key", "length", "points", "oneway", "legal_forward"]
#: Fixed values of a bridge's ways.
BRIDGE_KMH, BRIDGE_LANES = 100, 2


def unknown(edges: DataFrame, picks: DataFrame) -> DataFrame:
    """The picks (u, v, key) without an edge."""
    return picks.select("u", "v", "key").distinct().join(edges, ["u", "v", "key"], "left_anti")


def turned(edges: DataFrame, picks: DataFrame) -> DataFrame:
    """Edges with the picked ones (u, v, key) going from v to u.

    Their points run backwards, a one-way mark becomes true, and what was the legal direction no longer is. A turned edge takes
    the place of one that has its new ends and key and isn't turned itself."""
    hit = picks.select("u", "v", "key").distinct().withColumn("_hit", F.lit(True))
    x = edges.select(*EDGE).join(hit, ["u", "v", "key"], "left")
    back = x.where("_hit").select(F.col("v").alias("u"), F.col("u").alias("v"), "key", "length", F.reverse("points").alias("points"), F.when(F.col("oneway").isNotNull(), True).alias("oneway"), (~F.coalesce("legal_forward", F.lit(True))).alias("legal_forward"))
    stay = x.where("_hit IS NULL").join(back, ["u", "v", "key"], "left_anti")
    return stay.select(*EDGE).unionByName(back)


def line_length(points: Column) -> Column:
    step = lambda i: F.hypot(F.get(points, i)["x"] - F.get(points, i - 1)["x"], F.get(points, i)["y"] - F.get(points, i - 1)["y"])
    return F.when(F.size(points) > 1, F.aggregate(F.sequence(F.lit(1), F.size(points) - 1), F.lit(0.0), lambda a, i: a + step(i))).otherwise(0.0)


def _ring_node(node: Column, x: Column, y: Column, radius: float, arms: int, k: Column) -> Column:
    turn = k * (2 * math.pi / arms)
    return F.struct(F.concat(F.lit("ra_"), node, F.lit("_"), k.cast("string")).alias("node_id"), (x + radius * F.cos(turn)).alias("x"), (y + radius * F.sin(turn)).alias("y"))


def _nearest_of_ring(node: Column, x: Column, y: Column, to_x: Column, to_y: Column, radius: float, arms: int) -> Column:
    """The ring's node nearest to a point, of equally near ones (to six places) the first by name."""

    def one(k: Column) -> Column:
        n = _ring_node(node, x, y, radius, arms, k)
        return F.struct(F.round((n["x"] - to_x) * (n["x"] - to_x) + (n["y"] - to_y) * (n["y"] - to_y), 6).alias("d2"), n.alias("n"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(arms - 1)), one))["n"]


def roundabouts(nodes: DataFrame, edges: DataFrame, centres: DataFrame, radius: float = 14.0, arms: int = 8) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with each centre (node_id) replaced by a one-way ring of nodes ra_<centre>_0, _1 ...

    An edge of a centre goes to the ring's node nearest to its other end; its line and length follow. Where both ends are centres,
    the lesser id's end moves first. Loops at a centre go. A centre's node must be in nodes, once."""
    c = nodes.select("node_id", "x", "y").join(centres.select("node_id").distinct(), "node_id", "left_semi")
    end = lambda n, of: of.select(F.col("node_id").alias(n), F.struct("x", "y").alias(f"_{n}"))
    mark = lambda n: c.select(F.col("node_id").alias(n), F.lit(True).alias(f"_c{n}"))
    x = edges.select(*EDGE).join(mark("u"), "u", "left").join(mark("v"), "v", "left").where("NOT (u = v AND _cu IS NOT NULL)")
    same = x.where("_cu IS NULL AND _cv IS NULL").select(*EDGE)
    near = x.where("_cu OR _cv").join(end("u", nodes), "u", "left").join(end("v", nodes), "v", "left")
    u, v, cu, cv = F.col("_u"), F.col("_v"), F.coalesce("_cu", F.lit(False)), F.coalesce("_cv", F.lit(False))
    pick = lambda n, to: _nearest_of_ring(F.col(n), F.col(f"_{n}")["x"], F.col(f"_{n}")["y"], to["x"], to["y"], radius, arms)
    u_first = cu & (~cv | (F.col("u") < F.col("v")))
    first = near.withColumn("_first", F.when(u_first, pick("u", v)).otherwise(pick("v", u))).withColumn("_uf", u_first)
    f, uf = F.col("_first"), F.col("_uf")
    second = first.withColumn("_second", F.when(cu & cv, F.when(uf, pick("v", f)).otherwise(pick("u", f))))
    moved = second.withColumn("_nu", F.when(uf, f).when(cu, F.col("_second"))).withColumn("_nv", F.when(uf, F.col("_second")).otherwise(f))
    xy = lambda n: F.array(F.struct(F.col(n)["x"].alias("x"), F.col(n)["y"].alias("y")))
    p = F.col("points")
    begun = F.when(F.col("_nu").isNotNull(), F.concat(xy("_nu"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))).otherwise(p)
    moved = moved.withColumn("points", F.when(F.size(p) > 0, begun).otherwise(p))
    ended = F.when(F.col("_nv").isNotNull(), F.concat(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), xy("_nv"))).otherwise(p)
    moved = moved.withColumn("points", F.when(F.size(p) > 0, ended).otherwise(p)).withColumn("length", F.when(F.size(p) > 0, line_length(p)).otherwise(F.col("length")))
    moved = moved.withColumn("u", F.coalesce("_nu.node_id", "u")).withColumn("v", F.coalesce("_nv.node_id", "v")).select(*EDGE)
    k = F.col("_k")
    ring = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(arms - 1))).alias("_k"))
    here, following = (_ring_node(F.col("node_id"), F.col("x"), F.col("y"), radius, arms, at) for at in (k, (k + 1) % arms))
    sides = ring.select(here.alias("a"), following.alias("b"))
    line = F.array(F.struct("a.x", "a.y"), F.struct("b.x", "b.y"))
    kinds = {f.name: f.dataType for f in edges.schema}
    circle = sides.select(F.col("a.node_id").alias("u"), F.col("b.node_id").alias("v"), F.lit(0).cast(kinds["key"]).alias("key"), line_length(line).alias("length"), line.cast(kinds["points"]).alias("points"), F.lit(True).alias("oneway"), F.lit(None).cast("boolean").alias("legal_forward"))
    left = nodes.select("node_id", "x", "y").join(c, "node_id", "left_anti").unionByName(sides.select("a.*"))
    return left, same.unionByName(moved).unionByName(circle)


def bridges(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The new edges of bridges (u, v, layer), there and back: straight, with a motorway's values and layers from 1.

    Their keys go on from the largest of the edges that have their ends."""
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.struct("x", "y").alias(f"_{n}"))
    both = pairs.select("u", "v", "layer").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "layer")).join(at("u"), "u").join(at("v"), "v")
    top = edges.groupBy("u", "v").agg(F.max("key").alias("_top"))
    again = F.row_number().over(Window.partitionBy("u", "v").orderBy("layer"))
    line = F.array("_u", "_v")
    return both.join(top, ["u", "v"], "left").select(
        "u", "v", (F.coalesce("_top", F.lit(-1)) + again).cast("int").alias("key"), line_length(line).alias("length"), line.alias("points"), F.lit(False).alias("oneway"), F.lit("motorway").alias("highway"),
        F.lit(True).alias("bridge"), F.greatest(F.coalesce("layer", F.lit(1)), F.lit(1)).cast("int").alias("layer"), F.lit(BRIDGE_KMH).alias("maxspeed_kmh"), F.lit(BRIDGE_LANES).alias("lanes"),
    )


def edges_of_routes(routes: DataFrame, edges: DataFrame, edge_id: str = "edge_id") -> DataFrame:
    """route_id, edges: the edges between a route's nodes (route_id, pos, node_id) in order, of parallel ones that of the largest
    id; none at all where a hop has no edge, or where the route has fewer than two nodes."""
    ahead = F.lead("node_id").over(Window.partitionBy("route_id").orderBy("pos"))
    last = F.row_number().over(Window.partitionBy("route_id").orderBy(F.desc("pos"))) == 1
    hops = routes.select("route_id", "pos", F.col("node_id").alias("u"), ahead.alias("v"), last.alias("_last")).where("NOT _last")
    found = hops.join(edges.groupBy("u", "v").agg(F.max(edge_id).alias("_id")), ["u", "v"], "left")
    held = found.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_id"))).alias("_h"), (F.count("_id") == F.count("*")).alias("_whole"))
    ids = F.transform("_h", lambda h: h["_id"])
    none = F.array().cast(f"array<{edges.schema[edge_id].dataType.simpleString()}>")
    return routes.select("route_id").distinct().join(held, "route_id", "left").select("route_id", F.when(F.col("_whole"), ids).otherwise(none).alias("edges"))
