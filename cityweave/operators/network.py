"""Street networks as edge tables: selection, costs, topology."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.numbering import numbered
from cityweave.session import checkpointed

#: Tags of ways for walking.
WALK = ["footway", "pedestrian", "path", "cycleway", "steps", "bridleway", "track"]


def drivable(edges: DataFrame, tag: str = "highway") -> DataFrame:
    return edges.where(~F.coalesce(F.col(tag).isin(WALK), F.lit(False)))


def walkable(edges: DataFrame, tag: str = "highway", least: int = 10) -> DataFrame:
    """Edges for walking; if fewer than `least` are left, all edges."""
    w = edges.where(F.col(tag).isin(WALK))
    enough = w.limit(least).agg((F.count("*") >= least).alias("_enough"))
    return edges.crossJoin(F.broadcast(enough)).where(~F.col("_enough") | F.coalesce(F.col(tag).isin(WALK), F.lit(False))).drop("_enough")


def collapse(edges: DataFrame, how: str, value: str, order: str | None = None) -> DataFrame:
    """One row for each (u, v) of parallel edges: 'min', 'max' or 'last' (by the order column, ties by the larger value)."""
    v = {"min": F.min(value), "max": F.max(value), "last": F.max_by(value, F.struct(order or value, value))}[how]
    return edges.groupBy("u", "v").agg(v.alias(value))


def best_edge(edges: DataFrame, weight: str, attribute: str) -> DataFrame:
    """The attribute of the lightest of parallel edges (ties: the smaller attribute)."""
    return edges.groupBy("u", "v").agg(F.min(F.struct(weight, attribute)).alias("x")).select("u", "v", F.col(f"x.{weight}").alias(weight), F.col(f"x.{attribute}").alias(attribute))


def attach_costs(edges: DataFrame, costs: DataFrame, value: str) -> DataFrame:
    """Edges with the least cost of their (u, v); without a cost they stay, with null."""
    return edges.join(collapse(costs, "min", value), ["u", "v"], "left")


def junctions(edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes with at least `least` distinct neighbours, in either direction."""
    both = edges.select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(edges.select("v", "u")).distinct()
    return both.groupBy("node_id").agg(F.count("*").alias("degree")).where(F.col("degree") >= least)


def has_reverse(edges: DataFrame) -> DataFrame:
    """Edges with a flag: an edge of the opposite direction exists."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct().withColumn("_back", F.lit(True))
    return edges.join(back, ["u", "v"], "left").withColumn("has_reverse", F.coalesce("_back", F.lit(False))).drop("_back")


def edge_ids(edges: DataFrame, base: Column, order: str) -> DataFrame:
    """edge_id: the base text, for repetitions with _0, _1 ... in order."""
    k = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return edges.withColumn("_base", base).withColumn("_k", k).withColumn("edge_id", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_k") - 2))).drop("_base", "_k")


def cumulative_length(segments: DataFrame, path: str, order: list[str], length: str) -> DataFrame:
    """along: length before each segment of its path, and total."""
    w = Window.partitionBy(path).orderBy(*order)
    return segments.withColumn("along", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)).withColumn("total", F.sum(length).over(Window.partitionBy(path)))


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns x scaled to norm_x in [0, 1] over the whole relation; a span of 1e-12 or less gives 0."""
    bounds = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"norm_{c}", F.when(span <= 1e-12, 0.0).otherwise(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), span)))
    return out.drop(*bounds.columns)


def successors(paths: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """from_path, to_path: paths (path_id, u, v) that begin where another ends.

    A U-turn goes only if there is another way on; forbidden pairs (from_path, to_path) go only if one way is left.
    """
    a = paths.select(F.col("path_id").alias("from_path"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    b = paths.select(F.col("path_id").alias("to_path"), F.col("u").alias("_v"), F.col("v").alias("_w"))
    j = a.join(b, "_v").withColumn("_uturn", F.col("_w") == F.col("_u"))
    w = Window.partitionBy("from_path")
    j = j.withColumn("_straight", F.sum((~F.col("_uturn")).cast("int")).over(w)).where(~F.col("_uturn") | (F.col("_straight") == 0)).select("from_path", "to_path")
    if forbidden is not None:
        ban = forbidden.select("from_path", "to_path").distinct().withColumn("_ban", F.lit(True))
        j = j.join(ban, ["from_path", "to_path"], "left").withColumn("_left", F.sum(F.when(F.col("_ban").isNull(), 1).otherwise(0)).over(w))
        j = j.where(F.col("_ban").isNull() | (F.col("_left") == 0)).select("from_path", "to_path")
    return j


def reverse_edge(edges: DataFrame, seq: int) -> DataFrame:
    """Edges with one of them turned round."""
    hit = F.col("seq") == seq
    return edges.withColumn("_u", F.when(hit, F.col("v")).otherwise(F.col("u"))).withColumn("v", F.when(hit, F.col("u")).otherwise(F.col("v"))).withColumn("u", F.col("_u")).drop("_u")


def route_edges(route: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """Per route (route_id, pos, node_id): its hops with the least weight of each, and whether all hops exist."""
    nxt = F.lead("node_id").over(Window.partitionBy("route_id").orderBy("pos"))
    hops = route.withColumn("v", nxt).where("v is not null").select("route_id", "pos", F.col("node_id").alias("u"), "v")
    found = hops.join(collapse(edges, "min", weight), ["u", "v"], "left")
    return found.groupBy("route_id").agg(F.sum(weight).alias("total"), F.count("*").alias("hops"), (F.count(weight) == F.count("*")).alias("complete"))


def _from_each_source(e: DataFrame, sources: DataFrame, small: int) -> DataFrame:
    """shortest_paths() over a small graph (u, v, _w), by one search for each source."""
    from cityweave.operators.routing import adjacency, broadcast_graph, dijkstra

    held = broadcast_graph(e, "_w", small)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = adjacency(held.value)
        for pdf in frames:
            for s in pdf["source"].tolist():
                cost = dijkstra(g, s)[0]
                yield pd.DataFrame({"source": s, "node_id": list(cost), "cost": list(cost.values())})

    distinct = sources.select(F.col("node_id").cast("long").alias("source")).distinct()
    return distinct.mapInPandas(each, "source long, node_id long, cost double")


#: Edges up to which a graph is sent whole to every task that looks for shortest paths (tens of megabytes).
SMALL_GRAPH = 200_000


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str, most_hops: int = 4, small: int = SMALL_GRAPH) -> DataFrame:
    """source, node_id, cost of all nodes reachable from each source; weights are not negative.

    A graph of at most `small` edges is broadcast, and tasks share the sources. Over a larger one a frontier moves: each round
    extends only the labels that improved in the last one, and the rounds end when none does, however many hops the network
    is deep. A round goes one edge far at first, later up to `most_hops` in one job.
    """
    e = checkpointed(collapse(edges.where(F.col(weight).isNotNull()), "min", weight).select("u", "v", F.col(weight).cast("double").alias("_w")))
    if e.limit(small + 1).count() <= small:
        return _from_each_source(e, sources, small)
    best = checkpointed(sources.select(F.col("node_id").alias("source"), "node_id", F.lit(0.0).alias("cost")).distinct())
    front, hops = best, 1
    while True:
        step, reached = front, None
        for _ in range(hops):
            step = step.join(e, step.node_id == e.u).select("source", F.col("v").alias("node_id"), (F.col("cost") + F.col("_w")).alias("cost")).groupBy("source", "node_id").agg(F.min("cost").alias("cost"))
            reached = step if reached is None else reached.union(step)
        old = best.withColumnRenamed("cost", "_old")
        front = reached.groupBy("source", "node_id").agg(F.min("cost").alias("cost")).join(old, ["source", "node_id"], "left").where(F.col("_old").isNull() | (F.col("cost") < F.col("_old") - 1e-9)).drop("_old")
        front = checkpointed(front)
        if front.isEmpty():
            return best
        best = checkpointed(best.union(front).groupBy("source", "node_id").agg(F.min("cost").alias("cost")))
        hops = min(2 * hops, most_hops)


def reachable_targets(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """pair_id, target, distance, moved of (pair_id, origin, destination): the destination, or where the origin does not reach it
    the nearest node (node_id, x, y) that it does reach, itself aside (of equally near ones the smallest id).

    Pairs with an end that is no node, or whose origin reaches nothing, have a null target. Each origin is searched once."""
    at = nodes.select("node_id", "x", "y")
    ends = pairs.join(at.select(F.col("node_id").alias("origin")), "origin", "left_semi").join(at.select(F.col("node_id").alias("destination"), F.col("x").alias("_x"), F.col("y").alias("_y")), "destination")
    e = edges.select("u", "v", F.lit(1.0).alias("_hop"))
    reach = checkpointed(shortest_paths(e, ends.select(F.col("origin").alias("node_id")).distinct(), "_hop", small=small).select(F.col("source").alias("origin"), "node_id"))
    direct = ends.join(reach.select("origin", F.col("node_id").alias("destination")), ["origin", "destination"], "left_semi")
    lost = ends.join(direct.select("pair_id"), "pair_id", "left_anti")
    far = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    near = lost.join(reach.where("origin <> node_id"), "origin").join(at, "node_id").groupBy("pair_id").agg(F.min(F.struct(far.alias("d2"), "node_id")).alias("n"))
    found = direct.select("pair_id", F.col("destination").alias("target"), F.lit(0.0).alias("distance")).unionByName(near.select("pair_id", F.col("n.node_id").alias("target"), F.sqrt("n.d2").alias("distance")))
    out = pairs.select("pair_id", "destination").join(found, "pair_id", "left")
    return out.select("pair_id", "target", "distance", (F.col("target") != F.col("destination")).alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """node_id, component: the smallest node id that each node reaches, directions aside. Labels only fall, so rounds end."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "node_id")
    while True:
        near = both.join(label, both.v == label.node_id).groupBy(F.col("u").alias("node_id")).agg(F.min("c").alias("m"))
        hop = label.join(near, "node_id").select("node_id", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        jump = label.select(F.col("node_id").alias("c"), F.col("c").alias("cc"))
        new = checkpointed(hop.join(jump, "c", "left").select("node_id", F.least("c", F.coalesce("cc", "c")).alias("c"), "was"))
        if new.where("c <> was").isEmpty():
            return new.select("node_id", F.col("c").alias("component"))
        label = new.select("node_id", "c")


def axis_groups(approaches: DataFrame, node: str, bearing: str, phases: int = 2) -> DataFrame:
    """phase of each approach: bearings mod 180 in circular order, cut at the phases - 1 largest gaps (ties: the first)."""
    a = approaches.withColumn("axis", F.pmod(F.col(bearing), F.lit(180.0)))
    w = Window.partitionBy(node).orderBy("axis", "edge")
    gap = F.round(F.lead("axis").over(w) - F.col("axis"), 5)  # equal gaps stay equal whatever the last digits say
    a = a.withColumn("_gap", gap)
    cut = F.row_number().over(Window.partitionBy(node).orderBy(F.desc_nulls_last("_gap"), "axis", "edge")) <= phases - 1
    a = a.withColumn("_cut", (cut & F.col("_gap").isNotNull() & (F.col("_gap") > 0)).cast("int"))
    return a.withColumn("phase", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_gap", "_cut")


def axis_mean(bearing: Column) -> Column:
    """Mean of undirected bearings, by doubled angles, in [0, 180)."""
    a = F.radians(2 * bearing)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))) / 2 + 180.0, F.lit(180.0))


def forbidden_turns(pairs: DataFrame, paths: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """from_path, to_path: segment pairs met through paths' segment ids, and paths whose tag names the turn's direction."""
    a, b = paths.select(F.col("segment_id").alias("from_segment_id"), F.col("path_id").alias("from_path"), F.col("v").alias("_n")), paths.select(F.col("segment_id").alias("to_segment_id"), F.col("path_id").alias("to_path"), F.col("u").alias("_n"))
    out = pairs.join(a, "from_segment_id").join(b, ["to_segment_id", "_n"]).select("from_path", "to_path")
    if tags is not None:
        from cityweave.functions.motion import turn

        i = paths.select(F.col("path_id").alias("from_path"), F.col("v").alias("_n"), F.col("bearing").alias("_in"))
        o = paths.select(F.col("path_id").alias("to_path"), F.col("u").alias("_n"), F.col("bearing").alias("_out"))
        t = tags.join(i, "from_path").join(o, "_n").withColumn("_d", turn(F.col("_in"), F.col("_out")))
        name = F.regexp_replace("_d", "straight", "straight_on")
        hit = (F.col("restriction") == F.concat(F.lit("no_"), F.when(F.col("_d").isin("left", "right"), F.concat("_d", F.lit("_turn"))).otherwise(name)))
        only = F.regexp_extract("restriction", "^only_(left|right|straight|u)", 1)
        miss = (only != "") & ~F.col("_d").startswith(only)
        out = out.union(t.where(hit | miss).select("from_path", "to_path"))
    return out.distinct()


def fallback_selection(edges: DataFrame, first: Column, second: Column, least: int = 5) -> DataFrame:
    """Edges of the first predicate; with fewer than `least`, those of either; with fewer again, all."""
    n = edges.agg(F.count_if(first).alias("_n1"), F.count_if(first | second).alias("_n2"))
    pass_ = F.when(F.col("_n1") >= least, first).when(F.col("_n2") >= least, first | second).otherwise(F.lit(True))
    return edges.crossJoin(F.broadcast(n)).where(pass_).drop("_n1", "_n2")


def systematic_sample(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row in order: at most `most` of them."""
    n = rows.count()
    each = max(1, -(-n // most))
    return numbered(rows, order, name="_k").where(F.pmod("_k", F.lit(each)) == 0).drop("_k")


def lane_links(lanes: DataFrame) -> DataFrame:
    """left_id and right_id of the neighbour lanes of the same (u, v, key), -1 if none."""
    w = Window.partitionBy("u", "v", "key").orderBy("lane_index")
    return lanes.withColumn("left_id", F.coalesce(F.lag("path_id").over(w), F.lit(-1))).withColumn("right_id", F.coalesce(F.lead("path_id").over(w), F.lit(-1)))


def roundabout(nodes: DataFrame, edges: DataFrame, node: int, radius: float, first_id: int, arms: int = 8) -> tuple[DataFrame, DataFrame]:
    """A node replaced by a one-way ring of `arms` nodes; its edges go to the nearest of them (ties: the smallest id)."""
    import math

    c = nodes.where(F.col("node_id") == node).first()
    spark = nodes.sparkSession
    ring = [(first_id + k, c.x + radius * math.cos(2 * math.pi * k / arms), c.y + radius * math.sin(2 * math.pi * k / arms)) for k in range(arms)]
    pick = lambda x, y: F.array_min(F.array(*(F.struct(((x - a) * (x - a) + (y - b) * (y - b)).alias("d"), F.lit(i).cast("long").alias("i")) for i, a, b in ring)))["i"]
    at = nodes.select(F.col("node_id").alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = edges.withColumn("_o", F.when(F.col("u") == node, F.col("v")).when(F.col("v") == node, F.col("u"))).join(at, "_o", "left").withColumn("_r", pick(F.col("_x"), F.col("_y")))
    moved = j.withColumn("u", F.when(F.col("u") == node, F.col("_r")).otherwise(F.col("u"))).withColumn("v", F.when(F.col("v") == node, F.col("_r")).otherwise(F.col("v"))).select("u", "v", "length")
    step = 2 * radius * math.sin(math.pi / arms)
    circle = spark.createDataFrame([(first_id + k, first_id + (k + 1) % arms, step) for k in range(arms)], "u long, v long, length double")
    return nodes.where(F.col("node_id") != node).select("node_id", "x", "y").union(spark.createDataFrame(ring, "node_id long, x double, y double")), moved.union(circle)


def downstream(start: DataFrame, succ: DataFrame, hops: int = 3) -> DataFrame:
    """path_id, origin, hop: paths that follow within `hops` successor steps, each by its fewest."""
    front = start.select(F.col("path_id").alias("origin"), "path_id", F.lit(0).alias("hop"))
    out = front
    for k in range(1, hops + 1):
        front = front.join(succ, F.col("path_id") == F.col("from_path")).select("origin", F.col("to_path").alias("path_id"), F.lit(k).alias("hop")).distinct()
        out = out.union(front)
    return out.groupBy("origin", "path_id").agg(F.min("hop").alias("hop"))


def bridge(edges: DataFrame, u: int, v: int, length: float, speed_ms: float = 22.2) -> DataFrame:
    """Edges with a new one in both directions; seq goes on from the largest."""
    top = edges.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    new = edges.sparkSession.createDataFrame([(1, u, v), (2, v, u)], "k long, u long, v long").crossJoin(top)
    return edges.select("seq", "u", "v", "length", "speed_ms").unionByName(new.select((F.col("_top") + F.col("k")).alias("seq"), "u", "v", F.lit(length).alias("length"), F.lit(speed_ms).alias("speed_ms")))


def resolve_direction(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """one_way and forward of node pairs (query_id, a, b): an edge one way only, or both ways; null without an edge."""
    e = edges.select("u", "v").distinct()
    f = e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("_f"))
    r = e.select(F.col("v").alias("a"), F.col("u").alias("b"), F.lit(True).alias("_r"))
    j = queries.join(f, ["a", "b"], "left").join(r, ["a", "b"], "left")
    some = F.col("_f").isNotNull() | F.col("_r").isNotNull()
    return j.select("query_id", F.when(some, F.col("_f").isNull() | F.col("_r").isNull()).alias("one_way"), F.when(some, F.col("_f").isNotNull()).alias("forward"))


def drivable_lanes(edges: DataFrame, spacing: float = 3.2, least_length: float = 0.5) -> DataFrame:
    """One row for each lane of drivable edges: lane_index, lanes, and the offset from the middle of the way."""
    e = drivable(edges).where((F.col("length") >= least_length) & (F.col("u") != F.col("v")))
    n = F.greatest(F.lit(1), F.coalesce("lanes", F.lit(1)))
    return e.withColumn("lanes", n).withColumn("lane_index", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).withColumn("offset_m", (F.col("lane_index") - (F.col("lanes") - 1) / 2.0) * spacing)


def scenario_document(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row with the graph as a JSON document. Meant for scenarios that one row can hold."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("node_id", "x", "y"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("seq", "u", "v", "length", F.coalesce("speed_ms", F.lit(13.89)).alias("speed_ms")))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(name).alias("name"), "nodes", "edges")).alias("document"))
