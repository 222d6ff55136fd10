"""Street graphs from lines, sampled trips, routed stops, slots, and points against spans, boxes and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.numbering import numbered


def pieces(points: DataFrame, line: str, order: str = "pos") -> DataFrame:
    """Lines of points (line, order, x, y) as straight pieces: line, order, x1, y1, x2, y2, length."""
    w = Window.partitionBy(line).orderBy(order)
    p = points.select(line, order, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    return p.withColumn("length", F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))))


def clip_to_disc(straight: DataFrame, line: str, radius: float, order: str = "pos") -> DataFrame:
    """The longest connected part (of equals the first) of each line within the disc round the origin, as pieces; lines outside go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    a, b, c = dx * dx + dy * dy, F.col("x1") * dx + F.col("y1") * dy, F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1") - radius * radius
    root = F.sqrt(b * b - a * c)
    t = straight.where((a > 0) & (b * b - a * c > 0)).withColumn("_t0", F.greatest(F.lit(0.0), (-b - root) / a)).withColumn("_t1", F.least(F.lit(1.0), (-b + root) / a)).where("_t1 > _t0")
    w = Window.partitionBy(line).orderBy(order)
    joined = (F.lag(order).over(w) == F.col(order) - 1) & (F.lag("_t1").over(w) == 1) & (F.col("_t0") == 0)
    t = t.withColumn("_run", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    at = lambda p, q, k: F.col(p) + F.col(k) * (F.col(q) - F.col(p))
    cut = t.select(line, order, "_run", at("x1", "x2", "_t0").alias("x1"), at("y1", "y2", "_t0").alias("y1"), at("x1", "x2", "_t1").alias("x2"), at("y1", "y2", "_t1").alias("y2"), (F.col("length") * (F.col("_t1") - F.col("_t0"))).alias("length"))
    runs = cut.groupBy(line, "_run").agg(F.sum("length").alias("_sum"))
    best = runs.groupBy(line).agg(F.max_by("_run", F.struct(F.col("_sum"), -F.col("_run"))).alias("_run"))
    return cut.join(best, [line, "_run"], "left_semi").drop("_run")


def street_graph(straight: DataFrame, lines: DataFrame, line: str, order: str = "pos", digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, x, y; edges: u, v, line, length, reversed) of lines (line, oneway, legal_forward) given as pieces.

    Ends that agree to `digits` decimals are one node, numbered in the order of x, y. Two-way lines give an edge each way; a
    one-way line whose legal direction is backward gives the reversed edge alone."""
    ends = straight.groupBy(line).agg(
        F.min_by(F.struct(F.round("x1", digits).alias("x"), F.round("y1", digits).alias("y")), order).alias("a"), F.max_by(F.struct(F.round("x2", digits).alias("x"), F.round("y2", digits).alias("y")), order).alias("b"), F.sum("length").alias("length")
    )
    places = ends.select("a.x", "a.y").union(ends.select("b.x", "b.y")).distinct()
    nodes = numbered(places, "x", "y", name="node_id")
    named = lambda end, name: nodes.select(F.struct("x", "y").alias(end), F.col("node_id").alias(name))
    e = ends.join(named("a", "u"), "a").join(named("b", "v"), "b").join(lines.select(line, "oneway", "legal_forward"), line)
    forth = e.where("NOT oneway OR legal_forward").select("u", "v", line, "length", F.lit(False).alias("reversed"))
    back = e.where("NOT oneway OR NOT legal_forward").select(F.col("v").alias("u"), F.col("u").alias("v"), line, "length", F.lit(True).alias("reversed"))
    return nodes, forth.union(back)


def dashes(lines: DataFrame, key: str, length: str, dash: float = 1.0, gap: float = 1.0) -> DataFrame:
    """key, number, start, end (along the line) of the dashes of each line; the last one may be shorter."""
    n = F.ceil(F.col(length) / (dash + gap))
    k = lines.where(F.col(length) > 0).select(key, F.col(length).alias("_l"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("number"))
    start = F.col("number") * (dash + gap)
    return k.select(key, "number", start.alias("start"), F.least(start + dash, F.col("_l")).alias("end"))


def lot_slots(points: DataFrame, lot: str, dx: float = 2.35, dy: float = 5.5, least: float = 6.0) -> DataFrame:
    """lot, x, y: middles of the slots over the box of each lot (corners lot, x, y); lots under `least` metres have none."""
    b = points.groupBy(lot).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    count = lambda lo, hi, step: F.ceil((F.col(hi) - F.col(lo) - step / 2) / step)
    s = b.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), count("y0", "y1", dy) - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count("x0", "x1", dx) - 1)))
    return s.select(lot, (F.col("x0") + dx / 2 + dx * F.col("i")).alias("x"), (F.col("y0") + dy / 2 + dy * F.col("j")).alias("y"))


def sample_pairs(nodes: DataFrame, tries: int, origin: Column, destination: Column, least: float = 200.0, most: float = 2500.0) -> DataFrame:
    """k, u, v, beeline of the tries whose straight distance lies between least and most.

    nodes (node_id, x, y) are numbered from 0; origin and destination are columns of the try k (and n, the number of nodes)."""
    at = numbered(nodes, "node_id", name="place")
    n = at.count()
    if not n:
        return nodes.sparkSession.createDataFrame([], "k long, u long, v long, beeline double")
    t = nodes.sparkSession.range(tries).withColumnRenamed("id", "k").withColumn("n", F.lit(n)).select("k", origin.alias("_o"), destination.alias("_d")).where("_o <> _d")
    end = lambda p, node: at.select(F.col("place").alias(p), F.col("node_id").alias(node), F.col("x").alias(f"{node}x"), F.col("y").alias(f"{node}y"))
    j = t.join(end("_o", "u"), "_o").join(end("_d", "v"), "_d")
    d = F.sqrt((F.col("ux") - F.col("vx")) * (F.col("ux") - F.col("vx")) + (F.col("uy") - F.col("vy")) * (F.col("uy") - F.col("vy")))
    return j.select("k", "u", "v", d.alias("beeline")).where(F.col("beeline").between(least, most))


def first_matched(pairs: DataFrame, times: DataFrame, n: int, column: str) -> DataFrame:
    """The first n pairs (by k) that have a time in times (source, node_id, cost)."""
    t = times.select(F.col("source").alias("u"), F.col("node_id").alias("v"), F.col("cost").alias(column))
    return pairs.join(t, ["u", "v"]).orderBy("k").limit(n)


def routed_trips(stops: DataFrame, times: DataFrame, trip: str, order: str) -> DataFrame:
    """trip, legs, cost of the trips (trip, order, node_id) of which every leg between stops has a way."""
    w = Window.partitionBy(trip).orderBy(order)
    legs = stops.select(trip, F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("node_id")).where("node_id IS NOT NULL")
    found = legs.join(times, ["source", "node_id"], "left")
    return found.groupBy(trip).agg(F.count("*").alias("legs"), F.sum("cost").alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("_all")).where("_all").drop("_all")


def budgeted(finished: DataFrame, by: list[str], order: str, cursor: Column, budget: int) -> DataFrame:
    """The `budget` rows of each group that come next after the cursor, round robin over the order."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy((F.col(order) <= cursor).cast("int"), order))
    return finished.withColumn("turn", turn).where(F.col("turn") <= budget)


def long_enough(tries: DataFrame, by: str, length: str, least: float = 200.0, most_tries: int = 20) -> DataFrame:
    """Per group its first try (column k, from 0) of at least `least` among `most_tries`; the first try of all where none is."""
    ok = (F.col("k") < most_tries) & (F.col(length) >= least)
    best = F.min(F.struct((~ok).alias("_short"), F.col("k"), F.col(length))).alias("m")
    return tries.groupBy(by).agg(best).select(by, "m.k", f"m.{length}", F.col("m._short").alias("fallback"))


def advance(vehicles: DataFrame, key: str, seconds: int, dt: float = 1.0, rate: float = 3.0) -> DataFrame:
    """key, t, speed, along, lap of vehicles (key, speed, target, route_m) that gain `rate` up to their target, step by step."""
    s = vehicles.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(seconds / dt)))))
    v = s.withColumn("v", F.least(F.col("target"), F.col("speed") + rate * dt * F.col("step")))
    run = F.sum(F.col("v") * dt).over(Window.partitionBy(key).orderBy("step"))
    return v.withColumn("run", run).select(key, (F.col("step") * dt).alias("t"), F.col("v").alias("speed"), (F.col("run") - F.floor(F.col("run") / F.col("route_m")) * F.col("route_m")).alias("along"), F.floor(F.col("run") / F.col("route_m")).alias("lap"))


def subset_or_whole(edges: DataFrame, keep: Column) -> DataFrame:
    """The edges to keep; all of them if that is none."""
    some = edges.where(keep)
    return edges if some.isEmpty() else some


def nearest_hour(cache: DataFrame, wanted: DataFrame, key: list[str], hour: str, value: str, asked: str) -> DataFrame:
    """key, asked, hour, value: of each key the cached hour nearest to the one asked (of equals the earlier)."""
    j = wanted.join(cache, key)
    return j.groupBy(*key, asked).agg(F.min_by(F.struct(hour, value), F.struct(F.abs(F.col(hour) - F.col(asked)), hour)).alias("m")).select(*key, asked, f"m.{hour}", f"m.{value}")


def clearance(points: DataFrame, spans: DataFrame, span: str, corridor: float = 12.0, base: float = 6.0, above: float = 3.0) -> DataFrame:
    """span, deck: the height that clears every point (x, y, z) nearer than corridor to the span, `base` at least."""
    from cityweave.operators.rasterize import walk_near
    from cityweave.operators.spatial import point_segment

    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    cells = spans.where("x1 <> x2 OR y1 <> y2").withColumn("c", F.explode(walk_near(*(e / corridor for e in ends), 1))).select(span, "x1", "y1", "x2", "y2", F.col("c.col").alias("_c"), F.col("c.row").alias("_r"))
    tops = points.groupBy("x", "y").agg(F.max("z").alias("z")).withColumn("_c", F.floor(F.col("x") / corridor)).withColumn("_r", F.floor(F.col("y") / corridor))
    near = cells.join(tops, ["_c", "_r"]).where(point_segment(F.col("x"), F.col("y"), *ends) < corridor).groupBy(span).agg(F.max("z").alias("_top"))
    return spans.select(span).join(near, span, "left").select(span, F.greatest(F.lit(base), F.coalesce(F.col("_top") + above, F.lit(base))).alias("deck"))


def hits_box(o: tuple[Column, Column, Column], d: tuple[Column, Column, Column], lo: tuple[Column, Column, Column], hi: tuple[Column, Column, Column]) -> Column:
    """Does a ray from o along d (no part zero or null is free) meet the box? The slabs of the three axes must overlap ahead."""
    enter, leave = [], []
    for k in range(3):
        a, b = (lo[k] - o[k]) / d[k], (hi[k] - o[k]) / d[k]
        free = (d[k] == 0) & (o[k] >= lo[k]) & (o[k] <= hi[k])
        shut = (d[k] == 0) & ~((o[k] >= lo[k]) & (o[k] <= hi[k]))
        enter.append(F.when(free, F.lit(-1e300)).when(shut, F.lit(1e300)).otherwise(F.least(a, b)))
        leave.append(F.when(free, F.lit(1e300)).when(shut, F.lit(-1e300)).otherwise(F.greatest(a, b)))
    return F.greatest(*enter, F.lit(0.0)) <= F.least(*leave)


def buckets(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """key and the cells (bx, by) of a plane grid that each box (x0, y0, x1, y1) reaches into: what a tree of them would index."""
    f = lambda c: F.floor(F.col(c) / size)
    return boxes.withColumn("bx", F.explode(F.sequence(f("x0"), f("x1")))).withColumn("by", F.explode(F.sequence(f("y0"), f("y1"))))


def bucket_bounds(bucketed: DataFrame) -> DataFrame:
    """bx, by, n and the box of what each cell holds."""
    return bucketed.groupBy("bx", "by").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def candidates(bucketed: DataFrame, centres: DataFrame, centre: str, key: str, radius: float, size: float) -> DataFrame:
    """centre, key: all boxes of which a cell lies in reach of a centre (cx, cy): a superset of those within the radius."""
    span = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - radius) / size) - 1, F.floor((F.col(c) + radius) / size)))
    reach = centres.withColumn("bx", span("cx")).withColumn("by", span("cy"))
    dx = F.greatest(F.col("bx") * size - F.col("cx"), F.lit(0.0), F.col("cx") - (F.col("bx") + 1) * size)
    dy = F.greatest(F.col("by") * size - F.col("cy"), F.lit(0.0), F.col("cy") - (F.col("by") + 1) * size)
    return reach.where(dx * dx + dy * dy <= radius * radius).join(bucketed.select(key, "bx", "by"), ["bx", "by"]).select(centre, key).distinct()
