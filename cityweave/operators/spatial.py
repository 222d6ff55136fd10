"""Range and nearest-neighbour joins on projected coordinates, by cells instead of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.parse import clip
from cityweave.operators.numbering import numbered
from cityweave.session import checkpointed


def grid_cell(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def near_cells(x: Column, y: Column, size: float) -> Column:
    """The 3 x 3 cells around a point's own."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    return F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def within(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "px", ry: str = "py", strict: bool = False) -> DataFrame:
    """Pairs of a left and a right row at most (strict: less than) `radius` apart, with their distance.

    Only the right side is copied, to the nine cells around it; both are joined by cell, never by a broadcast: sizes are
    estimated before the copies, so the driver would be sent a large side that looks small.
    """
    a = left.withColumn("_c", grid_cell(F.col(lx), F.col(ly), radius))
    b = right.withColumn("_c", F.explode(near_cells(F.col(rx), F.col(ry), radius)))
    d = distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry))
    j = a.join(b.hint("merge"), "_c").withColumn("distance", d).drop("_c")
    return j.where(F.col("distance") < radius if strict else F.col("distance") <= radius)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float, lx: str = "x", ly: str = "y", rx: str = "px", ry: str = "py", strict: bool = False) -> DataFrame:
    """The nearest right row within `radius` of each left row (ties: the smallest id); left rows without one go.

    Rows of one place are taken once, on either side: of right ones the smallest id counts."""
    spots = right.groupBy(rx, ry).agg(F.min(right_id).alias(right_id))
    j = within(left.select(lx, ly).distinct(), spots, radius, lx, ly, rx, ry, strict)
    best = j.groupBy(lx, ly).agg(F.min(F.struct("distance", right_id)).alias("_x"))
    return left.select(left_id, lx, ly).join(best, [lx, ly]).groupBy(left_id).agg(F.min("_x").alias("_x")).select(left_id, F.col(f"_x.{right_id}").alias(right_id), F.col("_x.distance").alias("distance"))


def neighbour_count(points: DataFrame, point_id: str, radius: float) -> DataFrame:
    """How many points, itself included, lie within `radius` of each point."""
    places = points.groupBy("x", "y").agg(F.count("*").alias("_n"))  # points of one place count together
    other = places.select(F.col("x").alias("px"), F.col("y").alias("py"), "_n")
    near = within(places.select("x", "y"), other, radius).groupBy("x", "y").agg(F.sum("_n").alias("neighbours"))
    return points.select(point_id, "x", "y").join(near, ["x", "y"]).select(point_id, "neighbours")


def nearest_small(left: DataFrame, right: DataFrame, left_id: str, right_id: str, most: int = 100_000, few: int = 4_000) -> DataFrame:
    """The nearest row of a table of few places, at any distance (ties: the smallest id); without a place to go to, nulls.

    Rows of one place are taken once, on either side. Up to `few` right places are compared with each left one. Of more, those
    near the left place are searched first, in circles that double until each place has its nearest; a table of more than
    `most` places is refused: use nearest()."""
    spots = right.groupBy("px", "py").agg(F.min(right_id).alias(right_id)).where("px IS NOT NULL AND py IS NOT NULL")
    size = spots.limit(most + 1).agg(F.count("*").alias("n"), *(f(c).alias(f"{g}{c}") for c in ("px", "py") for g, f in (("lo", F.min), ("hi", F.max)))).first()
    if size.n > most:
        raise ValueError(f"{size.n} places or more; nearest() takes any number")
    places = left.select("x", "y").distinct()
    found: DataFrame | None = None
    if size.n > few:
        places, spots = checkpointed(places), checkpointed(spots)
        span = max(size.hipx - size.lopx, size.hipy - size.lopy)
        radius = 2 * span / math.sqrt(size.n)
        while radius < span / 8:
            near = within(places, spots, radius).groupBy("x", "y").agg(F.min(F.struct("distance", right_id)).alias("_x"))
            near = checkpointed(near)
            found = near if found is None else found.unionByName(near)
            places = checkpointed(places.join(near, ["x", "y"], "left_anti"))
            if places.isEmpty():
                break
            radius *= 2
    packed = spots.agg(F.collect_list(F.struct(F.col(right_id), F.col("px"), F.col("py"))).alias("_all"))
    best = F.array_min(F.transform("_all", lambda r: F.struct(distance(F.col("x"), F.col("y"), r["px"], r["py"]).alias("distance"), r[right_id].alias(right_id))))
    rest = places.crossJoin(F.broadcast(packed)).select("x", "y", best.alias("_x"))
    found = rest if found is None else found.unionByName(rest)
    return left.select(left_id, "x", "y").join(found, ["x", "y"], "left").select(left_id, F.col(f"_x.{right_id}").alias(right_id), F.col("_x.distance").alias("distance"))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n < 1e-12, 0.0).otherwise(clip(F.try_divide((px - ax) * dx + (py - ay) * dy, n), 0.0, 1.0))
    return distance(px, py, ax + t * dx, ay + t * dy)


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...], touch: bool = True) -> Column:
    """Segments (x0, y0, x1, y1) cross; with touch, a may touch b, not the other way round."""
    d1, d2 = side(*b, a[0], a[1]), side(*b, a[2], a[3])
    d3, d4 = side(*a, b[0], b[1]), side(*a, b[2], b[3])
    return ((d1 * d2 <= 0) if touch else (d1 * d2 < 0)) & (d3 * d4 < 0)


def segment_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float, margin: float = 0.0) -> Column:
    """All cells that the box of a segment, widened by a margin, covers."""
    span = lambda p, q: F.sequence(F.floor((F.least(p, q) - margin) / size), F.floor((F.greatest(p, q) + margin) / size))
    return F.flatten(F.transform(span(ax, bx), lambda i: F.transform(span(ay, by), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def points_near_segments(points: DataFrame, segments: DataFrame, point_id: str, segment_id: str, radius: float, size: float = 100.0) -> DataFrame:
    """The nearest segment (ax, ay, bx, by) within radius of each point (x, y); exact for segments of any length.

    A segment goes to the cells along its way and those within the radius of them, so its copies grow with its length.
    Segments and points that lie on each other are taken once: of equal segments the smallest id counts."""
    from cityweave.operators.rasterize import walk_near

    ends = ["ax", "ay", "bx", "by"]
    near = walk_near(*(F.col(c) / size for c in ends), math.ceil(radius / size))
    s = segments.groupBy(*ends).agg(F.min(segment_id).alias(segment_id)).withColumn("_w", F.explode(near)).withColumn("_cx", F.col("_w.col")).withColumn("_cy", F.col("_w.row")).drop("_w")
    places = points.select("x", "y").distinct()
    j = places.withColumn("_cx", F.floor(F.col("x") / size)).withColumn("_cy", F.floor(F.col("y") / size)).join(s, ["_cx", "_cy"])
    j = j.withColumn("distance", point_segment(*(F.col(c) for c in ("x", "y", *ends)))).where(F.col("distance") <= radius)
    best = j.groupBy("x", "y").agg(F.min(F.struct("distance", segment_id)).alias("_x"))
    return points.select(point_id, "x", "y").join(best, ["x", "y"]).select(point_id, F.col(f"_x.{segment_id}").alias(segment_id), F.col("_x.distance").alias("distance"))


def in_disc(x: Column, y: Column, radius: float, margin: float = 0.0) -> Column:
    """Inside a disc round the origin; a radius of 0 or less keeps all."""
    return F.lit(True) if radius <= 0 else x * x + y * y <= (radius + margin) ** 2


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def box_contains(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x0"] <= b["x0"]) & (b["x1"] <= a["x1"]) & (a["y0"] <= b["y0"]) & (b["y1"] <= a["y1"])


def box_overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap over the smaller box."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda q: (q["x1"] - q["x0"]) * (q["y1"] - q["y0"])
    return F.try_divide(w * h, F.least(area(a), area(b)))


def circle_box(cx: Column, cy: Column, r: Column, box: dict[str, Column]) -> Column:
    dx, dy = cx - F.least(F.greatest(cx, box["x0"]), box["x1"]), cy - F.least(F.greatest(cy, box["y0"]), box["y1"])
    return dx * dx + dy * dy <= r * r


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for one literal ring."""
    inside = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if ay != by:
            inside = inside + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return inside % 2 == 1


def dedup_nodes(points: DataFrame, order: str) -> DataFrame:
    """node_id by first appearance of coordinates rounded to 2 places: node_id, rx, ry, first."""
    k = points.groupBy(F.round("x", 2).alias("rx"), F.round("y", 2).alias("ry")).agg(F.min(order).alias("first"))
    return numbered(k, "first", name="node_id")
