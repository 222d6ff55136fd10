"""Polygons and lines put on grids, by scan lines and by walks along segments.

Polygons are tables of their sides (a polygon id, x1, y1, x2, y2 in cell units); rings of one id count together, by the
even-odd rule. Work grows with the scan lines that sides cross and with the cells covered, never with cells times sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sides(points: DataFrame, ring: list[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Closed rings of points (ring columns, order, x, y) as their sides: the ring columns, x1, y1, x2, y2."""
    w = Window.partitionBy(*ring).orderBy(order)
    whole = Window.partitionBy(*ring).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return points.select(*ring, F.col(x).alias("x1"), F.col(y).alias("y1"), nxt(x).alias("x2"), nxt(y).alias("y2"))


def inside_samples(polygons: DataFrame, poly: str, sub: int = 1) -> DataFrame:
    """poly, i, j: the samples inside, `sub` x `sub` to a cell; sample i is at (i + 0.5) / sub.

    A line of samples meets the sides at places that are sorted; between the first and second, third and fourth ... is inside."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low * sub - 0.5), F.ceil(high * sub - 0.5) - 1
    lines = polygons.withColumn("_a", first).withColumn("_b", last).where("_b >= _a").withColumn("j", F.explode(F.sequence("_a", "_b")))
    yy = (F.col("j") + 0.5) / sub
    met = lines.select(poly, "j", (F.col("x1") + (yy - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("_x"))
    w = Window.partitionBy(poly, "j").orderBy("_x")
    runs = met.withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("_x").over(w)).where("_n % 2 = 1 AND _to IS NOT NULL")
    runs = runs.withColumn("_a", F.ceil(F.col("_x") * sub - 0.5)).withColumn("_b", F.ceil(F.col("_to") * sub - 0.5) - 1).where("_b >= _a")
    return runs.select(poly, F.explode(F.sequence("_a", "_b")).alias("i"), "j")


def coverage(polygons: DataFrame, poly: str, sub: int = 4) -> DataFrame:
    """poly, row, col, fraction: the share of each cell's sub x sub samples that a polygon covers."""
    s = inside_samples(polygons, poly, sub)
    cell = s.groupBy(poly, F.floor(F.col("j") / sub).alias("row"), F.floor(F.col("i") / sub).alias("col"))
    return cell.agg((F.count("*") / (sub * sub)).alias("fraction"))


def discs(centres: DataFrame, key: str, radius: float | Column, corners: int = 24) -> DataFrame:
    """The sides of regular polygons round the centres (key, x, y)."""
    r = F.lit(radius) if isinstance(radius, (int, float)) else radius
    k = centres.withColumn("_r", r).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))
    at = lambda n: (F.col("x") + F.col("_r") * F.cos(n * 2 * 3.141592653589793 / corners), F.col("y") + F.col("_r") * F.sin(n * 2 * 3.141592653589793 / corners))
    (x1, y1), (x2, y2) = at(F.col("_k")), at((F.col("_k") + 1) % corners)
    return k.select(key, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def walk(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Array of (col, row) of the unit cells that a segment passes through: between its meetings with grid lines lies one cell each."""
    def meetings(a: Column, b: Column) -> Column:
        lo, hi = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        return F.when((hi >= lo) & (a != b), F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), meetings(x1, x2), meetings(y1, y2))))
    middle = F.transform(F.arrays_zip(F.slice(t, F.lit(1), F.size(t) - 1).alias("a"), F.slice(t, F.lit(2), F.size(t) - 1).alias("b")), lambda p: (p["a"] + p["b"]) / 2)
    return F.array_distinct(F.transform(middle, lambda m: F.struct(F.floor(x1 + m * (x2 - x1)).alias("col"), F.floor(y1 + m * (y2 - y1)).alias("row"))))


def walk_near(x1: Column, y1: Column, x2: Column, y2: Column, margin: int) -> Column:
    """The cells of walk() and those at most `margin` cells from one of them: their number grows with the segment's length."""
    offsets = [(i, j) for i in range(-margin, margin + 1) for j in range(-margin, margin + 1)]
    near = F.transform(walk(x1, y1, x2, y2), lambda c: F.array(*(F.struct((c["col"] + i).alias("col"), (c["row"] + j).alias("row")) for i, j in offsets)))
    return F.array_distinct(F.flatten(near))


def touched(polygons: DataFrame, poly: str) -> DataFrame:
    """poly, row, col of all cells that a polygon touches: those whose centre is inside and those that its sides pass through."""
    inside = inside_samples(polygons, poly).select(poly, F.col("j").alias("row"), F.col("i").alias("col"))
    rim = polygons.select(poly, F.explode(walk(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("c")).select(poly, "c.row", "c.col")
    return inside.union(rim).distinct()


def line_mask(lines: DataFrame, key: str, buffer: float) -> DataFrame:
    """key, row, col of the cells whose centre is at most `buffer` cells from one of the key's segments."""
    from cityweave.operators.spatial import point_segment

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    near = lines.withColumn("c", F.explode(walk_near(x1, y1, x2, y2, int(buffer + 1.5))))
    return near.where(point_segment(F.col("c.col") + 0.5, F.col("c.row") + 0.5, x1, y1, x2, y2) <= buffer).select(key, "c.row", "c.col").distinct()


def rim(polygons: DataFrame, poly: str, buffer: float) -> DataFrame:
    """poly, row, col of the cells outside a polygon whose centre is at most `buffer` cells from its sides."""
    inside = inside_samples(polygons, poly).select(poly, F.col("j").alias("row"), F.col("i").alias("col"))
    return line_mask(polygons, poly, buffer).join(inside, [poly, "row", "col"], "left_anti")


def painted(fractions: DataFrame, cls: str) -> DataFrame:
    """cls, row, col, fraction: what all objects of a class cover of a cell, 1 at most."""
    return fractions.groupBy(cls, "row", "col").agg(F.least(F.sum("fraction"), F.lit(1.0)).alias("fraction"))
