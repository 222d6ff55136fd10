"""Shadow and light coverage: rays walked through cells of space, met there with the triangles of the cell.

Rays and triangles are rows and all geometry is column arithmetic: no triangle passes through the driver or a broadcast, and
a scene may be of any size. A triangle lies in the cells that its box touches, a ray in those along its way, whose layers
follow from the ray's height there; both are joined by cell, and a ray counts as blocked if any triangle blocks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.rasterize import walk
from cityweave.operators.spatial import within

EPS = 1e-9
#: Nearer hits are the ray's own origin.
NEAR = 1e-6
#: Side of a cell.
CELL = 8.0

Vector = tuple[Column, Column, Column]


def _minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _of(name: str) -> Vector:
    return tuple(F.col(f"{name}.{c}") for c in "xyz")


def ray_hit(origin: Vector, direction: Vector, v0: Vector, v1: Vector, v2: Vector) -> Column:
    """Distance along a ray to a triangle, null where it misses (Moller and Trumbore)."""
    e1, e2, s = _minus(v1, v0), _minus(v2, v0), _minus(origin, v0)
    p, q = _cross(direction, e2), _cross(s, e1)
    det = _dot(p, e1)
    u, v, t = _dot(s, p) / det, _dot(direction, q) / det, _dot(e2, q) / det
    return F.when(F.abs(det) > EPS, F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t > NEAR), t))


def _layers(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def triangle_cells(triangles: DataFrame, size: float) -> DataFrame:
    """Triangles (v0, v1, v2: structs of x, y, z), once in each cell cx, cy, cz that their box touches."""
    out = triangles.select("v0", "v1", "v2")
    for axis in "xyz":
        ends = [F.col(f"{v}.{axis}") for v in ("v0", "v1", "v2")]
        out = out.withColumn(f"c{axis}", F.explode(_layers(F.least(*ends) - NEAR, F.greatest(*ends) + NEAR, size)))
    return out


def ray_cells(rays: DataFrame, size: float) -> DataFrame:
    """Rays (o, d: structs of x, y, z; reach), once in each cell along the way to their reach."""
    end = lambda c: F.col(f"o.{c}") + F.col(f"d.{c}") * F.col("reach")
    way = walk(F.col("o.x") / size, F.col("o.y") / size, end("x") / size, end("y") / size)
    x = rays.withColumn("_w", F.explode(way)).withColumn("cx", F.col("_w.col")).withColumn("cy", F.col("_w.row")).drop("_w")
    enter, leave = F.lit(0.0), F.col("reach")
    for axis in "xy":
        o, d, c = F.col(f"o.{axis}"), F.col(f"d.{axis}"), F.col(f"c{axis}")
        a, b = (c * size - o) / d, ((c + 1) * size - o) / d
        still = F.abs(d) < EPS
        enter = F.greatest(enter, F.when(still, F.lit(0.0)).otherwise(F.least(a, b) - NEAR))
        leave = F.least(leave, F.when(still, F.col("reach")).otherwise(F.greatest(a, b) + NEAR))
    z = lambda t: F.col("o.z") + F.col("d.z") * t
    x = x.withColumn("_a", enter).withColumn("_b", F.greatest(leave, F.col("_a")))
    low, high = F.least(z(F.col("_a")), z(F.col("_b"))), F.greatest(z(F.col("_a")), z(F.col("_b")))
    return x.withColumn("cz", F.explode(_layers(low - NEAR, high + NEAR, size))).drop("_a", "_b")


def blocked(rays: DataFrame, triangles: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """Keys of the rays that a triangle stands in the way of, before their reach."""
    met = ray_cells(rays, size).join(triangle_cells(triangles.select("v0", "v1", "v2").distinct(), size), ["cx", "cy", "cz"])
    t = ray_hit(_of("o"), _of("d"), _of("v0"), _of("v1"), _of("v2"))
    return met.where(t < F.col("reach")).select(*keys).distinct()


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def shadowed(points: DataFrame, triangles: DataFrame, sun: tuple[float, float, float], size: float = CELL) -> DataFrame:
    """point_id, shadowed of points (point_id, x, y, z): does any triangle stand between the point and the sun?

    With the sun below the horizon all points are in the shade. A ray ends where it leaves the box of all triangles. Points of
    one place share a ray, and triangles that lie on each other are met once."""
    if sun[2] <= 0:
        return points.select("point_id", F.lit(True).alias("shadowed"))
    length = sum(c * c for c in sun) ** 0.5
    d = [c / length for c in sun]
    ends = [F.array(*(F.col(f"{v}.{axis}") for v in ("v0", "v1", "v2"))) for axis in "xyz"]
    box = triangles.agg(*(f(g(e)).alias(f"{n}{axis}") for axis, e in zip("xyz", ends) for n, f, g in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max)))).first()
    if box.lox is None:
        return points.select("point_id", F.lit(False).alias("shadowed"))
    reach = (F.lit(float(box.hiz)) - F.col("z")) / d[2]
    for axis, step in zip("xy", d):
        if abs(step) > EPS:
            reach = F.least(reach, (F.lit(float(box[f"hi{axis}"] if step > 0 else box[f"lo{axis}"])) - F.col(axis)) / step)
    at = ["x", "y", "z"]
    rays = points.select(*at).distinct().select(*at, _point(F.col("x"), F.col("y"), F.col("z")).alias("o"), _point(*(F.lit(c) for c in d)).alias("d"), (reach + 1e-3).alias("reach")).where("reach > 0")
    dark = blocked(rays, triangles, at, size).withColumn("_dark", F.lit(True))
    return points.select("point_id", *at).join(dark, at, "left").select("point_id", F.coalesce("_dark", F.lit(False)).alias("shadowed"))


def lit_share(points: DataFrame, shade: DataFrame, by: str, area: str) -> DataFrame:
    """Area-weighted share of lit ground for each group; groups without area give 0."""
    j = points.join(shade, "point_id")
    return j.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(F.when(~F.col("shadowed"), F.col(area)).otherwise(0.0)), F.sum(area)), F.lit(0.0)).alias("lit"))


def light_coverage(ground: DataFrame, lights: DataFrame, walls: DataFrame, radius: float, size: float = CELL) -> DataFrame:
    """point_id, lights that reach it: within radius and not blocked.

    Light-point pairs are found by cells; a pair of no length is lit; a hit at the light itself doesn't block. Points of one
    place, and lights of one place, share their rays."""
    at, to = ["x", "y", "z"], ["px", "py", "pz"]
    l = lights.groupBy(*(F.col(c).alias(p) for c, p in zip(at, to))).agg(F.count("*").alias("_lights"))  # noqa: E741
    pairs = within(ground.select(*at).distinct(), l, radius)
    way = [F.col(f"p{c}") - F.col(c) for c in "xyz"]
    pairs = pairs.withColumn("_n", F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2]))
    rays = pairs.where("_n > 1e-5").select(*at, *to, _point(F.col("x"), F.col("y"), F.col("z")).alias("o"), _point(*(w / F.col("_n") for w in way)).alias("d"), (F.col("_n") - 1e-5).alias("reach"))
    lit = pairs.join(blocked(rays, walls, [*at, *to], size), [*at, *to], "left_anti")
    n = lit.groupBy(*at).agg(F.sum("_lights").alias("lights"))
    return ground.select("point_id", *at).join(n, at, "left").select("point_id", "lights").fillna(0, ["lights"])


def coverage_cost(coverage: DataFrame, ground: DataFrame, dark_weight: float = 1.0, double_weight: float = 0.2) -> DataFrame:
    """Weighted area without light plus the area that two lights or more reach."""
    j = coverage.join(ground.select("point_id", "area", "weight"), "point_id")
    return j.agg((dark_weight * F.sum(F.when(F.col("lights") == 0, F.col("area") * F.col("weight")).otherwise(0.0)) + double_weight * F.sum(F.when(F.col("lights") >= 2, F.col("area")).otherwise(0.0))).alias("cost"))
