"""Searches and sight lines over rows that share few places: each place is taken once, with the results of all rows."""

import numpy as np
import pytest

from cityweave.operators import sightlines, spatial
from cityweave.operators.spatial import nearest, nearest_small, within


@pytest.fixture(scope="module")
def crowd(spark):
    r = np.random.default_rng(5)
    left = [(k, float(k % 7) * 3, float(k % 5) * 4 + 0.5) for k in range(400)]
    right = [(1000 - k, float(k % 4) * 5.25, float(k % 3) * 6.5) for k in range(240)]
    spread = [(k, *map(float, r.random(2) ** 4 * 1000)) for k in range(900)]
    far = [(k, *map(float, r.random(2) * 1000)) for k in range(300)] + [(999, 5000.0, -5000.0)]
    frames = [spark.createDataFrame(x, f"{i} long, {a} double, {b} double") for x, i, a, b in ((left, "id", "x", "y"), (right, "node", "px", "py"), (spread, "node", "px", "py"), (far, "id", "x", "y"))]
    return left, right, spread, far, *frames


def brute(left, right, radius=float("inf")):
    d = lambda a, b: float(np.sqrt((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2))
    best = {a[0]: min((d(a, b), b[0]) for b in right) for a in left}
    return {k: (n, x) for k, (x, n) in best.items() if x <= radius}


def rows(df):
    return {x.id: (x.node, x.distance) for x in df.collect()}


def test_nearest_by_places(crowd, monkeypatch):
    left, right, _, _, lf, rf, _, _ = crowd
    seen = []
    monkeypatch.setattr(spatial, "within", lambda a, b, *more, **names: (seen.append((a.count(), b.count())), within(a, b, *more, **names))[1])
    assert rows(nearest(lf, rf, "id", "node", 4.0)) == brute(left, right, 4.0)
    assert seen == [(35, 12)]


def test_nearest_at_any_distance_by_places(crowd):
    left, right, _, _, lf, rf, _, _ = crowd
    assert rows(nearest_small(lf, rf, "id", "node", most=12)) == brute(left, right)
    with pytest.raises(ValueError):
        nearest_small(lf, rf, "id", "node", most=11)


def test_nearest_among_many_places_in_circles(crowd):
    _, _, spread, far, _, _, sf, ff = crowd
    assert rows(nearest_small(ff, sf, "id", "node", few=20)) == brute(far, spread)


def test_points_of_one_place_share_their_rays(spark, monkeypatch):
    v = "struct<x:double,y:double,z:double>"
    wall = ((5.0, -5.0, 0.0), (5.0, 15.0, 0.0), (5.0, 5.0, 30.0))
    walls = spark.createDataFrame([wall] * 50, f"v0 {v}, v1 {v}, v2 {v}")
    points = spark.createDataFrame([(k, float(k % 3) * 4, 5.0, 1.0) for k in range(300)], "point_id long, x double, y double, z double")
    lights = spark.createDataFrame([(k, 9.5, 5.0 + k % 2, 1.5) for k in range(10)], "light_id long, x double, y double, z double")
    seen, real, cells = [], sightlines.ray_cells, sightlines.triangle_cells
    monkeypatch.setattr(sightlines, "ray_cells", lambda rays, size: (seen.append(rays.count()), real(rays, size))[1])
    monkeypatch.setattr(sightlines, "triangle_cells", lambda t, size: (seen.append(t.count()), cells(t, size))[1])
    dark = {x.point_id: x.shadowed for x in sightlines.shadowed(points, walls, (1.0, 0.0, 0.5)).collect()}
    assert dark == {k: k % 3 < 2 for k in range(300)}
    lit = {x.point_id: x.lights for x in sightlines.light_coverage(points, lights, walls, 20.0).collect()}
    assert lit == {k: 10 if k % 3 == 2 else 0 for k in range(300)}
    assert seen == [2, 1, 6, 1]
