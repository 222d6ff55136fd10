"""Rays through cells against all rays by all triangles."""

import numpy as np
import pytest

from cityweave.operators import sightlines

V = "struct<x:double,y:double,z:double>"


def hits(o, d, tri, reach):
    a, e1, e2 = tri[:, 0], tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    p = np.cross(d, e2)
    det = (p * e1).sum(1)
    with np.errstate(all="ignore"):
        s = o - a
        u, q = (s * p).sum(1) / det, np.cross(s, e1)
        v, t = (d * q).sum(1) / det, (e2 * q).sum(1) / det
        return bool(((abs(det) > 1e-9) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 1e-6) & (t < reach)).any())


@pytest.fixture(scope="module")
def town(spark):
    r = np.random.default_rng(3)
    base = r.random((150, 1, 3)) * (120, 90, 4)
    tri = base + r.random((150, 3, 3)) * (14, 14, 12)
    tri[0] = [[-50, -50, 3.0], [200, -50, 3.0], [60, 160, 3.0]]  # over many cells
    points = [(k, *map(float, r.random(3) * (120, 90, 2))) for k in range(160)] + [(900, 60.0, 40.0, 500.0)]
    rows = [tuple(tuple(map(float, c)) for c in t) for t in tri]
    return tri, points, spark.createDataFrame(rows, f"v0 {V}, v1 {V}, v2 {V}"), spark.createDataFrame(points, "point_id long, x double, y double, z double")


@pytest.mark.parametrize("sun,size", [((0.5, 0.25, 0.75), 8.0), ((-1.0, 0.0, 0.05), 8.0), ((0.0, 0.0, 1.0), 3.0), ((0.3, -0.9, 0.2), 40.0)])
def test_shadows(spark, town, sun, size):
    tri, points, triangles, df = town
    d = np.array(sun) / np.linalg.norm(sun)
    want = {p[0]: hits(np.array(p[1:]), d, tri, np.inf) for p in points}
    assert {r.point_id: r.shadowed for r in sightlines.shadowed(df, triangles, sun, size).collect()} == want
    assert len(set(want.values())) == 2


def test_light_reaches(spark, town):
    tri, points, triangles, df = town
    lights = [(k, 10.0 * k, 7.0 * k + 0.5, 6.0) for k in range(12)] + [(99, *points[0][1:])]
    want = {p[0]: 0 for p in points}
    for p in points:
        for _, *at in lights:
            way = np.array(at) - np.array(p[1:])
            n = np.linalg.norm(way)
            if np.hypot(*way[:2]) <= 25 and (n <= 1e-5 or not hits(np.array(p[1:]), way / n, tri, n - 1e-5)):
                want[p[0]] += 1
    got = sightlines.light_coverage(df, spark.createDataFrame(lights, "light_id long, x double, y double, z double"), triangles, 25.0)
    assert {r.point_id: r.lights for r in got.collect()} == want and max(want.values()) > 1


def test_no_scene_and_no_sun(spark, town):
    _, points, triangles, df = town
    assert not any(r.shadowed for r in sightlines.shadowed(df, triangles.limit(0), (0.0, 1.0, 1.0)).collect())
    assert all(r.shadowed for r in sightlines.shadowed(df, triangles, (0.0, 1.0, 0.0)).collect())
    plan = sightlines.shadowed(df, triangles, (0.0, 1.0, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
