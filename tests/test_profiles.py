"""Profiles along paths against a walk with plain arithmetic."""

import math
import random

import pytest

from cityweave.operators import profiles


def walk(points, spacing):
    sides = [math.dist(a, b) for a, b in zip(points, points[1:])]
    total = sum(sides)
    n = max(2, int(total / spacing) + 2)
    out = []
    for i in range(n):
        d, k = total * i / (n - 1), 0
        while k < len(sides) - 1 and d > sides[k]:
            d, k = d - sides[k], k + 1
        t = min(d / sides[k], 1.0) if sides[k] else 0.0
        (ax, ay), (bx, by) = points[k], points[k + 1]
        out.append((ax + t * (bx - ax), ay + t * (by - ay)))
    return total, out


def test_profiles(spark):
    r = random.Random(4)
    z = {(i, j): float(r.randrange(50)) for i in range(30) for j in range(30)}
    cells = spark.createDataFrame([(*k, h) for k, h in z.items()], "row long, col long, z double")
    paths = {k: [(r.uniform(-3, 62), r.uniform(0, 58)) for _ in range(r.randint(2, 9))] for k in range(20)}
    paths |= {90: [(4.0, 4.0)] * 3, 91: [(0.0, 0.0), (0.0, 0.0), (10.0, 0.0), (10.0, 0.0)], 92: [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)], 93: [(1.0, 1.0)]}
    rows = [(k, i, *p) for k, line in paths.items() for i, p in enumerate(line)]
    r.shuffle(rows)
    v = spark.createDataFrame(rows, "path_id long, pos int, x double, y double")

    def height(x, y):
        a, b = math.floor(y / 2), math.floor(x / 2)
        return sum((1 - abs(y / 2 - i)) * (1 - abs(x / 2 - j)) * z.get((i, j), 0.0) for i in (a, a + 1) for j in (b, b + 1))

    got = {x.path_id: x for x in profiles.heights_along(v, cells, "z", 5.0, 2.0).collect()}
    assert set(got) == set(paths) - {93}
    for k in got:
        total, at = walk(paths[k], 5.0)
        assert got[k].length == pytest.approx(total) and got[k]["count"] == len(at)
        assert got[k].profile == pytest.approx([height(*p) for p in at], abs=1e-6)
    wide = {x.path_id: x.profile for x in profiles.heights_along(v, cells, "z", 5.0, 2.0, padded=True).collect()}
    most = max(x["count"] for x in got.values())
    assert all(wide[k] == pytest.approx(got[k].profile + [0.0] * (most - len(got[k].profile))) for k in got)
    assert profiles.heights_along(v.where("path_id < 0"), cells, "z", padded=True).count() == 0
