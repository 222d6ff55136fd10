"""Choices in parallel rounds are those of the sequential rule."""

import math
import random

import pytest

from cityweave.operators import spacing


def in_turn(points, gap, most=None, least=None):
    taken = []
    for key, x, y, s in sorted(points, key=lambda p: (-p[3], p[0])):
        if (least is None or s >= least) and (most is None or len(taken) < most) and all((x - a) ** 2 + (y - b) ** 2 >= gap * gap for _, a, b, _ in taken):
            taken.append((key, x, y, s))
    return taken


@pytest.mark.parametrize("kind", ["random", "ties", "ramp", "one place"])
def test_spaced_is_the_sequential_rule(spark, kind):
    r = random.Random(kind)
    points = {
        "random": [(k, r.random() * 60 - 30, r.random() * 60 - 30, r.random()) for k in range(500)],
        "ties": [(k, float(k % 20), float(k // 20), float(r.randrange(3))) for k in range(200)],
        "ramp": [(k, float(k), 0.0, float(-k)) for k in range(18)],
        "one place": [(k, 1.0, 1.0, 2.0) for k in range(50)],
    }[kind]
    df = spark.createDataFrame(points, "id long, x double, y double, score double").repartition(3)
    rows = lambda d: sorted((r.id, r.x, r.y, r.score) for r in d.collect())
    assert rows(spacing.spaced(df, "id", "score", 5.0)) == sorted(in_turn(points, 5.0))
    few = spacing.spaced(df, "id", "score", 3.0, most=7, least=0.25)
    assert [(r.id, r["rank"]) for r in few.orderBy("rank").collect()] == [(p[0], k + 1) for k, p in enumerate(in_turn(points, 3.0, 7, 0.25))]
    best = sorted(points, key=lambda p: (-p[3], p[0]))[:30]
    assert rows(spacing.spaced(df, "id", "score", 3.0, examined=30)) == sorted(in_turn(best, 3.0))


def test_spaced_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, None), (2, None, 0.0, 1.0), (3, 0.0, 0.0, 1.0)], "id long, x double, y double, score double")
    assert [r.id for r in spacing.spaced(df, "id", "score", 2.0).collect()] == [3]
    assert spacing.spaced(df.limit(0), "id", "score", 2.0, most=3).count() == 0


def links_in_turn(pairs, most):
    used, out = {}, []
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if used.get(a, 0) < most and used.get(b, 0) < most:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b, d))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_links_are_those_of_the_sequential_rule(spark, most):
    r = random.Random(most)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(400)} | {(0, k) for k in range(1, 60)}
    rows = [(a, b, float(r.randrange(12))) for a, b in pairs] + [(100 + k, 101 + k, float(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "a long, b long, distance double").repartition(3)
    assert sorted(map(tuple, spacing.linked(df, most).collect())) == links_in_turn(rows, most)
    assert spacing.linked(df.limit(0)).count() == 0


def test_spread(spark):
    r = random.Random(5)
    points = [(k, float(r.randrange(200)), float(r.randrange(150)), r.randrange(9) / 8) for k in range(120)]
    df = spark.createDataFrame(points, "id long, x double, y double, density double")
    far = {p[0]: math.hypot(p[1] - 90, p[2] - 70) for p in points}
    first = min(points, key=lambda p: (-(0.65 * p[3] + 0.35 * (1 - far[p[0]] / max(far.values()))), p[0]))
    taken, target = [first], max(12.0, 200 / (math.sqrt(9) * 1.6))
    while len(taken) < 9:
        gap = lambda p: min(math.sqrt((p[1] - t[1]) ** 2 + (p[2] - t[2]) ** 2) for t in taken)  # noqa: E731, B023
        taken.append(min((p for p in points if p not in taken), key=lambda p: (-(0.72 * min(gap(p) / target, 1.0) + 0.28 * p[3]), p[0])))
    got = spacing.spread(df, "id", "density", 9, (90.0, 70.0), 200.0)
    assert [r.id for r in got.orderBy("pick").collect()] == [p[0] for p in taken]
    assert spacing.spread(df.limit(0), "id", "density", 3, (0.0, 0.0), 1.0).count() == 0
