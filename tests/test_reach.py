"""Targets out of reach, against a search from every origin; small graphs and the moving frontier alike."""

import random

import pytest

from cityweave.operators import network


def brute(edges, nodes, pairs):
    out = {}
    for pair, origin, destination in pairs:
        seen, todo = {origin}, [origin]
        while todo:
            u = todo.pop()
            for a, b in edges:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        if origin not in nodes or destination not in nodes:
            out[pair] = None
        elif destination in seen:
            out[pair] = (destination, 0.0)
        else:
            x, y = nodes[destination]
            out[pair] = min((((nodes[n][0] - x) ** 2 + (nodes[n][1] - y) ** 2, n) for n in seen - {origin} if n in nodes), default=None)
            out[pair] = out[pair] and (out[pair][1], out[pair][0] ** 0.5)
    return out


@pytest.mark.parametrize("small", [0, 1000])
def test_targets(spark, small):
    r = random.Random(3)
    nodes = {k: (float(r.randrange(6)), float(r.randrange(6))) for k in range(24)}
    edges = [(r.randrange(26), r.randrange(26)) for _ in range(26)] * 2
    pairs = [(k, r.randrange(26), r.randrange(26)) for k in range(60)] + [(60, 3, 3), (61, 3, 99), (62, 99, 3)]
    got = network.reachable_targets(
        spark.createDataFrame(edges, "u long, v long"), spark.createDataFrame([(k, *p) for k, p in nodes.items()], "node_id long, x double, y double"),
        spark.createDataFrame(pairs, "pair_id long, origin long, destination long"), small,
    ).collect()
    want = brute(edges, nodes, pairs)
    assert len(got) == len(pairs)
    for x in got:
        t = want[x.pair_id]
        assert (x.target, x.distance) == ((t[0], pytest.approx(t[1])) if t else (None, None))
        assert x.moved == (None if t is None else t[0] != dict((p, d) for p, _, d in pairs)[x.pair_id])


def test_copies_of_points_are_not_broadcast(spark):
    """A table of few bytes may hold many points: its copies to cells go through a shuffle, not through the driver."""
    from cityweave.operators import spatial

    few = spark.createDataFrame([(k, float(k), float(k % 3)) for k in range(9)], "id long, x double, y double")
    near = spatial.within(few, few.toDF("other", "px", "py"), 1.5)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == sum((a - b) ** 2 + (a % 3 - b % 3) ** 2 <= 2.25 for a in range(9) for b in range(9))
