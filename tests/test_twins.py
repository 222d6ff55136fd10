"""Queries without SQL against brute force over the same small graphs."""

import random
from itertools import product

import pytest

from cityweave.operators import routing
from cityweave.plans import registry
from cityweave.plans.registry import Views

DATA = "/root/testdata/sf0.001"


def brute_betweenness(rows):
    w = {}
    for u, v, x in rows:
        w[u, v] = min(w.get((u, v), x), x)
    nodes = sorted({n for e in w for n in e})
    d = {(a, b): 0.0 if a == b else w.get((a, b), float("inf")) for a, b in product(nodes, nodes)}
    for k, a, b in product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    ways = {}
    for s in nodes:
        ways[s, s] = 1
        for t in sorted((n for n in nodes if n != s and d[s, n] < float("inf")), key=lambda n: d[s, n]):
            ways[s, t] = sum(ways.get((s, u), 0) for u in nodes if (u, t) in w and d[s, u] + w[u, t] == d[s, t])
    load = {e: 0.0 for e in w}
    for (u, v), x in w.items():
        for s, t in product(nodes, nodes):
            if s != t and d[s, t] < float("inf") and d[s, u] + x + d[v, t] == d[s, t]:
                load[u, v] += ways.get((s, u), 0) * ways.get((v, t), 0) / ways[s, t]
    n = len(nodes)
    return {(u, v): max(load[u, v], load.get((v, u), 0.0)) / (n * (n - 1)) for u, v in w}


def brute_routes(rows, s, t, k):
    w = {}
    for u, v, x in rows:
        w[u, v] = min(w.get((u, v), x), x)
    found = []

    def go(path, cost):
        if path[-1] == t:
            found.append(cost)
            return
        for (u, v), x in w.items():
            if u == path[-1] and v not in path:
                go([*path, v], cost + x)

    go([s], 0.0)
    return sorted(found)[:k]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(11), r.randrange(11), float(r.randint(1, 4))) for _ in range(40)]
    rows = [x for x in rows if x[0] != x[1]]
    e = spark.createDataFrame(rows, "u long, v long, length double")
    want = brute_betweenness(rows)
    got = {(x.u, x.v): x.centrality for x in routing.betweenness(e, "length").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs = spark.createDataFrame([(k, k, 10 - k) for k in range(5)], "pair_id long, origin long, destination long")
    routes = {}
    for x in routing.routes(e, pairs, "length", 3).orderBy("pair_id", "rank").collect():
        routes.setdefault(x.pair_id, []).append(x.cost)
        w = {}
        for u, v, c in rows:
            w[u, v] = min(w.get((u, v), c), c)
        assert abs(sum(w[a, b] for a, b in zip(x.nodes, x.nodes[1:])) - x.cost) < 1e-9
    for k in range(5):
        assert routes.get(k, []) == pytest.approx(brute_routes(rows, k, 10 - k, 3))


def test_registered_betweenness_and_routes(spark):
    e = Views(spark, DATA).edges.select("u", "v", "length", "highway").collect()
    w = {}
    for x in e:
        w[x.u, x.v] = min(w.get((x.u, x.v), x.length), x.length)
    got = registry.QUERIES["edge_betweenness"](spark, DATA).collect()
    # every pair of nodes that has a way adds the edges of its path: the sum is the sum of hops over shortest paths
    assert {(x.u, x.v) for x in got} == set(w) and all(0 <= x.centrality <= 1 for x in got)
    walk = {}
    for x in e:
        if x.highway != "footway":
            walk[x.u, x.v] = min(walk.get((x.u, x.v), x.length), x.length)
    g = routing.adjacency([(u, v, c) for (u, v), c in walk.items()])
    for x in registry.QUERIES["pareto_routes"](spark, DATA).where("rank = 0").collect():
        nodes = x.nodes
        assert len(set(nodes)) == len(nodes) and nodes[0] == x.pair_id and nodes[-1] == 99 - x.pair_id
        assert abs(sum(walk[a, b] for a, b in zip(nodes, nodes[1:])) - x.cost) < 1e-6
        assert abs(routing.dijkstra(g, nodes[0])[0][nodes[-1]] - x.cost) < 1e-6


def test_routes_and_betweenness_of_many_components(spark, monkeypatch):
    rows = [(10 * c + i, 10 * c + j, float(1 + (7 * c + 3 * i + j) % 5)) for c in range(30) for i in range(4) for j in range(4) if i != j and (c + i + j) % 3] + [(1000 + i, 1000 + (i + d) % 60, 1.0 + i % 3) for i in range(60) for d in (1, 7)]
    e = spark.createDataFrame(rows, "u long, v long, length double")
    pairs = spark.createDataFrame([(k, 10 * k, 10 * k + 3) for k in range(30)] + [(50, 1000, 1031), (51, 0, 1000), (52, 5000, 5000)], "pair_id long, origin long, destination long")
    whole = lambda f: sorted(map(tuple, f.collect()))
    want_routes, want = whole(routing.routes(e, pairs, "length", 2, piece=10**6)), {x[:2]: x[2] for x in whole(routing.betweenness(e, "length", piece=10**6))}
    monkeypatch.setattr(routing, "PART", 40)
    assert whole(routing.routes(e, pairs, "length", 2, piece=50)) == want_routes
    got = {x[:2]: x[2] for x in whole(routing.betweenness(e, "length", piece=50))}
    assert got == pytest.approx(want) and len(got) == len(rows)
    monkeypatch.setattr(routing, "broadcast_graph", lambda e, w: pytest.fail("small components were broadcast"))
    only = e.where("u < 1000")
    assert routing.betweenness(only, "length", piece=50).count() == only.count() and routing.routes(only, pairs.where("pair_id < 30"), "length", 1, piece=50).count() > 20
