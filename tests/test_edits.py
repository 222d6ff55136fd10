"""Edits of street graphs against the same edits one by one on dictionaries."""

import math
import random

import pytest

from cityweave.operators import edits

NODES = "node_id string, x double, y double"
EDGES = "u string, v string, key int, length double, points array<struct<x:double,y:double>>, oneway boolean, legal_forward boolean"


def graph(seed):
    r = random.Random(seed)
    nodes = {f"n{k}": (r.uniform(0, 300), r.uniform(0, 300)) for k in range(12)}
    edges = {}
    for _ in range(40):
        u, v, key = r.choice(list(nodes)), r.choice(list(nodes)), r.randrange(2)
        line = None if r.random() < 0.2 else [nodes[u], (r.uniform(0, 300), r.uniform(0, 300)), nodes[v]]
        edges[u, v, key] = (r.uniform(5, 90), line, r.choice([None, True, False]), r.choice([None, True, False]))
    return nodes, edges


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n, *p) for n, p in nodes.items()], NODES), spark.createDataFrame([(*k, *d) for k, d in edges.items()], EDGES)


def rows(df):
    out = {}
    for x in df.collect():
        assert (x.u, x.v, x.key) not in out
        out[x.u, x.v, x.key] = (round(x.length, 6), x.points and [(round(p.x, 6), round(p.y, 6)) for p in x.points], x.oneway, x.legal_forward)
    return out


def tidy(edges):
    return {k: (round(d[0], 6), d[1] and [(round(x, 6), round(y, 6)) for x, y in d[1]], *d[2:]) for k, d in edges.items()}


def one_ring(nodes, edges, c, radius, arms):
    x, y = nodes.pop(c)
    ring = {f"ra_{c}_{k}": (x + radius * math.cos(2 * math.pi * k / arms), y + radius * math.sin(2 * math.pi * k / arms)) for k in range(arms)}
    out = {}
    for (u, v, key), (length, line, *rest) in edges.items():
        if u == v == c:
            continue
        if c in (u, v):
            n = min(ring, key=lambda n: (round(math.dist(ring[n], nodes[v if u == c else u]) ** 2, 6), n))
            if line:
                line = [ring[n], *line[1:]] if u == c else [*line[:-1], ring[n]]
                length = sum(map(math.dist, line, line[1:]))
            u, v = (n, v) if u == c else (u, n)
        out[u, v, key] = (length, line, *rest)
    names = list(ring)
    for a, b in zip(names, names[1:] + names[:1]):
        out[a, b, 0] = (math.dist(ring[a], ring[b]), [ring[a], ring[b]], True, None)
    return nodes | ring, out


@pytest.mark.parametrize("seed", [1, 2])
def test_roundabouts(spark, seed):
    nodes, edges = graph(seed)
    n, e = frames(spark, nodes, edges)
    centres = ["n1", "n2", "n3", "n7"]
    got_nodes, got = edits.roundabouts(n, e, spark.createDataFrame([(c,) for c in [*centres, "n1", "none", None]], "node_id string"), 14.0, 8)
    for c in centres:
        nodes, edges = one_ring(dict(nodes), edges, c, 14.0, 8)
    assert rows(got) == tidy(edges)
    assert {x.node_id: (round(x.x, 6), round(x.y, 6)) for x in got_nodes.collect()} == {k: (round(x, 6), round(y, 6)) for k, (x, y) in nodes.items()}


def test_turned_edges(spark):
    nodes, edges = graph(3)
    edges |= {("n0", "n1", 0): (1.0, None, None, None), ("n1", "n0", 0): (2.0, [(0.0, 0.0), (3.0, 1.0)], False, True), ("n4", "n5", 0): (3.0, [(0.0, 0.0), (1.0, 1.0)], True, None), ("n5", "n4", 0): (4.0, None, False, False)}
    picks = [("n1", "n0", 0), ("n4", "n5", 0), ("n5", "n4", 0), ("n4", "n5", 0), ("n9", "n9", 7), (None, "n1", 0), sorted(edges)[0]]
    e, p = frames(spark, nodes, edges)[1], spark.createDataFrame(picks, "u string, v string, key int")
    new = {k: d for k, d in edges.items() if k not in picks}
    new |= {(k[1], k[0], k[2]): (d[0], d[1] and d[1][::-1], None if d[2] is None else True, not (True if d[3] is None else d[3])) for k, d in edges.items() if k in picks}
    assert rows(edits.turned(e, p)) == tidy(new)
    assert {tuple(x) for x in edits.unknown(e, p).collect()} == {("n9", "n9", 7), (None, "n1", 0)}
    assert edits.turned(e.where("false"), p).count() == 0


def test_bridges_and_routes(spark):
    n = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 9.0, 0.0)], NODES)
    e = spark.createDataFrame([("a", "b", 0, 5.0, None, None, None), ("a", "b", 1, 6.0, None, None, None)], EDGES)
    new = edits.bridges(n, e, spark.createDataFrame([("a", "b", 2), ("b", "c", None), ("a", "zz", 1), ("a", "b", 3)], "u string, v string, layer int"))
    assert sorted((x.u, x.v, x.key, x.length, x.layer, len(x.points)) for x in new.collect()) == [("a", "b", 2, 5.0, 2, 2), ("a", "b", 3, 5.0, 3, 2), ("b", "a", 0, 5.0, 2, 2), ("b", "a", 1, 5.0, 3, 2), ("b", "c", 0, math.hypot(6, 4), 1, 2), ("c", "b", 0, math.hypot(6, 4), 1, 2)]
    ids = spark.createDataFrame([("a", "b", 4), ("a", "b", 9), ("b", "c", 2)], "u string, v string, edge_id long")
    routes = {1: "abc", 2: "ab", 3: "ba", 4: "a", 5: "abca", 6: "a?b"}
    r = spark.createDataFrame([(k, i, None if c == "?" else c) for k, s in routes.items() for i, c in enumerate(s)], "route_id long, pos int, node_id string")
    assert {x.route_id: x.edges for x in edits.edges_of_routes(r, ids).collect()} == {1: [9, 2], 2: [9], 3: [], 4: [], 5: [], 6: []}
