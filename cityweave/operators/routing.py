"""Routes over street graphs: one search for each source, pair or run. Small connected parts of a graph are dealt out with their
sources, so a task holds only its own; what is connected on a larger scale is broadcast after a size check."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.session import checkpointed

#: Edges up to which a graph is broadcast without a look at its components, and a component is searched by a single task.
PIECE = 2_000
#: Edges of small components that a task holds at once, about.
PART = 5_000
#: Edges (after collapsing parallels) that are broadcast; beyond, use network.shortest_paths, which joins instead.
MOST_EDGES = 2_000_000

Graph = dict[int, list[tuple[int, float]]]


def adjacency(rows: list[tuple[int, int, float]]) -> Graph:
    g: Graph = defaultdict(list)
    for u, v, w in rows:
        g[u].append((v, w))
    return dict(g)


def broadcast_graph(edges: DataFrame, weight: str, most: int = MOST_EDGES):
    e = edges.where(F.col(weight).isNotNull()).groupBy("u", "v").agg(F.min(weight).cast("double").alias("w"))
    rows = e.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} edges; use network.shortest_paths")
    return edges.sparkSession.sparkContext.broadcast(sorted((r.u, r.v, r.w) for r in rows))


def dijkstra(g: Graph, source: int, target: int | None = None, banned: frozenset = frozenset(), closed: frozenset = frozenset()) -> tuple[dict[int, float], dict[int, int]]:
    """(cost, predecessor) of the nodes reached; banned edges and closed nodes aren't used."""
    cost, before, done = {source: 0.0}, {}, set()
    heap = [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, w in g.get(u, ()):
            if v not in closed and (u, v) not in banned and (v not in cost or d + w < cost[v] - 1e-12):
                cost[v], before[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return cost, before


def path_to(before: dict[int, int], source: int, target: int) -> list[int] | None:
    out = [target]
    while out[-1] != source:
        if out[-1] not in before:
            return None
        out.append(before[out[-1]])
    return out[::-1]


def k_shortest(g: Graph, source: int, target: int, k: int) -> list[tuple[float, list[int]]]:
    """Up to k simple paths by cost (Yen's method)."""
    total = lambda p: sum(dict(g[a])[b] for a, b in zip(p, p[1:]))
    first = path_to(dijkstra(g, source, target)[1], source, target) if k > 0 else None
    if first is None:
        return []
    found, maybe = [(total(first), first)], []
    while len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = frozenset((p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1)
            spur = path_to(dijkstra(g, last[i], target, banned, frozenset(root[:-1]))[1], last[i], target)
            if spur:
                p = root[:-1] + spur
                item = (total(p), p)
                if item not in maybe and item not in found:
                    heapq.heappush(maybe, item)
        if not maybe:
            break
        found.append(heapq.heappop(maybe))
    return found


def pieces(edges: DataFrame, weight: str, piece: int = PIECE) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """(edges u, v, w, part of the components of at most `piece` edges, edges u, v, w of larger ones, node_id, part of all nodes:
    null for larger ones). A graph of at most `piece` edges isn't divided: it has no parts."""
    from cityweave.operators.network import components

    e = checkpointed(edges.where(F.col(weight).isNotNull()).groupBy("u", "v").agg(F.min(weight).cast("double").alias("w")))
    n = e.count()
    if n <= piece:
        return None, e, None
    of = components(e)
    sizes = e.join(of, e.u == of.node_id).groupBy("component").agg(F.count("*").alias("_n"))
    part = F.when(F.col("_n") <= piece, F.pmod(F.xxhash64("component"), F.lit(n // PART + 1)))
    nodes = checkpointed(of.join(sizes, "component").select("node_id", part.alias("part")))
    e = checkpointed(e.join(nodes.withColumnRenamed("node_id", "u"), "u").select("u", "v", "w", "part"))
    return e.where("part IS NOT NULL"), e.where("part IS NULL").drop("part"), nodes


def _tuples(pdf: pd.DataFrame) -> list[tuple]:
    return sorted(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["w"].tolist()))


def routes(edges: DataFrame, pairs: DataFrame, weight: str, k: int = 1, piece: int = PIECE) -> DataFrame:
    """pair_id, rank, cost, nodes of up to k routes for (pair_id, origin, destination); pairs without a route give no row."""
    names, kind = ["pair_id", "rank", "cost", "nodes"], "pair_id long, rank int, cost double, nodes array<long>"
    p = pairs.select("pair_id", "origin", "destination")

    def found(g: Graph, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(p, r, c, nodes) for p, o, d in zip(*(pdf[c].tolist() for c in ("pair_id", "origin", "destination"))) for r, (c, nodes) in enumerate(k_shortest(g, o, d, k))]
        return pd.DataFrame(out, columns=names)

    def over_all(p: DataFrame, e: DataFrame) -> DataFrame:
        held = broadcast_graph(e, "w")

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = adjacency(held.value)
            for pdf in frames:
                yield found(g, pdf)

        return p.mapInPandas(each, kind)

    small, large, nodes = pieces(edges, weight, piece)
    if small is None:
        return over_all(p, large)
    at = p.join(nodes.select(F.col("node_id").alias("origin"), "part", F.lit(True).alias("_known")), "origin", "left")
    mine = at.where("part IS NOT NULL OR _known IS NULL").select("pair_id", "origin", "destination", F.coalesce("part", F.lit(0)).alias("part"))
    out = small.groupBy("part").cogroup(mine.groupBy("part")).applyInPandas(lambda e, p: found(adjacency(_tuples(e)), p), kind)
    return out if large.isEmpty() else out.unionByName(over_all(at.where("part IS NULL AND _known").select(*p.columns), large))


def _loads(g: Graph, sources: list[int], load: dict[tuple[int, int], float]) -> None:
    """Adds the shares of the shortest paths from sources to the load of each edge (Brandes' method)."""
    for s in sources:
        cost, paths, before, order, done = {s: 0.0}, {s: 1.0}, defaultdict(list), [], set()
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w in g.get(u, ()):
                n = d + w
                if v not in cost or n < cost[v] - 1e-9:
                    cost[v], paths[v], before[v] = n, paths[u], [u]
                    heapq.heappush(heap, (n, v))
                elif abs(n - cost[v]) <= 1e-9 and v not in done:
                    paths[v] += paths[u]
                    before[v].append(u)
        carry = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                c = paths[u] / paths[v] * (1 + carry[v])
                load[(u, v)] += c
                carry[u] += c


def betweenness(edges: DataFrame, weight: str, normalized: bool = True, piece: int = PIECE) -> DataFrame:
    """u, v, centrality: share of shortest paths over each edge; both directions get the larger of the two.

    Sources are spread over tasks, partial sums are added up; the result has a row for each edge at most.
    """
    kind = "u long, v long, c double"
    frame = lambda load: pd.DataFrame([(u, v, c) for (u, v), c in load.items()], columns=["u", "v", "c"])

    def over_all(nodes: DataFrame, e: DataFrame) -> DataFrame:
        held = broadcast_graph(e, "w")

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, load = adjacency(held.value), defaultdict(float)
            for pdf in frames:
                _loads(g, pdf["node"].tolist(), load)
            yield frame(load)

        return nodes.mapInPandas(each, kind)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        load: dict[tuple[int, int], float] = defaultdict(float)
        _loads(adjacency(_tuples(pdf)), sorted(set(pdf["u"].tolist())), load)
        return frame(load)

    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    n = nodes.count()
    scale = 1.0 / (n * (n - 1)) if normalized and n > 1 else 1.0
    small, large, parts = pieces(edges, weight, piece)
    if small is None:
        load = over_all(nodes, large)
    else:
        load = small.select("part", "u", "v", "w").groupBy("part").applyInPandas(within, kind)
        if not large.isEmpty():
            load = load.unionByName(over_all(parts.where("part IS NULL").select(F.col("node_id").alias("node")), large))
    load = load.groupBy("u", "v").agg((F.sum("c") * scale).alias("c"))
    one = edges.select("u", "v").distinct().join(load, ["u", "v"], "left").fillna(0.0, ["c"])  # edges on no shortest path have 0
    pair = one.withColumn("_a", F.least("u", "v")).withColumn("_b", F.greatest("u", "v"))
    top = pair.groupBy("_a", "_b").agg(F.max("c").alias("centrality"))
    return pair.join(top, ["_a", "_b"]).select("u", "v", "centrality")
