"""Work on a whole grid of any size, tile by tile, with what crosses the tiles' borders settled as a small graph.

A grid is a table of (row, col, layers); cells that the table lacks are outside. A task holds one tile of `size` x `size`
cells and a margin of one cell. Results don't depend on the tiling.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.grids import RING
from cityweave.operators.network import components as graph_components
from cityweave.session import checkpointed

SIZE = 256
#: The node of all that lies outside the grid, in the graph of spill heights.
OUTSIDE = -(2**63)
_BASE, _ZERO = 2**32, 2**31


def cell_key(row: Column, col: Column) -> Column:
    """One long for a cell, in reading order."""
    return row * F.lit(_BASE) + col + F.lit(_ZERO)


def _row_col(key: Column) -> tuple[Column, Column]:
    row = F.shiftright(key, 32)
    return row, key - row * F.lit(_BASE) - F.lit(_ZERO)


def with_margin(cells: DataFrame, size: int) -> DataFrame:
    """The cells of each tile (tr, tc) and those around it, which are not its own."""
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / size) for d in (-1, 0, 1))))
    x = cells.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))
    return x.withColumn("own", (F.col("tr") == F.floor(F.col("row") / size)) & (F.col("tc") == F.floor(F.col("col") / size)))


def per_tile(cells: DataFrame, size: int, kernel: Callable[[dict[str, np.ndarray], int, int], pd.DataFrame], schema: str, only: DataFrame | None = None) -> DataFrame:
    """kernel(layers, row0, col0) of each tile (of those in `only`: tr, tc); layers are arrays of size + 2, NaN outside, `own` and `here` say which cells are
    the tile's and which exist at all. row0, col0 is the cell at index 0, 0, a cell before the tile's first."""
    names = [c for c in cells.columns if c not in ("row", "col")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(key[0]) * size - 1, int(key[1]) * size - 1
        at = (pdf["row"].to_numpy() - row0, pdf["col"].to_numpy() - col0)
        layers = {"own": np.zeros((size + 2, size + 2), bool), "here": np.zeros((size + 2, size + 2), bool)}
        layers["own"][at], layers["here"][at] = pdf["own"].to_numpy(), True
        for c in names:
            layers[c] = np.full((size + 2, size + 2), np.nan)
            layers[c][at] = pdf[c].to_numpy(float)
        return kernel(layers, row0, col0)

    x = with_margin(cells, size)
    if only is not None:
        x = x.join(only.hint("shuffle_hash"), ["tr", "tc"], "left_semi")
    return x.groupBy("tr", "tc").applyInPandas(one, schema)


def regions(mask: np.ndarray, value: np.ndarray, diagonal: bool) -> np.ndarray:
    """Numbers of the connected cells of equal value, by runs: the index of a region's first cell in reading order, -1 outside."""
    rows, cols = mask.shape
    wide = cols + 3  # runs of one row never meet those of another
    starts = mask.copy()
    starts[:, 1:] &= ~mask[:, :-1] | (value[:, 1:] != value[:, :-1])
    run = np.cumsum(starts.ravel()).reshape(mask.shape) - 1
    r, c = np.nonzero(starts)
    if not len(r):
        return np.full(mask.shape, -1, np.int64)
    end = c + np.bincount(run[mask], minlength=len(r))
    reach = 1 if diagonal else 0
    lo = np.searchsorted(r * wide + end, (r + 1) * wide + c - reach, "right")
    hi = np.searchsorted(r * wide + c, (r + 1) * wide + end + reach, "left")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(r)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    same = value[r[a], c[a]] == value[r[b], c[b]]
    a, b, parent = a[same], b[same], np.arange(len(r))
    while True:
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        new = new[new]
        if (new == parent).all():
            break
        parent = new
    out = np.full(mask.shape, -1, np.int64)
    out[mask] = (r * cols + c)[parent[run[mask]]]
    return out


def across(border: DataFrame, size: int, offsets: list[tuple[int, int]], columns: list[str]) -> DataFrame:
    """Pairs of border cells of different tiles at the offsets: the columns of both, the second's with a 2 at the end."""
    tile = lambda c: F.floor(F.col(c) / size)
    near = F.explode(F.array(*(F.struct((F.col("row") + i).alias("r2"), (F.col("col") + j).alias("c2")) for i, j in offsets)))
    x = border.withColumn("n", near).select("*", "n.*").where((tile("r2") != tile("row")) | (tile("c2") != tile("col")))
    y = border.select(F.col("row").alias("r2"), F.col("col").alias("c2"), *(F.col(c).alias(f"{c}2") for c in columns))
    return x.join(y, ["r2", "c2"]).select(*columns, *(f"{c}2" for c in columns))


def _border(size: int) -> Column:
    edge = lambda c: F.pmod(F.col(c), F.lit(size)).isin(0, size - 1)
    return edge("row") | edge("col")


def components(cells: DataFrame, value: Column | None = None, size: int = SIZE, diagonal: bool = False) -> DataFrame:
    """row, col, region_row, region_col: the connected cells (of equal value) and the first cell of their region in reading order.

    Regions of a tile are found by runs; regions that meet at a border form a graph whose components join them. Columns fit
    31 bits. An empty table gives an empty one."""
    x = cells.select("row", "col", (F.lit(0) if value is None else value).cast("double").alias("value"))

    def kernel(layers: dict[str, np.ndarray], row0: int, col0: int) -> pd.DataFrame:
        mask = layers["own"]
        label = regions(mask, np.nan_to_num(layers["value"]), diagonal)[mask]
        r, c = np.nonzero(mask)
        lr, lc = np.divmod(label, mask.shape[1])
        return pd.DataFrame({"row": r + row0, "col": c + col0, "value": layers["value"][mask], "label": (lr + row0) * _BASE + lc + col0 + _ZERO})

    local = checkpointed(per_tile(x, size, kernel, "row long, col long, value double, label long"))
    offsets = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    met = across(local.where(_border(size)), size, offsets, ["value", "label"]).where("value = value2")
    whole = graph_components(met.select(F.col("label").alias("u"), F.col("label2").alias("v")).distinct()).select(F.col("node_id").alias("label"), "component")
    row, col = _row_col(F.col("region"))
    out = local.join(whole, "label", "left").withColumn("region", F.coalesce("component", "label"))
    return out.select("row", "col", row.alias("region_row"), col.alias("region_col"))


def largest(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Size of the largest region, of those found by components()."""
    keys = by or []
    return found.groupBy(*keys, "region_row", "region_col").count().groupBy(*keys).agg(F.max("count").alias("largest"))


def _flood(layers: dict[str, np.ndarray], row0: int, col0: int) -> pd.DataFrame:
    """A tile flooded from its border and the grid's rim, lowest first: heights, basins, and the heights at which basins spill."""
    z, own, here = layers["z"], layers["own"], layers["here"]
    side = z.shape[1]
    rim = own.copy()
    rim[1:-1, 1:-1] &= ~np.logical_and.reduce([here[1 + i : side - 1 + i, 1 + j : side - 1 + j] for i, j in RING])
    edge = own.copy()
    edge[2:-2, 2:-2] = False
    height, mine, open_ = z.ravel().copy(), own.ravel(), rim.ravel()
    label, done = np.full(z.size, -1, np.int64), np.zeros(z.size, bool)
    heap = [(height[k], int(k)) for k in np.flatnonzero((rim | edge).ravel())]
    heapq.heapify(heap)
    spills: dict[tuple[int, int], float] = {}
    steps = [i * side + j for i, j in RING]
    while heap:
        h, k = heapq.heappop(heap)
        if done[k]:
            continue
        done[k] = True
        if label[k] < 0:
            label[k] = k
        me = int(label[k])
        if open_[k]:
            spills[me, -1] = min(spills.get((me, -1), h), h)
        for s in steps:
            n = k + s
            if not mine[n]:
                continue
            if label[n] < 0:
                label[n], height[n] = me, max(height[n], h)
                heapq.heappush(heap, (height[n], n))
            elif label[n] != me:
                pair, over = (min(me, int(label[n])), max(me, int(label[n]))), max(h, height[n])
                spills[pair] = min(spills.get(pair, over), over)
    key = lambda k: (k // side + row0) * _BASE + k % side + col0 + _ZERO
    at = np.flatnonzero(mine)
    cells = pd.DataFrame({"row": at // side + row0, "col": at % side + col0, "z": height[at], "a": key(label[at]), "b": 0, "edge": False})
    pairs = pd.DataFrame([(0, 0, h, key(a), OUTSIDE if b < 0 else key(b), True) for (a, b), h in spills.items()], columns=list(cells.columns))
    return pd.concat([cells, pairs]) if len(pairs) else cells


def spill_levels(edges: DataFrame) -> DataFrame:
    """node, level: the lowest height at which each node's water reaches OUTSIDE over edges (a, b, z).

    Every node takes its lowest edge; nodes that so hang together become one, and the next round joins those by the lowest
    edges left, so rounds are the logarithm of the nodes. From a node the chosen edges only fall, hence its level is the
    larger of its own edge and of the level of the node it became part of."""
    live, rounds = checkpointed(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("z").alias("z"))), []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "z")).where(F.col("a") != OUTSIDE)
        chosen = both.groupBy("a").agg(F.min(F.struct("z", "b")).alias("e")).select(F.col("a").alias("node"), "e.z", F.col("e.b").alias("to"))
        chosen = checkpointed(chosen)
        part = graph_components(chosen.select(F.col("node").alias("u"), F.col("to").alias("v"))).select(F.col("node_id").alias("node"), "component")
        rounds.append(chosen.join(part, "node").select("node", "z", "component"))
        other = lambda c, p=part: p.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
        # OUTSIDE chooses nothing, so it may be in no component yet
        joined = live.join(other("a"), "a", "left").join(other("b"), "b", "left").select(F.coalesce("a_", "a").alias("a2"), F.coalesce("b_", "b").alias("b2"), "z").where("a2 <> b2")
        live = checkpointed(joined.groupBy(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).agg(F.min("z").alias("z")))
    level = edges.sparkSession.createDataFrame([], "node long, level double")
    for chosen in reversed(rounds):
        above = level.select(F.col("node").alias("component"), "level")
        level = checkpointed(chosen.join(above, "component", "left").select("node", F.greatest("z", "level").alias("level")))
    return level


def filled(cells: DataFrame, layer: str = "dem", drain: Column | None = None, size: int = SIZE) -> DataFrame:
    """row, col, layer: every cell at least as high as the lowest way out, of eight directions.

    Ways out are cells beside a missing one and, where given, drains, which keep their height. Each tile is flooded on its own;
    the basins of all tiles, the heights at which they spill into each other and those at the borders form a graph, whose
    levels raise the tiles' cells in a second pass."""
    ground = cells if drain is None else cells.where(~F.coalesce(drain, F.lit(False)))
    found = checkpointed(per_tile(ground.select("row", "col", F.col(layer).cast("double").alias("z")), size, _flood, "row long, col long, z double, a long, b long, edge boolean"))
    inner, spills = found.where(~F.col("edge")), found.where("edge").select("a", "b", "z")
    met = across(inner.where(_border(size)), size, [(0, 1), (1, 0), (1, 1), (1, -1)], ["a", "z"]).select("a", F.col("a2").alias("b"), F.greatest("z", "z2").alias("z"))
    levels = spill_levels(spills.unionByName(met)).select(F.col("node").alias("a"), "level")
    out = inner.join(levels, "a", "left").select("row", "col", F.greatest("z", "level").alias(layer))
    return out if drain is None else out.unionByName(cells.where(F.coalesce(drain, F.lit(False))).select("row", "col", F.col(layer).cast("double").alias(layer)))


def filled_sloping(cells: DataFrame, layer: str = "dem", slope: float = 1e-3, size: int = SIZE) -> DataFrame:
    """row, col, layer: filled so that the way out falls by `slope` a cell.

    Heights come in over the tiles' margins and spread within a tile, lowest first; only tiles whose margin got lower are
    worked again. Rounds are as many as borders that the longest way out crosses."""
    x = cells.select("row", "col", F.col(layer).cast("double").alias("z"))

    def kernel(layers: dict[str, np.ndarray], row0: int, col0: int) -> pd.DataFrame:
        z, own, here = layers["z"], layers["own"], layers["here"]
        side = z.shape[1]
        w = np.where(here, layers["w"], np.inf)
        news = (layers["news"] == 1) & here
        fresh = np.isinf(w[own]).all()
        best, mine, ground = w.ravel().copy(), own.ravel(), z.ravel()
        if fresh:
            rim = own.copy()
            rim[1:-1, 1:-1] &= ~np.logical_and.reduce([here[1 + i : side - 1 + i, 1 + j : side - 1 + j] for i, j in RING])
            best[rim.ravel()] = ground[rim.ravel()]
            news = news | rim
        heap = [(best[k], int(k)) for k in np.flatnonzero(news.ravel()) if np.isfinite(best[k])]
        heapq.heapify(heap)
        steps = [i * side + j for i, j in RING]
        while heap:
            h, k = heapq.heappop(heap)
            if h > best[k]:
                continue
            row, col = divmod(k, side)
            for s, (i, j) in zip(steps, RING):
                n = k + s
                if not (0 <= row + i < side and 0 <= col + j < side) or not mine[n]:
                    continue
                through = max(ground[n], h + slope)
                if through < best[n]:
                    best[n] = through
                    heapq.heappush(heap, (through, n))
        at = np.flatnonzero(mine)
        return pd.DataFrame({"row": at // side + row0, "col": at % side + col0, "z": ground[at], "w": best[at], "news": (best[at] < w.ravel()[at]).astype(float)})

    schema = "row long, col long, z double, w double, news double"
    state = checkpointed(per_tile(x.withColumn("w", F.lit(float("inf"))).withColumn("news", F.lit(0.0)), size, kernel, schema))
    while True:
        told = checkpointed(with_margin(state.where("news = 1").where(_border(size)), size).where(~F.col("own")).select("tr", "tc").distinct())
        if told.isEmpty():
            return state.select("row", "col", F.col("w").alias(layer))
        own = state.withColumn("tr", F.floor(F.col("row") / size)).withColumn("tc", F.floor(F.col("col") / size))
        calm = own.join(told.hint("shuffle_hash"), ["tr", "tc"], "left_anti").select("row", "col", "z", "w", F.lit(0.0).alias("news"))
        state = checkpointed(calm.unionByName(per_tile(state, size, kernel, schema, told)))


def pits_capped(cells: DataFrame, layer: str = "dem", level: float = 0.0, reach: int = 5, least_ring: int = 20, depth: float = 3.0, most_depth: float = 0.0, size: int = SIZE) -> DataFrame:
    """cells with layer and `pit`: enclosed ground below the level gets one floor.

    Regions of cells below the level (eight directions): the largest, of equals the first in reading order, is the sea. Of
    each other the ring of dry cells within `reach` cells says how deep it lies: ring's lower quartile less the region's
    median. Regions whose ring has fewer than `least_ring` cells, or that are less deep than `depth`, stay; the others get
    their median as floor, but not more than `most_depth` (if positive) below the ring."""
    below = cells.where(F.col(layer) < level)
    found = checkpointed(components(below.select("row", "col"), size=size, diagonal=True))
    region = ["region_row", "region_col"]
    sea = found.groupBy(*region).count().agg(F.min(F.struct((-F.col("count")).alias("n"), *region)).alias("x")).select("x.region_row", "x.region_col")
    pits = found.join(F.broadcast(sea), region, "left_anti")
    ring = pits
    for axis in ("row", "col"):
        ring = ring.withColumn(axis, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach))).distinct()
    z = F.col(layer)
    dry = ring.join(cells.where(z >= level).select("row", "col", z.alias("z")), ["row", "col"]).groupBy(*region).agg(F.count("*").alias("n"), F.percentile("z", 0.25).alias("ring"))
    floors = pits.join(cells.select("row", "col", z.alias("z")), ["row", "col"]).groupBy(*region).agg(F.percentile("z", 0.5).alias("floor"))
    capped = F.greatest("floor", F.col("ring") - most_depth) if most_depth > 0 else F.col("floor")
    chosen = floors.join(dry, region).where((F.col("n") >= least_ring) & (F.col("ring") - F.col("floor") >= depth)).select(*region, capped.alias("_floor"))
    new = pits.join(chosen, region).select("row", "col", "_floor")
    return cells.join(new, ["row", "col"], "left").withColumn(layer, F.coalesce("_floor", z)).withColumn("pit", F.col("_floor").isNotNull()).drop("_floor")
