"""Whole-grid operators: any tiling gives what one piece gives."""

import heapq
import random

import numpy as np
import pytest

from cityweave.operators import tiles

RING = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def grid(spark, cells):
    return spark.createDataFrame([(r, c, float(z)) for (r, c), z in cells.items()], "row long, col long, dem double")


def got(df, layer="dem"):
    return {(r.row, r.col): r[layer] for r in df.collect()}


def lowest_way_out(cells, slope=0.0, drains=()):
    best = {k: z for k, z in cells.items() if k not in drains and any((k[0] + i, k[1] + j) not in cells or (k[0] + i, k[1] + j) in drains for i, j in RING)}
    heap = [(z, k) for k, z in best.items()]
    heapq.heapify(heap)
    while heap:
        h, (r, c) = heapq.heappop(heap)
        if h > best[r, c]:
            continue
        for i, j in RING:
            n = (r + i, c + j)
            if n in cells and n not in drains and max(cells[n], h + slope) < best.get(n, float("inf")):
                best[n] = max(cells[n], h + slope)
                heapq.heappush(heap, (best[n], n))
    return best | {k: cells[k] for k in drains}


def rough(seed, rows, cols, holes=0.03, levels=9):
    r = random.Random(seed)
    return {(i - 3, j - 2): r.randrange(levels) + (30 if 5 < i < rows - 4 and j in (6, cols - 5) else 0) for i in range(rows) for j in range(cols) if r.random() > holes}


@pytest.mark.parametrize("size", [3, 5, 64])
def test_depressions_under_any_tiling(spark, size):
    cells = rough(1, 30, 26)
    assert got(tiles.filled(grid(spark, cells), size=size)) == lowest_way_out(cells)


def test_drains_and_bowls_over_many_tiles(spark):
    from pyspark.sql import functions as F

    cells = {(i, j): max(abs(i - 10), abs(j - 10)) for i in range(21) for j in range(21)}
    assert set(got(tiles.filled(grid(spark, cells), size=4)).values()) == {10.0}
    df = grid(spark, cells)
    assert got(tiles.filled(df, drain=(F.col("row") == 10) & (F.col("col") == 10), size=4)) == lowest_way_out(cells, drains={(10, 10)}) == cells
    assert got(tiles.filled(df.limit(0), size=4)) == {}


@pytest.mark.parametrize("size", [4, 64])
def test_sloping_fill_under_any_tiling(spark, size):
    cells = rough(2, 18, 15, levels=3)
    want = lowest_way_out(cells, 0.125)
    assert got(tiles.filled_sloping(grid(spark, cells), slope=0.125, size=size)) == want


def flood_regions(cells, diagonal):
    steps = RING if diagonal else [(-1, 0), (1, 0), (0, -1), (0, 1)]
    out = {}
    for k in sorted(cells):
        if k not in out:
            out[k], stack = k, [k]
            while stack:
                r, c = stack.pop()
                for i, j in steps:
                    n = (r + i, c + j)
                    if n in cells and n not in out and cells[n] == cells[k]:
                        out[n] = k
                        stack.append(n)
    return out


@pytest.mark.parametrize("size,diagonal", [(3, False), (4, True), (64, True)])
def test_regions_under_any_tiling(spark, size, diagonal):
    from pyspark.sql import functions as F

    cells = rough(3, 24, 20, holes=0.45, levels=2)
    snake = {(i, 40 + j): 0 for i in range(0, 12, 2) for j in range(12)} | {(i, 40 + (11 if i % 4 == 1 else 0)): 0 for i in range(1, 11, 2)}
    cells |= snake
    found = tiles.components(grid(spark, cells), F.col("dem"), size=size, diagonal=diagonal)
    assert {(r.row, r.col): (r.region_row, r.region_col) for r in found.collect()} == flood_regions(cells, diagonal)
    one = flood_regions(dict.fromkeys(cells, 0), diagonal)
    sizes = [list(one.values()).count(k) for k in set(one.values())]
    assert tiles.largest(tiles.components(grid(spark, cells), size=size, diagonal=diagonal)).first().largest == max(sizes)


def test_pits(spark):
    cells = {(i, j): 6.0 for i in range(40) for j in range(40)}
    cells |= {(i, j): -1.0 for i in range(40) for j in range(8)}  # the sea
    cells |= {(i, j): -4.0 - (i + j) % 3 for i in range(12, 18) for j in range(20, 27)}  # deep
    cells |= {(30, 30): -0.5, (31, 31): -0.25}  # not deep
    kept = {k: z for k, z in cells.items() if not (28 <= k[0] <= 33 and 28 <= k[1] <= 33) or k in ((30, 30), (31, 31))} | {(r, c): 0.5 for r in range(28, 34) for c in range(28, 34) if (r, c) not in ((30, 30), (31, 31))}
    df = grid(spark, kept)
    for size in (7, 64):
        rows = tiles.pits_capped(df, depth=7.0, most_depth=10.5, reach=2, size=size).collect()
        assert {(r.row, r.col) for r in rows if r.pit} == {(i, j) for i in range(12, 18) for j in range(20, 27)}
        assert {r.dem for r in rows if r.pit} == {max(float(np.median([kept[i, j] for i in range(12, 18) for j in range(20, 27)])), 6.0 - 10.5)}
        assert all(r.dem == kept[r.row, r.col] for r in rows if not r.pit)


def test_sloping_fill_works_only_told_tiles_again(spark, monkeypatch):
    worked, per_tile = [], tiles.per_tile

    def counted(*a):
        worked.append(a[4].count() if len(a) > 4 else 25)
        return per_tile(*a)

    monkeypatch.setattr(tiles, "per_tile", counted)
    cells = rough(2, 18, 15, levels=3)
    assert got(tiles.filled_sloping(grid(spark, cells), slope=0.125, size=4)) == lowest_way_out(cells, 0.125)
    assert len(worked) > 2 and worked[-1] < 12
