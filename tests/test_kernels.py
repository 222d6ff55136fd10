import numpy as np
from pyspark.sql import functions as F

from cityweave.operators import floodsim, routing, sightlines


def test_slope_drains_and_closes():
    dem = np.tile(np.arange(40)[::-1] * 0.04, (40, 1))
    r = floodsim.simulate(floodsim.Ground(dem, 2.0), [(0, 600, 60.0)], 900)
    assert abs(r.volumes["closure_rel"]) < 1e-9
    assert r.volumes["outflow"] > 0.3 * r.volumes["rain"]


def test_lake_stays_at_rest():
    dem = np.random.default_rng(1).random((30, 30)) * 0.5
    depth = np.maximum(1.0 - dem, 0)
    r = floodsim.simulate(floodsim.Ground(dem, 2.0), [], 300, initial=depth, closed=True)
    assert abs(r.depth.sum() - depth.sum()) / depth.sum() < 1e-9
    assert r.max_speed.max() < 0.05


def test_infiltration_takes_the_rain():
    flat = np.zeros((10, 10))
    for soak, left in ((72.0, 0.0), (18.0, 0.003)):
        r = floodsim.simulate(floodsim.Ground(flat, 2.0, infil_mmh=soak), [(0, 600, 36.0)], 600, closed=True)
        assert abs(r.depth.mean() - left) <= 1e-4 + 0.02 * left
    d = floodsim.simulate(floodsim.Ground(flat, 2.0, drains=[(5, 5, 0.01)]), [(0, 600, 36.0)], 600, closed=True, save_every=200)
    assert 0 < d.volumes["drained"] <= 6.0 and [t for t, _ in d.frames] == [200, 400, 600]


def test_runs_in_parallel(spark):
    rows = [(f"r{k}", r, c, 0.1 * c, 0.03, 0.0, "s") for k in range(3) for r in range(8) for c in range(8)]
    cells = spark.createDataFrame(rows, "run_id string, row int, col int, dem double, manning double, infil_mmh double, storm string")
    got = floodsim.run_all(cells, {"s": [(0, 60, 40.0)]}, 120, 2.0)
    assert got.count() == 192 and got.where("abs(closure_rel) > 1e-9").count() == 0 and got.agg(F.max("max_depth")).first()[0] > 0


def bow_tie(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)]
    return spark.createDataFrame([x for u, v in pairs for x in ((u, v, 10.0), (v, u, 10.0))], "u long, v long, length double")


def test_betweenness(spark):
    got = {(r.u, r.v): r.centrality for r in routing.betweenness(bow_tie(spark), "length").collect()}
    # by hand, per source-target pair: the two triangles meet in node 2
    assert abs(got[(2, 3)] - 3 / 20) < 1e-12 and abs(got[(0, 1)] - 1 / 20) < 1e-12
    assert got[(2, 3)] == got[(3, 2)] > got[(0, 1)] > 0 and len(got) == 12


def test_routes(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 3, 1.0), (0, 2, 1.5), (2, 3, 1.0), (1, 2, 0.1), (0, 1, 9.0)], "u long, v long, w double")
    pairs = spark.createDataFrame([(1, 0, 3), (2, 3, 0)], "pair_id long, origin long, destination long")
    got = routing.routes(e, pairs, "w", 5).orderBy("rank").collect()
    assert [(round(r.cost, 6), r.nodes) for r in got] == [(2.0, [0, 1, 3]), (2.1, [0, 1, 2, 3]), (2.5, [0, 2, 3])]
    assert routing.k_shortest(routing.adjacency([]), 0, 1, 0) == []


def test_shadows_and_lights(spark):
    v = "struct<x:double,y:double,z:double>"
    wall = [((5.0, -5.0, 0.0), (5.0, 5.0, 0.0), (5.0, 0.0, 10.0))]
    walls = spark.createDataFrame(wall, f"v0 {v}, v1 {v}, v2 {v}")
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.1, 2.0, 1.0), (2, 8.0, 0.0, 0.1, 1.0, 10.0)], "point_id long, x double, y double, z double, area double, weight double")
    got = {r.point_id: r.shadowed for r in sightlines.shadowed(pts, walls, (1.0, 0.0, 0.5)).collect()}
    assert got == {1: True, 2: False}
    assert all(r.shadowed for r in sightlines.shadowed(pts, walls, (0.0, 0.0, -1.0)).collect())
    assert sightlines.lit_share(pts.withColumn("g", F.lit(1)), sightlines.shadowed(pts, walls, (1.0, 0.0, 0.5)), "g", "area").first().lit == 1 / 3
    lights = spark.createDataFrame([(1, 9.0, 0.0, 4.0), (2, 9.5, 0.5, 4.0)], "light_id long, x double, y double, z double")
    cover = sightlines.light_coverage(pts, lights, walls, 12.0)
    assert {r.point_id: r.lights for r in cover.collect()} == {1: 0, 2: 2}
    assert abs(sightlines.coverage_cost(cover, pts).first().cost - (2.0 + 0.2)) < 1e-9


def test_upstream_and_main_stem(spark):
    from cityweave.operators import grids

    rows = [(r, c, 10.0 - c - (0.5 if r == 2 else 0.0) + abs(r - 2) * 0.1) for r in range(5) for c in range(8)]
    cells = spark.createDataFrame(rows, "row long, col long, dem double")
    flow = grids.receivers(cells).checkpoint()
    acc = grids.flow_accumulation(flow)
    top = acc.orderBy(F.desc("accumulation")).first()
    assert (top.row, top.col) == (2, 7)
    stem = [(r.row, r.col) for r in grids.main_stem(flow, acc, least=3).orderBy("pos").collect()]
    assert stem[0] == (2, 7) and all(c == 7 - k for k, (_, c) in enumerate(stem))
    to = {(r.row, r.col): (r.to_row, r.to_col) for r in flow.collect()}
    reach = set()
    for cell in to:
        at, seen = cell, [cell]
        while to[at][0] is not None:
            at = to[at]
            seen.append(at)
        if (2, 5) in seen:
            reach.add(cell)
    got = {(r.row, r.col) for r in grids.upstream(flow, spark.createDataFrame([(2, 5)], "row long, col long")).collect()}
    assert got == reach


def test_porous_cells_close_the_balance():
    """Water in half-open cells stands higher, nothing is lost, and speeds are those of the definition."""
    from cityweave.operators import floodsim as fs

    r = np.random.default_rng(4)
    dem = r.random((14, 17)).cumsum(1) / 5
    phi = np.where(r.random(dem.shape) < 0.3, 0.4, 1.0)
    g = fs.Ground(dem, 2.0, infil_mmh=3.0, open_share=phi, drains=[(5, 5, 0.02)])
    run = fs.simulate(g, [(0.0, 200.0, 80.0)], 400.0)
    assert abs(run.volumes["closure_rel"]) < 1e-9
    closed = fs.simulate(fs.Ground(np.zeros((6, 6)), 2.0, open_share=0.5), [(0.0, 100.0, 36.0)], 100.0, closed=True)
    assert np.allclose(closed.depth, 2 * 0.001) and abs(closed.volumes["closure_rel"]) < 1e-9
    qx, hx = r.normal(size=(3, 3)), np.where(r.random((3, 3)) < 0.3, 0, r.random((3, 3)) + 0.1)
    qy, hy = r.normal(size=(2, 4)), r.random((2, 4)) + 0.1
    depth = np.where(r.random((3, 4)) < 0.2, 0.005, 0.3)
    got = fs.cell_speed(qx, hx, qy, hy, depth)
    for i in range(3):
        for j in range(4):
            u = sum(qx[i, k] / hx[i, k] for k in (j - 1, j) if 0 <= k < 3 and hx[i, k] > 0) / 2
            w = sum(qy[k, j] / hy[k, j] for k in (i - 1, i) if 0 <= k < 2) / 2
            assert np.isclose(got[i, j], np.hypot(u, w) if depth[i, j] > 0.01 else 0)
