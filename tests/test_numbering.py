import random

from pyspark.sql import functions as F

from cityweave.operators import network, numbering, rasterize, survey


def test_numbers_and_sums_follow_the_order(spark):
    r = random.Random(1)
    rows = [(k, r.randint(0, 9)) for k in r.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k long, x long").repartition(5)
    got = {x.k: x.n for x in numbering.numbered(df, F.desc("k"), name="n", start=1).collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, reverse=True))}
    total, want = 0, {}
    for k, x in sorted(rows):
        total += x
        want[k] = total
    assert {x.k: x.x_sum for x in numbering.running_sum(df, "k", ["x"]).collect()} == want
    assert numbering.numbered(df.limit(0), "k").count() == 0


def test_paths_a_thousand_hops_deep(spark):
    n = 1000
    e = spark.createDataFrame([(k, k + 1, float(k % 7 + 1)) for k in range(n)] + [(n + 10, n + 11, 1.0)], "u long, v long, w double")
    source = spark.createDataFrame([(0,)], "node_id long")
    got = {x.node_id: x.cost for x in network.shortest_paths(e, source, "w").collect()}
    assert len(got) == n + 1 and got[n] == sum(k % 7 + 1 for k in range(n))


def test_frontier_equals_searches(spark):
    r = random.Random(2)
    rows = [(r.randrange(30), r.randrange(30), float(r.randint(1, 9))) for _ in range(70)] + [(100 + k, 101 + k, 1.0) for k in range(12)]
    e = spark.createDataFrame(rows, "u long, v long, w double")
    source = spark.createDataFrame([(0,), (5,), (100,)], "node_id long")
    one, two = (sorted(map(tuple, network.shortest_paths(e, source, "w", small=k).collect())) for k in (10**6, 0))
    assert one == two and any(c == 12 for s, _, c in one if s == 100)


def test_walks_touch_all_cells_on_the_way(spark):
    r = random.Random(3)
    rows = [(k, *(r.uniform(-9, 9) for _ in range(4))) for k in range(60)] + [(100, 1.0, 2.0, 1.0, 5.5), (101, -3.0, 0.0, 4.0, 0.0), (102, 2.5, 2.5, 2.5, 2.5)]
    df = spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")
    got = df.select("k", F.explode(rasterize.walk(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).alias("c")).select("k", "c.col", "c.row").collect()
    cells = {}
    for x in got:
        cells.setdefault(x.k, set()).add((x.col, x.row))
    for k, x1, y1, x2, y2 in rows:
        if k >= 100:
            continue
        on_way = {(int((x1 + t / 5000 * (x2 - x1)) // 1), int((y1 + t / 5000 * (y2 - y1)) // 1)) for t in range(5001)}
        assert on_way <= cells[k] and len(cells[k]) <= len(on_way) + 2
    assert cells[102] == {(2, 2)} and len(cells[100]) == 4


def test_budget_shift(spark):
    r = random.Random(4)
    values = [r.uniform(-2, 2) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for budget in (0.5, 60.0, 150.0):
        s = survey.budget_shift(df, "x", budget)
        assert abs(sum(min(max(x + s, 0), 1) for x in values) - budget) < 1e-9
