"""Steps whose work must grow no faster than their input."""

import random

import numpy as np

from cityweave.operators import metrics, survey, transit


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gravity_shuffles_no_pairs(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (2, 3.0, 4.0), (3, None, 1.0)], "origin long, x double, y double")
    z = spark.createDataFrame([(7, 0.0, 0.0, 2.0), (8, 3.0, 4.0, 1.0), (9, 3.0, 4.0, 1.0)], "zone long, px double, py double, attraction double")
    p = transit.gravity(o, z, 0.1)
    plan = executed(p)
    assert plan.index("NestedLoopJoin") < plan.index("Exchange")  # the last thing done is to meet the zones
    e = 2.718281828459045**-0.5
    s1, s2 = 2 + 2 * e, 2 + 2 * e + 2 * e + 2
    want = [(1, 7, 2 / s1), (1, 8, e / s1), (1, 9, e / s1), (2, 7, 2 / s2), (2, 7, 2 * e / s2), (2, 8, e / s2), (2, 8, 1 / s2), (2, 9, e / s2), (2, 9, 1 / s2), (3, 7, 1 / 3), (3, 8, 1 / 3), (3, 9, 1 / 3)]
    assert sorted((r.origin, r.zone, round(r.p, 9)) for r in p.collect()) == sorted((a, b, round(c, 9)) for a, b, c in want)


def test_gravity_works_out_shares_by_place(spark):
    o = spark.createDataFrame([(i, 0.0, 0.0) for i in range(70)] + [(70, 3.0, 4.0), (None, 3.0, 4.0)], "origin long, x double, y double")
    z = spark.createDataFrame([(i, 0.0, 0.0, 2.0) for i in range(1100)] + [(1100, 0.0, 0.0, 1.0), (None, 3.0, 4.0, 1.0), (1102, None, 0.0, 1.0)], "zone long, px double, py double, attraction double")
    p = transit.gravity(o, z, 0.1, 6)
    plan = executed(p)
    assert plan.index("Generate explode") < plan.index("EXP(")  # the last thing done is to copy shares to pairs
    assert plan.index("EXP(") < plan.index("Coalesce ") < plan.index("NestedLoopJoin")  # and no task holds an origin's pairs
    e = 2.718281828459045**-0.5
    want = []
    for i in [*range(71), None]:
        home, far = (e, 1) if i in (70, None) else (1, e)
        s = 2201 * home + far
        want += [(i, k, round(2 * home / s, 6)) for k in range(1100)] + [(i, 1100, round(home / s, 6)), (i, None, round(far / s, 6)), (i, 1102, None)]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(map(tuple, p.collect()), key=key) == sorted(want, key=key)


def test_nearest_source_looks_back_only(spark):
    r = random.Random(5)
    cells = [(i, j, r.random() < 0.8, j != 4 and j < 9 and r.random() < 0.05) for i in range(40) for j in range(12)]
    df = spark.createDataFrame(cells, "row long, col long, t boolean, s boolean")
    found = survey.nearest_source(df, df.t, df.s)
    assert "unboundedfollowing" not in executed(found)  # such a frame is summed anew for every row
    sources = [(i, j) for i, j, _, s in cells if s]
    want = sorted((i, j, *min(((i - a) ** 2 + (j - b) ** 2, a, b) for a, b in sources)) for i, j, t, _ in cells if t)
    assert sorted((x.row, x.col, x.d2, x.src_row, x.src_col) for x in found.collect()) == want
    assert survey.nearest_source(df, df.t, df.row < 0).count() == 0


def test_distribution_holds_no_group_in_a_task(spark):
    r = random.Random(3)
    data = [(g, None if r.random() < 0.1 else float(r.randrange(n))) for g, n in (("a", 7), ("b", 1000), (None, 50)) for _ in range(301)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    for by in (["g"], []):
        found = metrics.distribution(df, "v", by)
        assert "percentile(" not in executed(found)
        got = {x["g"] if by else "all": x for x in found.collect()}
        for g in {x[0] for x in data} if by else {"all"}:
            v = [b for a, b in data if b is not None and (not by or a == g)]
            want = [len(v), *((np.mean(v), np.percentile(v, 50), np.percentile(v, 95), max(v), sum(v)) if v else [0.0] * 5)]
            assert np.allclose([got[g][c] for c in ("n", "mean", "p50", "p95", "max", "total")], want, atol=1e-12), g


def test_prefixes_keep_numbers_not_texts(spark, monkeypatch):
    keys = spark.createDataFrame([("1",), ("12",), ("1234",), ("9",), (None,)], "key string")
    ids = spark.createDataFrame([("12345",), ("129",), ("1",), ("1",), ("77",), ("",), (None,)], "rid string")
    want = sorted([("12345", "1234"), ("129", "12"), ("1", "1"), ("1", "1")])
    for few in (10, 0):
        monkeypatch.setattr(metrics, "FEW_KEYS", few, raising=False)
        found = metrics.prefix_match(ids, keys, "rid", "key")
        assert "SortAggregate" not in executed(found)
        assert sorted((r.rid, r.key) for r in found.collect()) == want


def test_storms_share_files(spark, tmp_path, monkeypatch):
    from test_catalogue import DATA

    from cityweave.operators import records
    from cityweave.plans import registry

    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet").count()
    monkeypatch.setattr(records, "own_folder", lambda *_: str(tmp_path))
    assert registry.QUERIES["text_series"](spark, DATA).where("kind = 'storm'").count() == 2 * suppliers
    assert len(list(tmp_path.glob("storms/**/*.txt"))) + len(list(tmp_path.glob("storms/**/*.json"))) <= suppliers // 1000 + 1
