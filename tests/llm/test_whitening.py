import math

import numpy as np
import pytest

from cityweave.llm import whitening


def brute(rows, k=8):
    """Exact sums in whole numbers, eigenvectors of the full covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (d - len(v))]] for _, v in kept]
    n, sums = len(x), [sum(r[j] for r in x) for j in range(d)]
    c = np.array([[(n * v - s) / n for v, s in zip(r, sums)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {"n": n, "e": e, "share": e / (c * c).sum() * n, "w": c @ v / np.sqrt(e), "ids": [i for i, _ in kept], "dev": [sum((n * p - s) ** 2 for p, s in zip(r, sums)) for r in x]}


def collected(df):
    return sorted(map(tuple, df.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=lambda r: (str(r[0]), r[1]))


def check(got, want, k):
    assert len(got) == k * want["n"]
    by = {(r[0], r[1]): r for r in got}
    for c in range(k):
        mine = np.array([by[i, c + 1][4] for i in want["ids"]])
        assert min(np.abs(mine - s * want["w"][:, c]).max() for s in (1, -1)) < 1e-8
        for i, dev in zip(want["ids"], want["dev"]):
            row = by[i, c + 1]
            assert row[2:4] == (want["n"], dev) and abs(row[5] / want["share"][c] - 1) < 1e-9 and row[6] < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, component int").repartition(3)


@pytest.mark.parametrize("gap", [True, False])
def test_against_the_full_covariance(spark, gap):
    r = np.random.default_rng(1)
    scale = np.r_[np.linspace(9, 4, 8), np.full(32, 1e-9)] if gap else np.ones(40)
    turn = np.linalg.qr(r.standard_normal((40, 40)))[0]
    data = (np.round(r.standard_normal((400, 40)) * scale) @ np.round(turn * 2)) if gap else r.standard_normal((400, 40))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(data)]
    bad = [(900, None), (901, [None] + [0.0] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40)]
    df = vectors(spark, rows + bad)
    model = whitening.fit(whitening.usable(df, "embedding"), "embedding")
    assert model["expanded"] is not gap  # a gap behind the eighth component: the random columns suffice
    check(collected(whitening.whitened(df)), brute(rows + bad), 8)


def test_few_dimensions_short_vectors_repeats_and_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0]), (3, []), (4, [-1.0, 0.5, 9.0]), (5, [0.25, -0.125, 4.0]), (6, [1.0, 2.0, 3.0])]
    check(collected(whitening.whitened(vectors(spark, rows))), brute(rows), 3)
    twice = collected(whitening.whitened(vectors(spark, [*rows, (1, rows[0][1]), (None, rows[1][1])])))
    assert len(twice) == 24 and sum(r[0] is None for r in twice) == 3 and sum(r[0] == 1 for r in twice) == 6


def test_rank_and_size_limits(spark):
    line = [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)]
    assert {r[1] for r in collected(whitening.whitened(vectors(spark, line)))} == {1}
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        assert collected(whitening.whitened(vectors(spark, none))) == []
    with pytest.raises(ValueError):
        whitening.whitened(vectors(spark, [(1, [0.0] * (whitening.MOST_DIMENSIONS + 1))]))


def test_large_entries_stay_exact(spark):
    rows = [(k, [c, 1.0]) for k, c in enumerate([2.0**51, -(2.0**51), 3.0, 0.5])]
    got = collected(whitening.whitened(vectors(spark, [*rows, (9, [2.0**52, 0.0])])))
    assert {r[0]: r[3] for r in got} == {0: None, 1: None, 2: 8704**2, 3: 1536**2}  # null beyond a long
    rows = [(k, [2.0**12 * k, 1.0, -3.0 * k]) for k in range(20)]
    want = brute(rows)["dev"]
    assert [r[3] for r in collected(whitening.whitened(vectors(spark, rows))) if r[1] == 1] == [w for _, w in sorted(zip(map(str, range(20)), want))]


def test_sums_beyond_a_long():
    off = whitening.offsets(np.array([[2**61, 5]]), 8, [2**61, 40])
    assert off.dtype == object and off.tolist() == [[7 * 2**61, 0]]
    assert whitening.squared(np.array([[3, 4]])) == [25] and whitening.squared(np.array([[2**32, 0]], dtype=np.int64)) == [None]


def test_the_query_on_its_table(spark):
    from cityweave.llm import queries

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(collected(queries.QUERIES["op12_range_finder_whitening"](spark, folder)), brute(rows), 8)
