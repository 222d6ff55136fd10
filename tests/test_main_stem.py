import random

import pytest
from pyspark.sql import functions as F

from cityweave.operators import grids

FLOW, ACC = "row int, col int, to_row int, to_col int", "row int, col int, accumulation double"


def walk(flow, acc, least, share=0.005, outlets=None):
    at = min((x for x in acc if outlets is None or x in outlets), key=lambda x: (-acc[x], x), default=None)
    out, bound = [], max(least, share * acc[at]) if at else 0
    while at is not None:
        out.append(at)
        up = [(-acc[x], x) for x, to in flow.items() if to == at and acc[x] > bound]
        at = min(up)[1] if up else None
    return out


def tables(spark, flow, acc):
    rows = [(*x, *(to or (None, None))) for x, to in flow.items()]
    return spark.createDataFrame(rows, FLOW), spark.createDataFrame([(*x, float(n)) for x, n in acc.items()], ACC)


def stem(*args, **kw):
    return [(x.row, x.col) for x in grids.main_stem(*args, **kw).orderBy("pos").collect()]


@pytest.mark.parametrize("length", [1, 2, 7, 8, 9])
def test_ways_of_any_length(spark, length):
    flow = {(k, 0): (k - 1, 0) if k else None for k in range(length)}
    f, a = tables(spark, flow, {(k, 0): length - k for k in range(length)})
    assert stem(f, a, least=0) == [(k, 0) for k in range(length)]
    assert stem(f, a, least=3) == [(k, 0) for k in range(length) if k == 0 or length - k > 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_forests_with_ties(spark, seed):
    r = random.Random(seed)
    cells = [(k // 10, k % 10) for k in range(60)]
    flow = {x: cells[r.randrange(max(0, k - 6), k)] if k % 17 else None for k, x in enumerate(cells)}
    acc = dict.fromkeys(cells, 1)
    for x in reversed(cells):
        if flow[x]:
            acc[flow[x]] += acc[x]
    f, a = tables(spark, flow, acc)
    inner = {x for x in cells if 2 <= x[1] <= 7}
    assert stem(f, a, least=1) == walk(flow, acc, 1)
    assert stem(f, a, least=0, share=0.2, outlets=spark.createDataFrame(sorted(inner) * 2, "row int, col int")) == walk(flow, acc, 0, 0.2, inner)


def test_no_outlet(spark):
    f, a = tables(spark, {(0, 0): None}, {(0, 0): 1})
    assert stem(f.where("row < 0"), a.where("row < 0")) == [] == stem(f, a, outlets=a.where(F.lit(False)))
