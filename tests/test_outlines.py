"""Rings of masks: closed, as large as the cells they hold, one a region and a hole."""

import random

import pytest

from cityweave.operators import outlines


def regions(cells):
    left, out = set(cells), []
    while left:
        stack, mine = [left.pop()], set()
        while stack:
            r, c = stack.pop()
            mine.add((r, c))
            for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        out.append(mine)
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.5), (2, 0.75), (3, 0.2)])
def test_rings_hold_their_regions(spark, seed, share):
    r = random.Random(seed)
    cells = {(i, j) for i in range(14) for j in range(12) if r.random() < share} | {(30, j) for j in range(40)}
    found = outlines.rings(spark.createDataFrame(sorted(cells) * 2, "row long, col long"))
    rows = found.collect()
    by = {}
    for x in rows:
        by.setdefault(x.ring, []).append(x)
    area, owner = {}, {}
    for ring, part in by.items():
        part.sort(key=lambda x: x.pos)
        assert [x.pos for x in part] == list(range(len(part))) and part[0].id == ring
        twice = 0
        for a, b in zip(part, part[1:] + part[:1]):
            assert abs(a.x - b.x) + abs(a.y - b.y) == 1  # the next corner is one side away
            twice += a.x * b.y - b.x * a.y
        area[ring], owner[ring] = twice / 2, (part[0].row, part[0].col)
    for mine in regions(cells):
        own = [k for k in by if owner[k] in mine]
        assert sum(area[k] for k in own) == len(mine)
        assert sum(area[k] > 0 for k in own) == 1  # one outer ring, the others go round holes
    assert {x.ring: (x.corners, x.area) for x in outlines.measured(found).collect()} == {k: (len(v), area[k]) for k, v in by.items()}
    line = outlines.longest(found, 10).orderBy("pos").collect()
    most = max(by, key=lambda k: (len(by[k]), -k))
    assert [(x.ring, x.pos) for x in line] == [(most, p) for p in range(0, len(by[most]), 10)]


def test_no_cells(spark):
    assert outlines.rings(spark.createDataFrame([], "row long, col long")).count() == 0


def test_estimates_of_long_rings_stay_small(spark, monkeypatch):
    sizes = []

    def noted(df, put=outlines.rewritten):
        out = put(df)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(outlines, "rewritten", noted)
    found = outlines.rings(spark.createDataFrame([(0, j) for j in range(40)], "row long, col long"))
    assert found.count() == 82 and max(sizes) < 10**6
