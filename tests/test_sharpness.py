"""Blurred margins against the same rules on whole arrays."""

import random
from statistics import median

import pytest

from cityweave.operators import sharpness

SCHEMA = "row long, col long, red int, green int, blue int"


def label(cells):
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


def square(r, c, k):
    return [(r + i, c + j) for i in range(-k, k + 1) for j in range(-k, k + 1)]


def brute(px, top, res, b, window, island):
    """px: (row, col) -> colours; blocks by the rules, with dictionaries over the padded grid."""
    rows, cols = top[0] // b + 1, top[1] // b + 1
    tone = {p: sum(c) for p, c in px.items()}
    clear = max(1, int(1 / res))
    lap, cov = {}, {}
    for (r, c), t in tone.items():
        if all(q in px for q in square(r, c, clear)):
            at = (r // b, c // b)
            lap[at] = lap.get(at, 0) + abs(tone[r - 1, c] + tone[r + 1, c] + tone[r, c - 1] + tone[r, c + 1] - 4 * t)
            cov[at] = cov.get(at, 0) + 1
    k = max(3, round(window / (res * b)))
    back = lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    inside, sharp, wet = set(), {}, set()
    for r in range(rows):
        for c in range(cols):
            own = [px[q] for q in ((r * b + i, c * b + j) for i in range(b) for j in range(b)) if q in px]
            if 2 * len(own) > b * b:
                inside.add((r, c))
            near = [(back(r + i, rows), back(c + j, cols)) for i in range(-(k // 2), k - k // 2) for j in range(-(k // 2), k - k // 2)]
            seen = sum(cov.get(q, 0) for q in near)
            if seen > 0.2 * (b * k) ** 2:
                sharp[r, c] = sum(lap.get(q, 0) for q in near) / 3 / seen
            m = [sum(x[i] for x in own) / b / b for i in range(3)]
            if m[2] > m[0] + 10 and m[1] > m[0] and (max(m) - min(m)) / max(max(m), 1) > 0.3:
                wet.add((r, c))
    known = [sharp[q] for q in inside if q in sharp]
    if len(inside) < 16 or not known:
        return set()
    core = {q for q in wet if all(n in wet for n in square(*q, 1))}
    sea = {n for q in core for n in square(*q, 1)}
    low = {q for q in inside - sea if sharp.get(q, 0) < 0.35 * median(known)}
    reach = max(1, int(window / 2 / (res * b)))
    margin = {q for q in inside if any(0 <= r < rows and 0 <= c < cols and (r, c) not in inside for r, c in square(*q, reach))}
    bad = {n for m in label(low) if m & margin for q in m for n in square(*q, 2)} & inside
    if bad:
        bad |= {q for m in label(inside - bad) if len(m) * (res * b) ** 2 < island for q in m}
    return bad


@pytest.mark.parametrize("seed,res,block,window", [(1, 1.0, 2, 6.0), (2, 0.5, 2, 4.0), (3, 1.0, 3, 9.0)])
def test_blocks_as_by_whole_arrays(spark, seed, res, block, window):
    r = random.Random(seed)
    px = {}
    for i in range(45):
        for j in range(50):
            if j + i % 30 < 7 or r.random() < 0.02 or (i > 40 and j > 30):
                continue
            flat = j < 16 or (20 < i < 30 and 25 < j < 40)
            px[i, j] = (80, 120, 200) if i < 12 and 30 < j < 48 else (90, 91, 92) if flat and r.random() < 0.97 else tuple(r.randrange(200) for _ in range(3))
    px[44, 49] = (1, 2, 3)
    want = brute(px, (44, 49), res, block, window, 40.0)
    rows = [(*p, *c) for p, c in px.items()]
    df = spark.createDataFrame(rows + rows[:50] + [(3, 3, None, 1, 1)], SCHEMA)
    for size in (5, 256):  # whatever the tiling
        assert {tuple(x) for x in sharpness.blurred_blocks(df, res, block, window, 40.0, size).collect()} == want
    assert want
    marked = sharpness.blurred(df.limit(10_000), res, block, window, 40.0).where("blurred").select("row", "col").distinct().collect()
    assert {tuple(x) for x in marked} == {p for p in [*px, (3, 3)] if (p[0] // block, p[1] // block) in want}


def test_small_and_empty_images(spark):
    for rows in ([], [(0, 0, 1, 1, 1)], [(i, j, 5, 5, 5) for i in range(3) for j in range(3)]):
        assert sharpness.blurred_blocks(spark.createDataFrame(rows, SCHEMA), 1.0).count() == 0
