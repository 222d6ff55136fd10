"""Blurred margins of an aerial image: blocks with little detail that hang together with the image's outline.

Pixels are a table of (row, col, red, green, blue), from row and column 0 on; pixels that it lacks are outside the image. Work
grows with the pixels: detail is one aggregation over neighbours, window means are two passes along the axes, regions are
found tile by tile. The driver sees the grid's extent and one median.

Defined cases: a pixel with a null colour is outside; repeated pixels count once, the least colours win; with fewer than
`LEAST_BLOCKS` blocks inside, or none that is blurred, nothing is marked; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators import grids, tiles
from cityweave.session import checkpointed

#: Share of the image's median detail, share of a window that must be measured, blocks an image needs.
DETAIL_SHARE, LEAST_MEASURED, LEAST_BLOCKS = 0.35, 0.2, 16
#: Fixed values of the colour rule for open water: blue over red by so much, and the saturation.
BLUE_OVER_RED, SATURATION = 10, 0.3


def window_sums(cells: DataFrame, layers: list[str], size: int, rows: int, cols: int) -> DataFrame:
    """row, col, layers summed over the size x size window of every cell that has one; the grid (from 0 on) is mirrored at its rims.

    A window of even size reaches one further back than forward. Missing cells count as 0."""
    back, ahead = size // 2, size - size // 2 - 1
    out = cells.select("row", "col", *layers)
    for axis, n in (("row", rows), ("col", cols)):
        at, reach = F.col(axis), range(-(size // (2 * n)) - 1, size // (2 * n) + 2)
        copies = F.array(*(at + 2 * n * m for m in reach), *(F.lit(2 * n * m - 1) - at for m in reach))
        seen = F.explode(F.filter(copies, lambda e: (e >= -back) & (e < n + ahead))).alias("_e")  # noqa: B023
        x = out.select("row", "col", *layers, seen)
        x = x.withColumn(axis, F.explode(F.sequence(F.greatest(F.col("_e") - ahead, F.lit(0)), F.least(F.col("_e") + back, F.lit(n - 1)))))
        out = x.groupBy("row", "col").agg(*(F.sum(c).alias(c) for c in layers))
    return out


def detail(pixels: DataFrame, clear: int) -> DataFrame:
    """row, col, lap: the colour sum's absolute Laplacian of pixels whose square of `clear` pixels around lies in the image."""
    tone = pixels.select("row", "col", (F.col("red") + F.col("green") + F.col("blue")).alias("tone"), F.lit(1).alias("one"))
    near = grids.shifted(tone, "tone", [(-1, 0), (1, 0), (0, -1), (0, 1)])
    lap = F.abs(F.col("n_0") + F.col("n_1") + F.col("n_2") + F.col("n_3") - 4 * F.col("tone"))
    whole = grids.box_sum(tone, "one", clear).where(F.col("one_box") == (2 * clear + 1) ** 2).select("row", "col")
    return near.select("row", "col", lap.alias("lap")).join(whole, ["row", "col"])


def opened(cells: DataFrame, hit: Column) -> DataFrame:
    """row, col of the cells in a 3 x 3 square that the hits fill."""
    x = cells.select("row", "col", hit.cast("int").alias("hit"))
    core = grids.box_sum(x, "hit", 1).where("hit_box = 9").select("row", "col")
    return grown(core, 1)


def grown(cells: DataFrame, by: int) -> DataFrame:
    """row, col of all cells within `by` rows and columns."""
    for axis in ("row", "col"):
        cells = cells.withColumn(axis, F.explode(F.sequence(F.col(axis) - by, F.col(axis) + by))).distinct()
    return cells


def blurred_blocks(pixels: DataFrame, res: float, block: int = 4, window_m: float = 10.0, least_island_m2: float = 400.0, size: int = tiles.SIZE) -> DataFrame:
    """row, col of the blocks of block x block pixels (of `res` metres) that are blurred up to the image's outline.

    A block is low if its window's mean detail is under a share of the median block's and it isn't water. Of the connected low
    blocks those that reach the outline's margin go, with two blocks around; what is then cut off in small islands goes too."""
    colours = ["red", "green", "blue"]
    whole = pixels.where(" AND ".join(f"{c} IS NOT NULL" for c in colours)).groupBy("row", "col").agg(F.min(F.struct(*colours)).alias("c")).select("row", "col", "c.*")
    whole = checkpointed(whole)
    ends = pixels.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    none = whole.select("row", "col").limit(0)
    if ends.r is None:
        return none
    rows, cols = int(ends.r) // block + 1, int(ends.c) // block + 1
    in_block = [F.floor(F.col(c) / block).alias(c) for c in ("row", "col")]
    fine = detail(whole, max(1, int(1.0 / res))).groupBy(*in_block).agg(F.sum("lap").alias("lap"), F.count("*").alias("measured"))
    span = max(3, round(window_m / (res * block)))
    means = window_sums(fine, ["lap", "measured"], span, rows, cols)
    sharp = F.when(F.col("measured") > LEAST_MEASURED * (block * span) ** 2, F.col("lap") / (3 * F.col("measured")))
    blocks = whole.groupBy(*in_block).agg(F.count("*").alias("n"), *(F.sum(c).cast("double").alias(c) for c in colours))
    red, green, blue = ((F.col(c) / block**2) for c in colours)
    most, least = F.greatest(red, green, blue), F.least(red, green, blue)
    wet = (blue > red + BLUE_OVER_RED) & (green > red) & ((most - least) / F.greatest(most, F.lit(1.0)) > SATURATION)
    sea = opened(blocks, wet).withColumn("sea", F.lit(True))
    inside = blocks.where(F.col("n") * 2 > block**2).select("row", "col")
    inside = checkpointed(inside.join(means.select("row", "col", sharp.alias("sharp")), ["row", "col"], "left").join(sea, ["row", "col"], "left"))
    n, middle = inside.agg(F.count("*"), F.median("sharp")).first()
    if n < LEAST_BLOCKS or middle is None:
        return none
    low = inside.where((F.coalesce("sharp", F.lit(0.0)) < DETAIL_SHARE * middle) & F.col("sea").isNull()).select("row", "col")
    rim = max(1, int(window_m / 2 / (res * block)))
    clipped = lambda c, n: F.least(F.col(c) + rim, F.lit(n - 1)) - F.greatest(F.col(c) - rim, F.lit(0)) + 1
    margin = grids.box_sum(inside.select("row", "col", F.lit(1).alias("one")), "one", rim).where(F.col("one_box") < clipped("row", rows) * clipped("col", cols)).select("row", "col")
    region = ["region_row", "region_col"]
    found = checkpointed(tiles.components(low, size=size))
    bad = found.join(found.join(margin, ["row", "col"], "left_semi").select(*region).distinct(), region, "left_semi").select("row", "col")
    bad = checkpointed(grown(bad, 2).join(inside, ["row", "col"], "left_semi"))
    if bad.isEmpty():
        return bad
    rest = checkpointed(tiles.components(inside.join(bad, ["row", "col"], "left_anti"), size=size))
    small = rest.groupBy(*region).count().where(F.col("count") * (res * block) ** 2 < least_island_m2).select(*region)
    return bad.unionByName(rest.join(small, region, "left_semi").select("row", "col"))


def blurred(pixels: DataFrame, res: float, block: int = 4, window_m: float = 10.0, least_island_m2: float = 400.0, size: int = tiles.SIZE) -> DataFrame:
    """The pixels with `blurred`: whether their block is one of blurred_blocks()."""
    bad = blurred_blocks(pixels, res, block, window_m, least_island_m2, size)
    at = bad.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.lit(True).alias("_bad"))
    out = pixels.join(at, (F.floor(F.col("row") / block) == F.col("_r")) & (F.floor(F.col("col") / block) == F.col("_c")), "left")
    return out.withColumn("blurred", F.coalesce("_bad", F.lit(False))).drop("_r", "_c", "_bad")
