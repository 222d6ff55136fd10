"""Land cover of an ortho image over surveyed ground: thresholds from the data, then the last rule that holds.

Cells are (row, col, red, green, blue, ground, relief, building, water, valid), colours from 0 to 255, the grid from 0 on. The
driver sees two histograms of 256 bins, one mean, one percentile and the grid's extent; the percentile comes from ranks over
ranges, not from one task. Null flags count as false, cells without a colour or ground as invalid; without cells to learn from
a threshold has its default. Cells that the table lacks count in no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.grids import otsu
from cityweave.operators.numbering import numbered
from cityweave.operators.sharpness import window_sums
from cityweave.session import checkpointed

#: Ranges of the thresholds and what they are without data; the colour sum of a lit cell; soil's saturation.
EXG, ROUGH, BRIGHT = (0.03, 0.15, 0.03), (0.02, 1.5, 0.08), (0.25, 0.75, 0.45)
LIT, SOIL_SATURATION, ROUGH_PERCENTILE = 30, 0.12, 0.82


def percentile_at(df: DataFrame, value: str, share: float) -> float | None:
    """A percentile between its two ranks, without nulls."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(value), value, name="_n")
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    lo = int(at)
    two = {r["_n"]: r[value] for r in ranked.where(F.col("_n").isin(lo, min(lo + 1, n - 1))).collect()}
    return two[lo] + (at - lo) * (two[min(lo + 1, n - 1)] - two[lo])


def _held(value: float | None, bounds: tuple[float, float, float]) -> float:
    return bounds[2] if value is None else min(max(value, bounds[0]), bounds[1])


def halo(cells: DataFrame, hit: Column, by: int) -> DataFrame:
    """row, col of all cells within `by` steps along rows and columns of a hit."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-by, by + 1) for j in range(abs(i) - by, by - abs(i) + 1)]
    x = cells.where(hit).select("row", "col", F.explode(F.array(*steps)).alias("s"))
    return x.select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col")).distinct()


def roughness(cells: DataFrame, value: str, size: int) -> DataFrame:
    """row, col, rough: standard deviation in the size x size window, mirrored at the grid's rims."""
    ends = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    v = F.col(value)
    parts = cells.select("row", "col", F.lit(1.0).alias("one"), v.alias("v"), (v * v).alias("vv"))
    sums = window_sums(parts, ["one", "v", "vv"], size, int(ends.r or 0) + 1, int(ends.c or 0) + 1)
    mean = F.col("v") / F.col("one")
    return sums.select("row", "col", F.sqrt(F.greatest(F.lit(0.0), F.col("vv") / F.col("one") - mean * mean)).alias("rough"))


def classified(cells: DataFrame, window: int = 3, canopy_relief: float = 2.0, shrub_relief: float = 0.3) -> DataFrame:
    """row, col, cover: building, water, canopy, grass, shrub, soil, gravel, concrete or paved (also where not valid)."""
    r, g, b = (F.col(c).cast("double") for c in ("red", "green", "blue"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    s, top, low = r + g + b, F.greatest(r, g, b), F.least(r, g, b)
    valid = flag("valid") & s.isNotNull() & F.col("ground").isNotNull()
    x = cells.select("row", "col", valid.alias("valid"), flag("building").alias("building"), flag("water").alias("water"), F.col("ground").cast("double").alias("ground"), F.coalesce(F.col("relief").cast("double"), F.lit(0.0)).alias("relief"),
                     (s > LIT).alias("lit"), ((2 * g - r - b) / (s + 1e-6)).alias("exg"), ((top - low) / F.greatest(top, F.lit(1.0)) > SOIL_SATURATION).alias("vivid"), ((r > g) & (g > b)).alias("earthy"), (s / 3 / 255).alias("bright"))
    x = checkpointed(x)
    mean = x.where("valid").agg(F.avg("ground")).first()[0] or 0.0
    rough = roughness(x.select("row", "col", F.when(F.col("valid"), F.col("ground")).otherwise(mean).alias("z")), "z", window)
    near = halo(x, F.col("building"), 2).withColumn("near", F.lit(True))
    green = _held(otsu(x.where("valid AND lit"), "exg"), EXG)
    x = x.join(rough, ["row", "col"]).join(near, ["row", "col"], "left").withColumn("far", F.col("valid") & F.col("near").isNull())
    x = x.withColumn("veg", F.col("valid") & (F.col("exg") > green))
    x = x.withColumn("bare", F.col("valid") & ~F.col("veg") & ~F.col("building") & ~F.col("water"))
    x = checkpointed(x.withColumn("earth", F.col("bare") & F.col("vivid") & F.col("earthy")))
    bumpy = _held(percentile_at(x.where("far AND lit"), "rough", ROUGH_PERCENTILE), ROUGH)
    light = _held(otsu(x.where("bare AND NOT earth AND lit"), "bright"), BRIGHT)
    textured, veg = F.col("far") & (F.col("rough") > bumpy), F.col("veg")
    cover = (
        F.when(~F.col("valid"), "paved").when(F.col("building"), "building").when(F.col("water"), "water").when(veg & (F.col("relief") > canopy_relief), "canopy")
        .when(veg & (F.col("relief") > shrub_relief), "shrub").when(veg, "grass").when(textured, "gravel").when(F.col("earth"), "soil").when(F.col("bright") > light, "concrete").otherwise("paved")
    )
    return x.select("row", "col", cover.alias("cover"))
