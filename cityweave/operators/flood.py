"""Flood studies: key figures, comparisons, storms, water budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.raster import hazard, intensity, percent_change
from cityweave.operators.metrics import correlation


def summary(cells: DataFrame, res: float = 2.0, threshold: float = 0.10, by: list[str] | None = None, mask: Column | None = None) -> DataFrame:
    """Flooded and deep area, depths, volume, hazard of cells (depth, speed); empty sets give 0."""
    c = cells if mask is None else cells.where(mask)
    d, ha = F.col("depth"), res * res / 1e4
    h = hazard(d, F.col("speed"))
    n = lambda k: F.coalesce(F.sum(k.cast("long")), F.lit(0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.groupBy(*(by or [])).agg(
        (n(d > threshold) * ha).alias("flooded_ha"), (n(d > 0.30) * ha).alias("deep_ha"), zero(F.max(d)).alias("max_depth_m"), zero(F.avg(F.when(d > threshold, d))).alias("mean_depth_m"),
        zero(F.sum(d) * (res * res)).alias("volume_m3"), zero(F.max(h)).alias("peak_hazard"), (n(h > 0.75) * ha).alias("hazardous_ha"), zero(F.percentile(F.when(d > threshold, d), F.lit(0.99))).alias("p99_depth_m"),
    )


def flooded_area(cells: DataFrame, by: list[str], res: float, threshold: float) -> DataFrame:
    return cells.groupBy(*by).agg((F.sum((F.col("depth") > threshold).cast("long")) * (res * res)).alias("flooded_m2"))


def reduction(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """before, after and the reduction in percent; a before of 0 gives 0."""
    j = before.select(*by, F.col(value).alias("before")).join(after.select(*by, F.col(value).alias("after")), by)
    return j.withColumn("reduction_pct", F.coalesce(-percent_change(F.col("before"), F.col("after")), F.lit(0.0)))


def agreement(a: DataFrame, b: DataFrame, wet: float = 0.10, either: float = 0.02) -> DataFrame:
    """IoU, correlation, RMSE and bias of two depth grids on (row, col), and a verdict."""
    j = a.select("row", "col", F.col("depth").alias("a")).join(b.select("row", "col", F.col("depth").alias("b")), ["row", "col"])
    x, y = F.col("a"), F.col("b")
    both, any_ = (x > wet) & (y > wet), (x > wet) | (y > wet)
    u = (x > either) | (y > either)
    m = j.agg(
        F.try_divide(F.sum(both.cast("double")), F.greatest(F.sum(any_.cast("double")), F.lit(1.0))).alias("iou"), correlation(F.when(u, x), F.when(u, y)).alias("depth_r"),
        F.sqrt(F.avg(F.when(u, (y - x) * (y - x)))).alias("rmse_m"), F.avg(F.when(u, y - x)).alias("bias_m"), F.sum(u.cast("long")).alias("wet_cells"),
    )
    return m.withColumn("verdict", F.when((F.col("iou") >= 0.7) & (F.col("depth_r") >= 0.8), "AGREE").when(F.col("iou") >= 0.5, "PARTIAL").otherwise("DIVERGE"))


def design_storm(spark, years: int, minutes: int = 60, block: int = 5) -> DataFrame:
    """Alternating blocks: position, t0, t1, mmh. The largest increment stands in the middle, the next alternate round it."""
    n = minutes // block
    b = spark.range(1, n + 1).select(F.col("id").alias("k"), (intensity(F.col("id") * block, years) * F.col("id") * block / 60.0).alias("depth"))
    w = Window.orderBy("k")
    inc = b.withColumn("inc", F.col("depth") - F.lag("depth", 1, 0.0).over(w)).withColumn("rank", F.col("k") - 1)
    mid = n // 2
    # ranks fall to the left and right of the middle in turn, until one side is full
    left, right, order = mid - 1, mid + 1, [mid]
    while len(order) < n:
        if left >= 0:
            order.append(left)
            left -= 1
        if right < n and len(order) < n:
            order.append(right)
            right += 1
    at = F.get(F.array(*(F.lit(p) for p in order)), F.col("rank"))
    return inc.withColumn("position", at).select("position", (F.col("position") * block * 60).alias("t0"), ((F.col("position") + 1) * block * 60).alias("t1"), F.round(F.col("inc") / (block / 60.0), 2).alias("mmh"), F.col("inc").alias("depth_mm"))


def rates(series: DataFrame, by: list[str], t: str, volume: str) -> DataFrame:
    """Change of volume over time between saved steps."""
    w = Window.partitionBy(*by).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    return series.withColumn("rate", F.try_divide(F.col(volume) - F.lag(volume).over(w), dt))


def settled(series: DataFrame, by: list[str], t: str, value: str, back: int = 5, share: float = 0.01) -> DataFrame:
    """Whether the last value is within a share of that `back` steps earlier; with fewer steps it isn't."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(t), F.desc(value)))
    s = series.withColumn("_k", k).where(F.col("_k") <= back + 1).groupBy(*by).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("_last"), F.max(F.when(F.col("_k") == back + 1, F.col(value))).alias("_old"))
    last, old = F.col("_last"), F.col("_old")
    return s.select(*by, F.coalesce(F.try_divide(old - last, last) < share, F.lit(False)).alias("settled"))


def trapezoid(series: DataFrame, by: list[str], t: str, rate: str) -> DataFrame:
    """Integral of a rate over time, and its last value."""
    w = Window.partitionBy(*by).orderBy(t)
    s = series.withColumn("_a", (F.col(t) - F.lag(t).over(w)) * (F.col(rate) + F.lag(rate).over(w)) / 2)
    return s.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"), F.max_by(rate, t).alias("last"))


def running_maxima(frames: DataFrame, t: str = "t") -> DataFrame:
    """Per cell the largest depth and hazard up to each frame."""
    w = Window.partitionBy("row", "col").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("max_depth", F.max("depth").over(w)).withColumn("max_hazard", F.max(hazard(F.col("depth"), F.col("speed"))).over(w))


def block_coverage(cells: DataFrame, by: list[str], ring: Column) -> DataFrame:
    """Share of a building's ring cells deeper than 0.10 and 0.30, and whether it counts as affected (0.20 of them)."""
    d = cells.where(ring)
    share = lambda x: F.avg((F.col("depth") > x).cast("double"))
    return d.groupBy(*by).agg(share(0.10).alias("wet"), share(0.30).alias("deep")).withColumn("affected", F.col("wet") >= 0.20)


def soft_flooded(cells: DataFrame, res: float, weight: str, threshold: float = 0.05, width: float = 0.01) -> DataFrame:
    """Smooth count of flooded street area: sum of sigmoid((d - threshold) / width) * weight * cell area."""
    s = 1 / (1 + F.exp(-F.least(F.greatest((F.col("depth") - threshold) / width, F.lit(-50.0)), F.lit(50.0))))
    return cells.agg(F.sum(s * F.col(weight) * (res * res)).alias("soft_m2"))


def run_quality(cells: DataFrame, closure: float, by: list[str] | None = None, fill: str = "fill_depth", steep: Column | None = None) -> DataFrame:
    """Checks of a run: depth percentiles of wet cells, cells over their fill bound, speeds off cliffs, and a verdict with its reasons."""
    d, wet = F.col("depth"), F.when(F.col("depth") > 0.10, F.col("depth"))
    off = F.when(~steep, F.col("speed")) if steep is not None else F.col("speed")
    q = cells.groupBy(*(by or [])).agg(
        *(F.coalesce(F.percentile(wet, F.lit(p)), F.lit(0.0)).alias(f"p{round(p * 100)}_depth") for p in (0.5, 0.9, 0.99)),
        F.count_if(d > F.col(fill) + 0.01).alias("over_fill"), F.count_if(d > 3.0).alias("very_deep"), F.coalesce(F.percentile(off, F.lit(0.999)), F.lit(0.0)).alias("p999_speed"), F.count("*").alias("n"),
    )
    why = F.array_compact(F.array(F.when(F.lit(abs(closure) > 1e-3), "closure"), F.when(F.col("over_fill") > 0.01 * F.col("n"), "fill"), F.when(F.col("p999_speed") > 5.0, "speed")))
    return q.withColumn("reasons", F.concat_ws(",", why)).withColumn("verdict", F.when(F.size(why) == 0, "PASS").otherwise("WARN"))


def section_check(section: DataFrame, band: DataFrame, slack: float = 0.02, wet: float = 0.15) -> DataFrame:
    """One row: points of a cross-section (x, depth) within a published band (x, low, high), and the last wet x."""
    j = section.join(band, "x", "left")
    inside = F.col("depth").between(F.col("low") - slack, F.col("high") + slack)
    return j.agg(F.count_if(inside).alias("inside"), F.count_if(F.col("low").isNotNull()).alias("points"), F.max(F.when(F.col("depth") >= wet, F.col("x"))).alias("front_x"))


def resolution_table(runs: DataFrame, by: str) -> DataFrame:
    """Per resolution: flooded area before and after, the reduction, and the 99th percentile of speed before."""
    area = lambda s: F.sum(F.when((F.col("state") == s) & (F.col("depth") > 0.05), F.col(by) * F.col(by)).otherwise(0.0))
    t = runs.groupBy(by).agg(area("before").alias("before_m2"), area("after").alias("after_m2"), F.percentile(F.when(F.col("state") == "before", F.col("speed")), F.lit(0.99)).alias("p99_speed"))
    return t.withColumn("reduction_pct", F.coalesce(-percent_change(F.col("before_m2"), F.col("after_m2")), F.lit(0.0)))


def preset_table(runs: DataFrame, preset: str, position: str, value: str) -> DataFrame:
    """Rows with the difference of a value from the first preset's."""
    first = runs.agg(F.min_by(value, position).alias("_first"))
    return runs.crossJoin(F.broadcast(first)).withColumn("delta", F.col(value) - F.col("_first")).drop("_first")
