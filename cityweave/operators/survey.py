"""Surveyed rasters: terrain under buildings, cleared lots, roofs, and footprints registered against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.session import checkpointed


def nearest_source(cells: DataFrame, target: Column, source: Column) -> DataFrame:
    """row, col, src_row, src_col, d2 of each target cell: its nearest source cell (of equals the first by row, then col).

    Two passes: within its column every cell knows the nearest source above and below; then the columns of a target's row
    compete, but only those no farther than the source of the target's own column, if that has one. So rows made grow with
    targets times the distance to sources, and both windows run forwards, in time linear in the cells."""
    known = Window.partitionBy("col").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(source, F.col("row")), True)
    x = cells.select("row", "col", target.alias("_t"), own.over(known.orderBy("row")).alias("_a"), own.over(known.orderBy(F.desc("row"))).alias("_b"))
    nearer = F.when(F.col("_b").isNull() | (F.col("row") - F.col("_a") <= F.col("_b") - F.col("row")), F.col("_a")).otherwise(F.col("_b"))
    x = x.select("row", "col", "_t", F.coalesce(nearer, "_b").alias("src_row"))
    there = x.where("src_row IS NOT NULL").select("row", F.col("col").alias("src_col"), "src_row")
    d2 = ((F.col("row") - F.col("src_row")) * (F.col("row") - F.col("src_row")) + (F.col("col") - F.col("src_col")) * (F.col("col") - F.col("src_col"))).alias("d2")
    ends = there.agg(F.min("src_col").alias("_lo"), F.max("src_col").alias("_hi"))
    reach = F.abs(F.col("row") - F.col("src_row"))
    lo, hi = F.greatest(F.coalesce(F.col("col") - reach, "_lo"), "_lo"), F.least(F.coalesce(F.col("col") + reach, "_hi"), "_hi")
    seek = x.where("_t").crossJoin(F.broadcast(ends)).where("_lo IS NOT NULL").select("row", "col", F.explode(F.sequence(lo, hi)).alias("src_col"))
    best = seek.join(there.hint("merge"), ["row", "src_col"]).groupBy("row", "col").agg(F.min(F.struct(d2, "src_row", "src_col")).alias("m"))
    return best.select("row", "col", "m.src_row", "m.src_col", "m.d2")


def coarse_terrain(cells: DataFrame, factor: int, wall_share: float = 0.5) -> DataFrame:
    """Blocks of cells (dem, building, manning, infil, rain): row, col, blocked, dem, manning, infil, rain.

    A block of at least wall_share buildings is a wall as high as its highest building; others take the mean of their ground.
    Roughness and infiltration are means of the open part. Rain on walls goes to the nearest open block, so none is lost."""
    b, g = F.col("building"), ~F.col("building")
    block = cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(
        F.avg(b.cast("int")).alias("_share"), F.avg(F.when(g, F.col("dem"))).alias("_ground"), F.max(F.when(b, F.col("dem"))).alias("_wall"),
        F.avg(F.when(g, F.col("manning"))).alias("_n"), F.avg(F.when(g, F.col("infil"))).alias("_i"), F.avg("rain").alias("rain"),
    )
    shut = (F.col("_share") >= wall_share) & F.col("_wall").isNotNull()
    block = block.select("row", "col", shut.alias("blocked"), F.when(shut, F.col("_wall")).otherwise(F.coalesce("_ground", "_wall")).alias("dem"), F.when(shut, F.lit(0.05)).otherwise(F.col("_n")).alias("manning"), F.when(shut, F.lit(0.0)).otherwise(F.col("_i")).alias("infil"), "rain")
    moved = nearest_source(block, F.col("blocked"), ~F.col("blocked")).join(block.select("row", "col", "rain"), ["row", "col"])
    moved = moved.groupBy(F.col("src_row").alias("row"), F.col("src_col").alias("col")).agg(F.sum("rain").alias("_more"))
    rain = F.when(F.col("blocked"), F.lit(0.0)).otherwise(F.col("rain") + F.coalesce("_more", F.lit(0.0)))
    return block.join(moved, ["row", "col"], "left").withColumn("rain", rain).drop("_more")


def cleared(cells: DataFrame, lot: Column, ground: Column, layer: str = "dem") -> DataFrame:
    """row, col, layer: lots take the height of their nearest ground cell, never more than their own."""
    fill = nearest_source(cells, lot, ground).join(cells.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), F.col(layer).alias("_z")), ["src_row", "src_col"]).select("row", "col", "_z")
    return cells.join(fill, ["row", "col"], "left").withColumn(layer, F.least(F.col(layer), F.coalesce("_z", layer))).drop("_z")


def graded(cells: DataFrame, lot: Column, support: Column, radius: int, layer: str = "dem", rounds: int = 12) -> DataFrame:
    """Lots take the mean of the supporting cells in the window round them, round by round; all else stays."""
    from cityweave.operators.grids import box_sum

    out = cells.withColumn("_lot", lot).withColumn("_sup", support.cast("double"))
    n = box_sum(out.select("row", "col", "_sup"), "_sup", radius).select("row", "col", F.col("_sup_box").alias("_n"))
    out = checkpointed(out.join(n, ["row", "col"]))
    for _ in range(rounds):
        s = box_sum(out.select("row", "col", (F.col("_sup") * F.col(layer)).alias("_seen")), "_seen", radius).select("row", "col", "_seen_box")
        out = out.join(s, ["row", "col"]).withColumn(layer, F.when(F.col("_lot") & (F.col("_n") > 0), F.col("_seen_box") / F.col("_n")).otherwise(F.col(layer))).drop("_seen_box")
        out = checkpointed(out)
    return out.drop("_lot", "_sup", "_n")


def box_extreme(cells: DataFrame, layer: str, radius: int, how: str) -> DataFrame:
    """row, col, layer: the least or greatest (how: min, max) in the window round each cell, over the cells that exist."""
    pick, out, here = {"min": F.min, "max": F.max}[how], cells.select("row", "col", layer), cells.select("row", "col")
    for axis in ("row", "col"):
        x = out.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, F.col(axis) + F.col("_d"))
        out = x.groupBy("row", "col").agg(pick(layer).alias(layer))
    return out.join(here, ["row", "col"], "left_semi")


def top_hat(cells: DataFrame, layer: str, radius: int) -> DataFrame:
    """row, col, rise: height over the opening of the surface (what stands out and is narrower than the window)."""
    opened = box_extreme(box_extreme(cells, layer, radius, "min"), layer, radius, "max").withColumnRenamed(layer, "_open")
    return cells.join(opened, ["row", "col"]).select("row", "col", (F.col(layer) - F.col("_open")).alias("rise"))


def shift_scores(samples: DataFrame, built: DataFrame, voter: str, reach: int) -> DataFrame:
    """voter, di, dj, score: the share of a voter's cells that are built when it is moved by (di, dj) rows and columns."""
    moves = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = samples.select(voter, "row", "col", moves.alias("di")).select("*", moves.alias("dj"))
    hit = moved.join(built.select((F.col("row")).alias("_r"), F.col("col").alias("_c"), F.lit(1).alias("_hit")), (F.col("row") + F.col("di") == F.col("_r")) & (F.col("col") + F.col("dj") == F.col("_c")), "left")
    return hit.groupBy(voter, "di", "dj").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("score"))


def best_shift(scores: DataFrame, by: list[str], near: float = 1e-9) -> DataFrame:
    """by, di, dj, score: the best move; of those within `near` of it the shortest, then the first."""
    top = scores.groupBy(*by).agg(F.max("score").alias("_top"))
    close = (scores.join(top, by) if by else scores.crossJoin(F.broadcast(top))).where(F.col("score") >= F.col("_top") - near)
    first = F.min(F.struct((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).alias("n2"), "di", "dj", "score")).alias("m")
    return close.groupBy(*by).agg(first).select(*by, "m.di", "m.dj", "m.score")


def roof_evidence(samples: DataFrame, surface: DataFrame, footprint: str, least_height: float = 2.5, present: float = 0.5, absent: float = 0.2, surveyed: float = 0.5, roof: float = 0.9) -> DataFrame:
    """footprint, n, valid_share, occupied, status, height: what a height raster says of each footprint's cells."""
    s = samples.join(surface.select("row", "col", "height"), ["row", "col"], "left")
    built = F.col("height") >= least_height
    e = s.groupBy(footprint).agg(F.count("*").alias("n"), (F.count("height") / F.count("*")).alias("valid_share"), (F.count_if(built) / F.greatest(F.count("height"), F.lit(1))).alias("occupied"), F.percentile(F.when(built, F.col("height")), roof).alias("_roof"))
    status = F.when(F.col("valid_share") < surveyed, "no_survey").when(F.col("occupied") < absent, "absent").when(F.col("occupied") < present, "uncertain").otherwise("present")
    height = F.when(F.col("status") == "present", F.least(F.greatest("_roof", F.lit(least_height)), F.lit(250.0))).when(F.col("status") == "absent", F.lit(0.0))
    return e.withColumn("status", status).withColumn("height", height).drop("_roof")


def budget_shift(values: DataFrame, value: str, budget: float) -> float | None:
    """The shift s for which the sum of value + s, each held between 0 and 1, is the budget.

    That sum is piecewise linear in s: its slope grows by one where a value enters (s = -value) and falls by one where it
    is full (s = 1 - value). Breaks are added up per value first, then in their order, partition by partition."""
    from cityweave.operators.numbering import running_sum

    breaks = values.select(F.explode(F.array(F.struct((-F.col(value)).alias("s"), F.lit(1.0).alias("d")), F.struct((1 - F.col(value)).alias("s"), F.lit(-1.0).alias("d")))).alias("x")).select("x.*")
    breaks = breaks.groupBy("s").agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("s")).alias("ds"))
    # sum at s is s * (slope up to s) - (slope-weighted breaks up to s)
    at = running_sum(breaks, "s", ["d", "ds"]).withColumn("total", F.col("s") * F.col("d_sum") - F.col("ds_sum"))
    below = at.where(F.col("total") <= budget).orderBy(F.desc("s")).limit(1).collect()
    if not below:
        return None
    b = below[0]
    return b.s + (budget - b.total) / b.d_sum if b.d_sum > 1e-12 else b.s
