"""Rasters as long tables of (row, col, layers): coarsening, neighbourhoods, terrain, edits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.functions.parse import clip
from cityweave.session import checkpointed


def coarsen(cells: DataFrame, factor: int, mean: tuple = (), any_: tuple = (), all_: tuple = (), total: tuple = (), low: tuple = (), whole_blocks: bool = True) -> DataFrame:
    """Blocks of factor x factor cells, each layer by its own policy; incomplete blocks go if whole_blocks."""
    aggs = [F.avg(c).alias(c) for c in mean] + [F.bool_or(c).alias(c) for c in any_] + [F.bool_and(c).alias(c) for c in all_] + [F.sum(c).alias(c) for c in total] + [F.min(c).alias(c) for c in low]
    out = cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(*aggs, F.count("*").alias("_n"))
    return (out.where(F.col("_n") == factor * factor) if whole_blocks else out).drop("_n")


def shifted(cells: DataFrame, layer: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every cell with the layer's values at the offsets: n_0, n_1 ... (null outside). One aggregation, no self-join per offset."""
    own = F.struct(F.lit(-1).alias("k"), F.col("row"), F.col("col"), F.col(layer).alias("v"))
    sent = [F.struct(F.lit(k).alias("k"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col(layer).alias("v")) for k, (dr, dc) in enumerate(offsets)]
    x = cells.select(F.explode(F.array(own, *sent)).alias("x")).select("x.*")
    out = x.groupBy("row", "col").agg(F.max(F.when(F.col("k") == -1, F.lit(True))).alias("_own"), F.max(F.when(F.col("k") == -1, F.col("v"))).alias(layer), *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n_{k}") for k in range(len(offsets))))
    return out.where(F.col("_own")).drop("_own")


RING = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def box_sum(cells: DataFrame, layer: str, radius: int) -> DataFrame:
    """Sum over the (2r+1)-square window round each cell; outside counts as 0. Two passes, along rows and along columns."""
    out = cells.select("row", "col", F.coalesce(F.col(layer), F.lit(0)).alias("_s"))
    here = cells.select("row", "col", F.col(layer))
    for axis in ("row", "col"):
        x = out.select("row", "col", "_s", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_d")).withColumn(axis, F.col(axis) + F.col("_d"))
        out = x.groupBy("row", "col").agg(F.sum("_s").alias("_s"))
    return here.join(out, ["row", "col"]).withColumnRenamed("_s", f"{layer}_box")


def gaussian(cells: DataFrame, layer: str, sigma: float, mirrored: bool = True) -> DataFrame:
    """The cells with layer_smooth: a normalised Gaussian cut at 4 sigma, along rows and then along columns.

    Missing cells count as 0. Beyond the least and the largest row and column the grid is mirrored, edge included, or 0."""
    k = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    weights = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x / sum(w)).alias("w")) for i, x in zip(range(-k, k + 1), w)))
    ends = cells.agg(*(f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = cells.select("row", "col", F.coalesce(F.col(layer).cast("double"), F.lit(0.0)).alias("_s"))
    if ends.lo_row is None:
        return cells.withColumn(f"{layer}_smooth", F.lit(None).cast("double"))
    for axis in ("row", "col"):
        lo, hi = ends[f"lo_{axis}"], ends[f"hi_{axis}"]
        n, at = hi - lo + 1, F.col(axis)
        turns = range(-(k // (2 * n)) - 1, k // (2 * n) + 2) if mirrored else [0]
        copies = [at + 2 * n * m for m in turns] + ([F.lit(2 * lo - 1 + 2 * n * m) - at for m in turns] if mirrored else [])
        x = out.select("row", "col", "_s", F.explode(F.filter(F.array(*copies), lambda e: (e >= lo - k) & (e <= hi + k))).alias("_e"))  # noqa: B023
        x = x.select("row", "col", "_s", "_e", F.explode(weights).alias("_w")).withColumn(axis, F.col("_e") - F.col("_w.i")).where(F.col(axis).between(lo, hi))
        out = x.groupBy("row", "col").agg(F.sum(F.col("_s") * F.col("_w.w")).alias("_s"))
    return cells.join(out.withColumnRenamed("_s", f"{layer}_smooth"), ["row", "col"])


def gaps_filled(cells: DataFrame, layer: str, fillable: Column | None = None, most_rounds: int = 50) -> DataFrame:
    """row, col, layer: nulls take the mean of the values around them, round by round.

    A hole beside a value is filled at once, so after the first round only the newly filled cells can reach a hole."""
    may = F.lit(True) if fillable is None else F.coalesce(fillable, F.lit(False))
    x = checkpointed(cells.select("row", "col", F.col(layer).cast("double").alias("v"), may.alias("may")))
    holes, fresh = x.where("v IS NULL AND may").select("row", "col"), x.where("v IS NOT NULL").select("row", "col", "v")
    done = [x.where("NOT (v IS NULL AND may)").select("row", "col", "v")]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in RING))).alias("n")
    for _ in range(most_rounds):
        sent = fresh.select("v", (F.col("row")).alias("r"), F.col("col").alias("c"), near).select("v", (F.col("r") + F.col("n.i")).alias("row"), (F.col("c") + F.col("n.j")).alias("col"))
        fresh = checkpointed(sent.join(holes, ["row", "col"], "left_semi").groupBy("row", "col").agg(F.avg("v").alias("v")))
        if fresh.isEmpty():
            break
        done.append(fresh)
        holes = checkpointed(holes.join(fresh, ["row", "col"], "left_anti"))
    out = holes.withColumn("v", F.lit(None).cast("double"))
    for part in done:
        out = out.unionByName(part)
    return out.withColumnRenamed("v", layer)


def local_std(cells: DataFrame, layer: str, radius: int) -> DataFrame:
    """Standard deviation in the window round each cell, of the cells that exist."""
    sq = cells.select("row", "col", F.lit(1.0).alias("one"), F.col(layer).alias("v"), (F.col(layer) * F.col(layer)).alias("vv"))
    out = sq
    for axis in ("row", "col"):
        x = out.select("*", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_d")).withColumn(axis, F.col(axis) + F.col("_d"))
        out = x.groupBy("row", "col").agg(F.sum("one").alias("one"), F.sum("v").alias("v"), F.sum("vv").alias("vv"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("vv") / F.col("one") - (F.col("v") / F.col("one")) * (F.col("v") / F.col("one"))))
    return cells.select("row", "col", F.col(layer)).join(out.select("row", "col", sd.alias("std")), ["row", "col"])


def receivers(cells: DataFrame, layer: str = "dem", res: float = 1.0) -> DataFrame:
    """D8: the neighbour of the steepest descent (to_row, to_col; the first of equals); null in pits and flats."""
    n = shifted(cells, layer, RING)
    drop = lambda k: (F.col(layer) - F.col(f"n_{k}")) / (res * math.hypot(*RING[k]))
    best = F.array_max(F.array(*(F.when(drop(k) > 0, F.struct(drop(k).alias("slope"), F.lit(-k).alias("k"))) for k in range(8))))
    n = n.withColumn("_b", best)
    dr, dc = F.array(*(F.lit(r) for r, _ in RING)), F.array(*(F.lit(c) for _, c in RING))
    k = -F.col("_b.k")
    return n.select("row", "col", F.col(layer), (F.col("row") + F.get(dr, k)).alias("to_row"), (F.col("col") + F.get(dc, k)).alias("to_col"))


def flow_accumulation(flow: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Cells, itself included, that drain through each cell: pointer doubling over the receiver forest, log2(depth) rounds."""
    state = flow.select("row", "col", F.col("to_row").alias("tr"), F.col("to_col").alias("tc"), F.lit(1).cast("long").alias("acc"))
    for _ in range(most_rounds):
        live = state.where("tr is not null")
        if live.isEmpty():
            return state.select("row", "col", F.col("acc").alias("accumulation"))
        gain = live.groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.sum("acc").alias("g"))
        hop = state.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("tr").alias("ttr"), F.col("tc").alias("ttc"))
        state = checkpointed(state.join(gain, ["row", "col"], "left").join(hop, ["tr", "tc"], "left").select("row", "col", F.col("ttr").alias("tr"), F.col("ttc").alias("tc"), (F.col("acc") + F.coalesce("g", F.lit(0))).alias("acc")))
    raise RuntimeError("the receivers hold a cycle")


def hillshade(cells: DataFrame, layer: str = "dem", res: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade in [0, 1] from central differences (one-sided at the rim)."""
    n = shifted(cells, layer, [(-1, 0), (1, 0), (0, -1), (0, 1)])
    up, down, left, right, z = (F.col(c) for c in ("n_0", "n_1", "n_2", "n_3", layer))
    slope = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * res)).when(a.isNull() & b.isNotNull(), (b - z) / res).when(b.isNull() & a.isNotNull(), (z - a) / res).otherwise(0.0)
    gy, gx = slope(up, down), slope(left, right)
    tilt = math.pi / 2 - F.atan(F.sqrt(gx * gx + gy * gy))
    aspect, az, alt = F.atan2(-gx, gy), math.radians(azimuth), math.radians(altitude)
    shade = F.sin(F.lit(alt)) * F.sin(tilt) + F.cos(F.lit(alt)) * F.cos(tilt) * F.cos(az - math.pi / 2 - aspect)
    return n.select("row", "col", clip(shade, 0.0, 1.0).alias("shade"))


def blend_materials(fractions: DataFrame, materials: DataFrame, base: DataFrame) -> DataFrame:
    """Ground values of cells partly covered by material classes.

    fractions (row, col, cls, share), materials (cls, infil, manning, depression), base (row, col, infil, manning, dem):
    the covered part takes the classes' values by share, the rest its own; the ground sinks by share times depression.
    """
    m = fractions.join(F.broadcast(materials), "cls").groupBy("row", "col").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("infil")).alias("mi"), F.sum(F.col("share") * F.col("manning")).alias("mn"), F.sum(F.col("share") * F.col("depression")).alias("md"))
    j = base.join(m, ["row", "col"], "left").fillna(0.0, ["s", "mi", "mn", "md"])
    cover, norm = F.least(F.col("s"), F.lit(1.0)), F.greatest(F.col("s"), F.lit(1.0))
    mixed = lambda own, sum_: (1 - cover) * F.col(own) + F.col(sum_) / norm
    return j.select("row", "col", mixed("infil", "mi").alias("infil"), mixed("manning", "mn").alias("manning"), (F.col("dem") - F.col("md") / norm).alias("dem"))


def apply_edits(cells: DataFrame, edits: list[dict]) -> DataFrame:
    """Edits in order, each {op, where: Column, value}: raise, lower, wall, infiltrate (at least), set_infil, manning."""
    out = cells
    for e in edits:
        hit, v = e["where"], float(e["value"])
        layer, new = {
            "raise": ("dem", lambda c: c + v), "wall": ("dem", lambda c: c + v), "lower": ("dem", lambda c: c - v),
            "infiltrate": ("infil", lambda c: F.greatest(c, F.lit(v))), "set_infil": ("infil", lambda c: F.lit(v)), "manning": ("manning", lambda c: F.lit(v)),
        }[e["op"]]
        out = out.withColumn(layer, F.when(hit, new(F.col(layer))).otherwise(F.col(layer)))
    return out


def window_max(cells: DataFrame, points: DataFrame, layer: str, radius: int) -> DataFrame:
    """Largest value in the square window round each point (point_id, row, col); off the grid 0."""
    p = points.select("point_id", F.explode(F.sequence(F.col("row") - radius, F.col("row") + radius)).alias("row"), "col").select("point_id", "row", F.explode(F.sequence(F.col("col") - radius, F.col("col") + radius)).alias("col"))
    return p.join(cells.select("row", "col", F.col(layer)), ["row", "col"], "left").groupBy("point_id").agg(F.coalesce(F.max(layer), F.lit(0.0)).alias(f"max_{layer}"))


def histogram2d(points: DataFrame, weight: str, n: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Weights summed over n x n bins of (x0, x1, y0, y1); the upper rim belongs to the last bin."""
    from cityweave.functions.raster import bin_of

    x0, x1, y0, y1 = bounds
    b = points.withColumn("bx", bin_of(F.col("x"), x0, x1, n)).withColumn("by", bin_of(F.col("y"), y0, y1, n)).where("bx is not null and by is not null")
    return b.groupBy("bx", "by").agg(F.sum(weight).alias("weight"))


def otsu(df: DataFrame, value: str, bins: int = 256) -> float | None:
    """Threshold of the largest between-class variance over a histogram; the histogram has `bins` rows at most."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None or hi <= lo:
        return lo
    k = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias("k")
    h = [0] * bins
    for r in df.where(F.col(value).isNotNull()).groupBy(k).count().collect():
        h[r.k] = r["count"]
    mid = [lo + (j + 0.5) * (hi - lo) / bins for j in range(bins)]
    total, mass = sum(h), sum(c * m for c, m in zip(h, mid))
    best, at, w, s = -1.0, mid[0], 0, 0.0
    for c, m in zip(h, mid):
        w, s = w + c, s + c * m
        if 0 < w < total:
            v = w * (total - w) * (s / w - (mass - s) / (total - w)) ** 2
            if v > best:
                best, at = v, m
    return at


def despeckle(cells: DataFrame, layer: str, threshold: float = 0.5) -> DataFrame:
    """A value that differs from the median of its 3 x 3 window by more than the threshold becomes that median."""
    n = shifted(cells, layer, RING)
    window = F.array_sort(F.array_compact(F.array(layer, *(f"n_{k}" for k in range(8)))))
    k = F.size(window)
    lo, hi = F.get(window, F.floor((k - 1) / 2).cast("int")), F.get(window, F.floor(k / 2).cast("int"))
    median = (lo + hi) / 2
    return n.select("row", "col", F.when(F.abs(F.col(layer) - median) > threshold, median).otherwise(F.col(layer)).alias(layer))


def class_fractions(cells: DataFrame, cls: str, factor: int) -> DataFrame:
    """row, col (of blocks), class, share of the block's area; only classes that occur."""
    b = cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    return b.select("row", "col", "cls", (F.col("n") / float(factor * factor)).alias("share"))


def spine(zone: DataFrame, half: int) -> DataFrame:
    """row, col: median column of each row with two cells or more, smoothed over 2 half + 1 rows; the ends repeat."""
    from pyspark.sql import Window

    m = zone.groupBy("row").agg(F.median("col").alias("c"), F.count("*").alias("n")).where("n >= 2")
    w = Window.orderBy("row")  # one row for each grid row
    full = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k, total = F.row_number().over(w), F.count("*").over(full)
    m = m.withColumn("_k", k).withColumn("_t", total).withColumn("_a", F.first("c").over(full)).withColumn("_z", F.last("c").over(full))
    s = F.sum("c").over(w.rowsBetween(-half, half))
    before, after = F.greatest(F.lit(0), half - F.col("_k") + 1), F.greatest(F.lit(0), half - (F.col("_t") - F.col("_k")))
    return m.select("row", ((s + before * F.col("_a") + after * F.col("_z")) / (2 * half + 1)).alias("col"))


def bilinear(cells: DataFrame, layer: str, points: DataFrame, categorical: bool = False) -> DataFrame:
    """point_id, value at fractional (row, col): four neighbours by weight, 0 outside; or the nearest cell."""
    if categorical:
        p = points.select("point_id", F.floor(F.col("row") + 0.5).cast("long").alias("row"), F.floor(F.col("col") + 0.5).cast("long").alias("col"))
        return p.join(cells.select("row", "col", F.col(layer).alias("value")), ["row", "col"], "left").select("point_id", "value")
    r0, c0 = F.floor("row"), F.floor("col")
    fr, fc = F.col("row") - r0, F.col("col") - c0
    near = F.array(*(F.struct((r0 + i).alias("row"), (c0 + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)))
    p = points.select("point_id", F.explode(near).alias("n")).select("point_id", "n.*")
    return p.join(cells.select("row", "col", F.col(layer).alias("_v")), ["row", "col"], "left").groupBy("point_id").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0))).alias("value"))


def bake(cells: DataFrame, materials: DataFrame, cls: str, deltas: DataFrame | None = None) -> DataFrame:
    """Cells with their class's infil and manning, the ground lowered by its depression and moved by user deltas (row, col, delta)."""
    m = materials.select(F.col("cls").alias(cls), F.col("infil").alias("_i"), F.col("manning").alias("_n"), F.col("depression").alias("_d"))
    out = cells.join(F.broadcast(m), cls, "left").withColumn("infil", F.coalesce("_i", "infil")).withColumn("manning", F.coalesce("_n", "manning")).withColumn("dem", F.col("dem") - F.coalesce("_d", F.lit(0.0)))
    if deltas is not None:
        out = out.join(deltas.select("row", "col", "delta"), ["row", "col"], "left").withColumn("dem", F.col("dem") + F.coalesce("delta", F.lit(0.0))).drop("delta")
    return out.drop("_i", "_n", "_d")


def covered_share(cells: DataFrame, by: list[str], points: str) -> DataFrame:
    """Share of cells with a point or more, in percent, and whether it is short of 95."""
    g = cells.groupBy(*by).agg((F.avg((F.coalesce(points, F.lit(0)) > 0).cast("double")) * 100).alias("covered_pct"))
    return g.withColumn("short", F.col("covered_pct") < 95)


def upstream(flow: DataFrame, seeds: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Cells that drain through a seed cell (row, col), the seeds included: pointer doubling over the receivers, log2(depth) rounds."""
    mark = seeds.select("row", "col", F.lit(True).alias("hit")).distinct()
    state = checkpointed(flow.join(mark, ["row", "col"], "left").select("row", "col", F.col("to_row").alias("tr"), F.col("to_col").alias("tc"), F.coalesce("hit", F.lit(False)).alias("hit")))
    for _ in range(most_rounds):
        if state.where("tr is not null AND NOT hit").isEmpty():
            return state.where("hit").select("row", "col")
        hop = state.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("tr").alias("ttr"), F.col("tc").alias("ttc"), F.col("hit").alias("hit2"))
        state = checkpointed(state.join(hop, ["tr", "tc"], "left").select("row", "col", F.col("ttr").alias("tr"), F.col("ttc").alias("tc"), (F.col("hit") | F.coalesce("hit2", F.lit(False))).alias("hit")))
    raise RuntimeError("the receivers hold a cycle")


def main_stem(flow: DataFrame, accumulation: DataFrame, least: float = 100.0, share: float = 0.005, outlets: DataFrame | None = None, most_rounds: int = 64) -> DataFrame:
    """row, col, pos: the way from the outlet of largest accumulation (pos 0; of equals the first in reading order) up its largest tributary.

    Only tributaries of more than max(least, share of the outlet) count; of equal ones the first in reading order. Outlets
    (row, col) may say which cells can be one. Every cell points to its largest tributary; the way doubles with each round, as
    the cells found so far take a step twice as long as before, so rounds are the logarithm of its length."""
    may = accumulation if outlets is None else accumulation.join(outlets.select("row", "col").distinct(), ["row", "col"], "left_semi")
    first = may.agg(F.min(F.struct((-F.col("accumulation")).alias("n"), "row", "col")).alias("x")).select("x.*").first()
    kinds = [accumulation.schema[c].dataType.simpleString() for c in ("row", "col")]
    if first.n is None:
        return accumulation.sparkSession.createDataFrame([], f"row {kinds[0]}, col {kinds[1]}, pos long")
    big = flow.join(accumulation, ["row", "col"]).where((F.col("accumulation") > max(least, share * -first.n)) & F.col("to_row").isNotNull())
    best = F.min(F.struct((-F.col("accumulation")).alias("n"), "row", "col")).alias("x")
    step = checkpointed(big.groupBy(F.col("to_row").cast(kinds[0]).alias("row"), F.col("to_col").cast(kinds[1]).alias("col")).agg(best).select("row", "col", F.col("x.row").alias("up_row"), F.col("x.col").alias("up_col")))
    way = accumulation.sparkSession.createDataFrame([(first.row, first.col, 0)], f"row {kinds[0]}, col {kinds[1]}, pos long")
    for k in range(most_rounds):
        ahead = checkpointed(way.join(step, ["row", "col"]).select(F.col("up_row").alias("row"), F.col("up_col").alias("col"), (F.col("pos") + 2**k).alias("pos")))
        if ahead.isEmpty():
            return way
        way = checkpointed(way.unionByName(ahead))
        onward = step.select(F.col("row").alias("up_row"), F.col("col").alias("up_col"), F.col("up_row").alias("r"), F.col("up_col").alias("c"))
        step = checkpointed(step.join(onward, ["up_row", "up_col"]).select("row", "col", F.col("r").alias("up_row"), F.col("c").alias("up_col")))
    raise RuntimeError("the receivers hold a cycle")


def land_cover(cells: DataFrame, vegetation: float, rough: float, bright: float) -> DataFrame:
    """cover: the last rule that holds of ground, soil, vegetation, rough ground, paved, water, building (cells: exg, relief, std, brightness, flags)."""
    c = F.when(F.col("building"), "building").when(F.col("water"), "water").when((F.col("brightness") > bright) & (F.col("std") < rough), "paved").when(F.col("std") >= rough, "rough")
    return cells.withColumn("cover", c.when(F.col("exg") > vegetation, "vegetation").when(F.col("relief") < 0.5, "soil").otherwise("ground"))
