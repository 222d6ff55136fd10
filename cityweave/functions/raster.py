"""Cell addresses, lookups and classes of regular grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityweave.functions.parse import clip

#: Durations (min) and intensities (mm/h) by return period (years).
IDF_MINUTES = (10, 20, 30, 60, 90, 120)
IDF = {
    2: (74.1, 53.3, 41.9, 25.9, 20.0, 17.8),
    5: (98.7, 70.0, 55.0, 33.3, 25.4, 23.0),
    10: (118.4, 84.9, 66.8, 41.7, 31.7, 27.4),
    25: (141.9, 102.4, 81.0, 51.0, 38.2, 32.0),
    50: (159.3, 115.4, 91.6, 57.9, 43.0, 35.3),
    100: (181.0, 131.2, 102.2, 64.5, 48.8, 40.3),
}


def col_row(x: Column, y: Column, minx: float, maxy: float, res: float) -> tuple[Column, Column]:
    return (x - minx) / res, (maxy - y) / res


def cell(x: Column, y: Column, minx: float, maxy: float, res: float) -> tuple[Column, Column]:
    """Integer (col, row), row 0 in the north."""
    c, r = col_row(x, y, minx, maxy, res)
    return F.floor(c).cast("int"), F.floor(r).cast("int")


def centre(col: Column, row: Column, minx: float, maxy: float, res: float) -> tuple[Column, Column]:
    return minx + (col + 0.5) * res, maxy - (row + 0.5) * res


def bin_of(x: Column, low: float, high: float, n: int) -> Column:
    """Number of a histogram bin; the last bin holds its upper edge; null outside."""
    k = F.floor((x - low) / (high - low) * n).cast("int")
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(n - 1)))


def intensity(minutes: Column, years: int) -> Column:
    """mm/h for a duration, by log-log interpolation within the table and its end values outside."""
    t, v = IDF_MINUTES, IDF[years]
    out = F.when(minutes <= t[0], F.lit(v[0]))
    for a, b, p, q in zip(t, t[1:], v, v[1:]):
        s = (F.log(minutes) - math.log(a)) / (math.log(b) - math.log(a))
        out = out.when(minutes <= b, F.exp(math.log(p) + s * (math.log(q) - math.log(p))))
    return out.otherwise(F.lit(v[-1]))


def percent_change(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """100 (b - a) / a; null where a is 0."""
    return F.when(F.abs(a) > eps, 100.0 * F.try_divide(b - a, a))


def hazard(depth: Column, speed: Column) -> Column:
    return depth * (speed + 0.5)


def hazard_class(h: Column, depth: Column) -> Column:
    """0 to 3 by 0.75, 1.25 and 2.0; null where the depth is under 0.10."""
    return F.when(depth >= 0.10, F.when(h < 0.75, 0).when(h < 1.25, 1).when(h < 2.0, 2).otherwise(3))


def rain_at(steps: Column, t: Column) -> Column:
    """Value of a step function, an array<struct<t0,t1,mmh>>, at t; 0 outside."""
    return F.coalesce(F.get(F.filter(steps, lambda s: (s["t0"] <= t) & (t < s["t1"])), F.lit(0))["mmh"], F.lit(0.0))


def rain_until(steps: Column, t: Column) -> Column:
    """Millimetres fallen until t."""
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + F.greatest(F.least(s["t1"], t) - s["t0"], F.lit(0.0)) * s["mmh"] / 3600.0)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    n = F.greatest(r + g + b, F.lit(1))
    return (2 * g - r - b) / n


def quantized(z: Column, low: float, scale: float) -> Column:
    """Height as a 16-bit number; null becomes 0."""
    return F.coalesce(clip(F.rint((z - low) / max(scale, 1e-9)), 0, 65535), F.lit(0)).cast("int")


def bridge_height(bridge: Column, layer: Column) -> Column:
    return F.when(F.coalesce(F.lower(bridge), F.lit("")).isin("", "no", "false"), 0.0).otherwise(5.0 * F.greatest(F.lit(1), F.coalesce(layer, F.lit(1))))


def ramp(height: Column, along: Column, length: Column, ramp_m: float) -> Column:
    return height * clip(F.least(along, length - along) / ramp_m, 0.0, 1.0)
