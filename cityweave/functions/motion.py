"""Headings, turns, demand curves, signal timing and the car-following law."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityweave.functions.parse import clip


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Compass degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(x1 - x0, y1 - y0)) + 360.0, F.lit(360.0))


def turn(bearing_in: Column, bearing_out: Column) -> Column:
    d = F.pmod(bearing_out - bearing_in + 360.0, F.lit(360.0))
    return F.when((d < 30) | (d > 330), "straight").when(d < 150, "right").when(d > 210, "left").otherwise("u_turn")


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two headings; 0 if one has no length."""
    n = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(n < 1e-9, F.lit(0.0)).otherwise(F.degrees(F.acos(clip(F.try_divide(ax * bx + ay * by, n), -1.0, 1.0))))


def turn_speed(angle: Column) -> Column:
    """Speed that a turn allows (m/s); null where it doesn't matter."""
    return F.when(angle < 20, F.lit(None).cast("double")).when(angle < 45, 8.3).when(angle < 90, 5.6).when(angle < 135, 3.9).otherwise(2.8)


def bell(x: Column, centre: float, width: float) -> Column:
    return F.exp(-0.5 * ((x - centre) / width) * ((x - centre) / width))


def rush_factor(hour: Column) -> Column:
    """Traffic intensity by hour: peaks at 8 and 18, a dip at 3."""
    dip = F.when(hour < 10, 0.4 * bell(hour, 3.0, 2.0)).otherwise(0.0)
    return clip(0.7 + 0.7 * F.greatest(bell(hour, 8.0, 1.2), bell(hour, 18.0, 1.2)) - dip, 0.6, 1.4)


def outbound_share(hour: Column) -> Column:
    """Probability that a trip leaves home, by hour."""
    h = F.pmod(hour, F.lit(24.0))
    return clip(0.5 + 0.4 * bell(h, 8.0, 2.5) - 0.4 * bell(h, 18.0, 2.5), 0.1, 0.9)


def green_seconds(speed: Column, total: Column) -> Column:
    """Green time by a group's share of the approach speeds: 14 s and 31 s times the share, 14 to 45."""
    return F.when(total > 1e-6, clip(14.0 + 31.0 * F.try_divide(speed, total), 14.0, 45.0)).otherwise(29.5)


def yellow_seconds(speed: Column) -> Column:
    return clip(1.0 + speed / 6.0, 3.0, 5.5)


def signal_state(t: Column, green: list[float], yellow: list[float], red: float) -> Column:
    """struct<phase, state> of a fixed cycle of green, yellow and all-red phases at second t."""
    cycle = sum(green) + sum(yellow) + red * len(green)
    at, edge, out = F.pmod(t, F.lit(cycle)), 0.0, None
    for k, (g, y) in enumerate(zip(green, yellow)):
        for name, span in (("green", g), ("yellow", y), ("all_red", red)):
            edge += span
            value = F.struct(F.lit(k).alias("phase"), F.lit(name).alias("state"))
            out = F.when(at < edge, value) if out is None else out.when(at < edge, value)
    return out.otherwise(F.struct(F.lit(len(green) - 1).alias("phase"), F.lit("all_red").alias("state")))


def idm_acceleration(v: Column, v0: Column, gap: Column, dv: Column, a: float = 1.5, b: float = 2.5, headway: float = 1.5, s0: float = 2.0) -> Column:
    """Intelligent-driver acceleration; a null gap (or one of 1e30 and more) means a free road."""
    want = s0 + F.greatest(F.lit(0.0), v * headway + v * dv / (2 * (a * b) ** 0.5))
    pull = F.when(gap.isNull() | (gap >= 1e30), 0.0).otherwise(F.pow(F.try_divide(want, gap), F.lit(2.0)))
    free = F.pow(v / F.greatest(v0, F.lit(0.1)), F.lit(4.0))
    return clip(a * (1 - free - pull), -3 * b, a)


def congestion(mean_speed: Column, free_flow: Column) -> Column:
    r = mean_speed / F.greatest(free_flow, F.lit(0.1))
    return F.when(r > 0.8, "free").when(r > 0.5, "slowing").otherwise("jammed")


def diff_shade(delta: Column, most: float) -> Column:
    """Change in [-1, 1] for a diverging colour scale."""
    return clip(delta, -most, most) / most
