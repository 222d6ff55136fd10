"""Sun position, clear-sky irradiance and the energy balance of a solar vehicle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityweave.functions.parse import clip

#: Fixed values of Spencer's series for the declination (rad) and the equation of time (min).
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
TIME = (229.18, 0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
SOLAR_CONSTANT, DIFFUSE = 1361.0, 0.0721


def sun_angles(lat: Column, lon: Column, hour: Column, day: Column) -> Column:
    """struct<elevation, azimuth> in radians, the azimuth clockwise from north."""
    g = 2 * math.pi * (clip(day, 1, 366) - 1) / 365.0
    a = DECLINATION
    decl = a[0] + a[1] * F.cos(g) + a[2] * F.sin(g) + a[3] * F.cos(2 * g) + a[4] * F.sin(2 * g) + a[5] * F.cos(3 * g) + a[6] * F.sin(3 * g)
    t = TIME
    minutes = t[0] * (t[1] + t[2] * F.cos(g) + t[3] * F.sin(g) + t[4] * F.cos(2 * g) + t[5] * F.sin(2 * g))
    solar = hour * 60 + minutes + 4 * (lon - 15.0 * F.rint(lon / 15.0))
    angle, phi = F.radians(solar / 4 - 180.0), F.radians(lat)
    s = clip(F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle), -1.0, 1.0)
    x = -F.cos(decl) * F.sin(angle)
    y = F.sin(decl) * F.cos(phi) - F.cos(decl) * F.sin(phi) * F.cos(angle)
    return F.struct(F.asin(s).alias("elevation"), F.pmod(F.atan2(x, y) + 2 * math.pi, F.lit(2 * math.pi)).alias("azimuth"))


def direct_normal(elevation: Column) -> Column:
    s = clip(F.sin(elevation), 1e-6, 1.0)
    return F.when(elevation <= 0, 0.0).otherwise(SOLAR_CONSTANT * F.pow(F.lit(0.7), F.pow(F.greatest(F.lit(1.0), 1 / s), F.lit(0.678))))


def clear_sky(elevation: Column) -> Column:
    """struct<ghi, dni, dhi>."""
    dni = direct_normal(elevation)
    ghi = F.when(elevation <= 0, 0.0).otherwise(dni * clip(F.sin(elevation), 1e-6, 1.0) / (1 - DIFFUSE))
    return F.struct(ghi.alias("ghi"), dni.alias("dni"), (DIFFUSE * ghi).alias("dhi"))


def panel_irradiance(dni: Column, dhi: Column, elevation: Column) -> Column:
    return F.when(F.sin(elevation) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), dni * F.sin(elevation) + dhi))


def solar_joules(irradiance: Column, shade: Column, seconds: Column, area: float = 1.6, efficiency: float = 0.22, derating: float = 0.88) -> Column:
    return F.greatest(irradiance, F.lit(0.0)) * (1 - clip(shade, 0.0, 1.0)) * area * efficiency * derating * F.greatest(seconds, F.lit(0.0))


def mechanical_joules(length: Column, speed: Column, mass: float = 1400.0, rolling: float = 0.012, drag: float = 0.30, area: float = 2.2, air: float = 1.20) -> Column:
    return (rolling * mass * 9.81 + 0.5 * air * drag * area * speed * speed) * length


def simple_sun(hour: Column) -> Column:
    """struct<x, y, z>: direction to the sun of a symmetric day from 6 to 18; below the horizon (0, 0, -1)."""
    e, a = F.sin(math.pi * (hour - 6) / 12), 2 * math.pi * (hour - 6) / 24
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - e * e))
    return F.when(e <= 0, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-1.0).alias("z"))).otherwise(F.struct((F.cos(a) * flat).alias("x"), (F.sin(a) * flat).alias("y"), e.alias("z")))
