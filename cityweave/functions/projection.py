"""Map projections on the WGS84 ellipsoid: azimuthal equidistant about a centre, and transverse Mercator zones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
#: Third flattening and the series of Krueger in it (to the fourth power, under a millimetre within a zone).
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
SCALE, EAST = 0.9996, 500_000.0


def geodesic_inverse(lat0: float, lon0: float, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, azimuth at the first point) by Vincenty's method; not for nearly antipodal points."""
    u1, u2 = math.atan((1 - FLAT) * math.tan(math.radians(lat0))), np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), np.sin(u2), np.cos(u2)
    span = np.radians(lon - lon0)
    lam = span.copy()
    for _ in range(30):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.where(ss > 0, c1 * c2 * sl / np.where(ss > 0, ss, 1), 0.0)
        ca2 = 1 - sa * sa
        cm = np.where(ca2 > 0, cs - 2 * s1 * s2 / np.where(ca2 > 0, ca2, 1), 0.0)
        c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
        new = span + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        if np.abs(new - lam).max(initial=0) < 1e-13:
            lam = new
            break
        lam = new
    k = ca2 * (A * A - B * B) / (B * B)
    p = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    q = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    d = q * ss * (cm + q / 4 * (cs * (2 * cm * cm - 1) - q / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return B * p * (sigma - d), np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))


def geodesic_direct(lat0: float, lon0: float, azimuth: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) at a distance and azimuth."""
    u1 = math.atan((1 - FLAT) * math.tan(math.radians(lat0)))
    s1, c1 = math.sin(u1), math.cos(u1)
    sz, cz = np.sin(azimuth), np.cos(azimuth)
    start = np.arctan2(math.tan(u1), cz)
    sa = c1 * sz
    ca2 = 1 - sa * sa
    k = ca2 * (A * A - B * B) / (B * B)
    p = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    q = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sigma = distance / (B * p)
    for _ in range(30):
        cm, ss, cs = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
        new = distance / (B * p) + q * ss * (cm + q / 4 * (cs * (2 * cm * cm - 1) - q / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        if np.abs(new - sigma).max(initial=0) < 1e-13:
            sigma = new
            break
        sigma = new
    cm, ss, cs = np.cos(2 * start + sigma), np.sin(sigma), np.cos(sigma)
    lat = np.arctan2(s1 * cs + c1 * ss * cz, (1 - FLAT) * np.hypot(sa, s1 * ss - c1 * cs * cz))
    lam = np.arctan2(ss * sz, c1 * cs - s1 * ss * cz)
    c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    return np.degrees(lat), lon0 + np.degrees(lam - (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))))


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """struct<x, y>: metres east and north of a centre, true in distance and direction from it."""

    @F.pandas_udf("x double, y double")
    def project(lons: pd.Series, lats: pd.Series) -> pd.DataFrame:
        d, az = geodesic_inverse(lat0, lon0, lats.to_numpy(float), lons.to_numpy(float))
        return pd.DataFrame({"x": d * np.sin(az), "y": d * np.cos(az)})

    return project(lon, lat)


def local_lon_lat(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """struct<lon, lat> of local metres."""

    @F.pandas_udf("lon double, lat double")
    def back(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        a, b = xs.to_numpy(float), ys.to_numpy(float)
        lat, lon = geodesic_direct(lat0, lon0, np.arctan2(a, b), np.hypot(a, b))
        return pd.DataFrame({"lon": lon, "lat": lat})

    return back(x, y)


def box_around(lon0: float, lat0: float, radius: float) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the points `radius` metres from a centre in the four directions."""
    lat, lon = geodesic_direct(lat0, lon0, np.radians(np.array([0.0, 90.0, 180.0, 270.0])), np.full(4, float(radius)))
    return float(lon[3]), float(lat[2]), float(lon[1]), float(lat[0])


def utm(lon: Column, lat: Column, zone: int = 36, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) of a zone, as plain expressions."""
    e = math.sqrt(FLAT * (2 - FLAT))
    phi, lam = F.radians(lat), F.radians(lon - (6.0 * zone - 183.0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi0, eta0 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    eta, xi = eta0, xi0
    for j, a in enumerate(ALPHA, 1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    return EAST + SCALE * RADIUS * eta, (10_000_000.0 if south else 0.0) + SCALE * RADIUS * xi


def utm_inverse(x: Column, y: Column, zone: int = 36, south: bool = False) -> tuple[Column, Column]:
    """(lon, lat) of a zone's coordinates, as plain expressions."""
    xi, eta = (y - (10_000_000.0 if south else 0.0)) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    a, b = xi, eta
    for j, k in enumerate(BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, k in enumerate(DELTA, 1):
        phi = phi + k * F.sin(2 * j * chi)
    return (6.0 * zone - 183.0) + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(phi)
