"""Emission rates by speed and vehicle class, and noise levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityweave.functions.parse import lookup

BEST_KMH = 65.0
POLLUTANTS = ("co2", "nox", "pm")
#: Fuel, NOx and PM multipliers and fuel of each vehicle class.
VEHICLE_CLASS = {
    "passenger": (1.00, 1.0, 1.0, "petrol"),
    "private": (1.00, 1.0, 1.0, "petrol"),
    "taxi": (1.10, 1.3, 1.2, "diesel"),
    "bus": (3.20, 9.0, 6.0, "diesel"),
    "coach": (3.20, 9.0, 6.0, "diesel"),
    "truck": (3.60, 11.0, 7.0, "diesel"),
    "trailer": (4.20, 13.0, 8.0, "diesel"),
    "delivery": (1.60, 3.0, 2.5, "diesel"),
    "emergency": (2.00, 4.0, 3.0, "diesel"),
    "motorcycle": (0.45, 0.6, 1.4, "petrol"),
    "moped": (0.30, 0.4, 1.6, "petrol"),
    "bicycle": (0.00, 0.0, 0.0, "petrol"),
}
CO2_PER_LITRE = {"petrol": 2310.0, "diesel": 2640.0}
LITRES_PER_100KM, NOX_PER_KM, PM_PER_KM = 5.5, 0.06, 0.003
IDLE = {"co2": 0.6, "nox": 0.0009, "pm": 0.00004}


def speed_shape(kmh: Column) -> Column:
    """Factor on the emission per km, 1 at the best speed; the square counts on both sides of it."""
    v = F.greatest(kmh, F.lit(3.0))
    return 1 + F.greatest(F.lit(0.0), 0.95 * (BEST_KMH / v - 1)) + 0.55 * ((v - BEST_KMH) / BEST_KMH) * ((v - BEST_KMH) / BEST_KMH)


def multiplier(vclass: Column, pollutant: str) -> Column:
    k = {"co2": 0, "nox": 1, "pm": 2}[pollutant]
    return lookup(vclass, {c: v[k] for c, v in VEHICLE_CLASS.items()}, 1.0)


def factor_g_km(pollutant: str, speed_ms: Column, vclass: Column) -> Column:
    """Grams per km; unknown classes count as passenger cars."""
    shape, m = speed_shape(speed_ms * 3.6), multiplier(vclass, pollutant)
    if pollutant == "co2":
        return LITRES_PER_100KM * m * shape / 100.0 * lookup(vclass, {c: CO2_PER_LITRE[v[3]] for c, v in VEHICLE_CLASS.items()}, CO2_PER_LITRE["petrol"])
    return (NOX_PER_KM if pollutant == "nox" else PM_PER_KM) * m * shape


def rate_g_s(pollutant: str, speed_ms: Column, vclass: Column) -> Column:
    """Grams per second: idling below 0.3 m/s, else the factor times the speed and a fifth of idling."""
    idle = IDLE[pollutant] * multiplier(vclass, pollutant)
    return F.when(speed_ms < 0.3, idle).otherwise(factor_g_km(pollutant, speed_ms, vclass) * F.greatest(speed_ms * 3.6, F.lit(0.0)) / 3600.0 + idle * 0.2)


def source_level(speed_ms: Column, reference_db: float) -> Column:
    """Noise level of a vehicle at 1 m, from its speed (at least 1 km/h)."""
    return reference_db + 10 * F.log10(F.greatest(speed_ms * 3.6, F.lit(1.0)) / 50.0)


def received_energy(level: Column, distance: Column) -> Column:
    return F.pow(F.lit(10.0), (level - 20 * F.log10(F.greatest(distance, F.lit(1.0)))) / 10)


def energy_level(total: Column) -> Column:
    return 10 * F.log10(F.greatest(total, F.lit(1e-12)))
