"""Columns from the loosely typed attributes of map features and timetables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres a second and kilometres an hour of a mile an hour, metres of a storey.
MPH_MS, MPH_KMH, LEVEL_M = 0.44704, 1.60934, 3.5
#: Free-flow speed (m/s) by road class.
CLASS_SPEED = {
    "motorway": 33.3, "trunk": 22.2, "primary": 13.9, "secondary": 13.9, "tertiary": 11.1,
    "residential": 8.3, "living_street": 5.6, "unclassified": 11.1, "service": 5.6,
}
#: Reporting class by road class.
ROAD_CLASS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "motorway", "trunk_link": "motorway",
    "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary",
    "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential", "living_street": "residential",
    "service": "residential", "unclassified": "residential",
}


def lookup(key: Column, table: dict, default=None) -> Column:
    """The value of key in a small literal table."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(m, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))  # greatest() skips nulls


def height(height_m: Column, floors: Column, default: float | None = None) -> Column:
    """Height if positive, else floors of 3.5 m, else the default."""
    return F.when(height_m > 0, height_m).when(floors > 0, floors * LEVEL_M).otherwise(F.lit(default).cast("double"))


def limit_kmh(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit) == "mph", F.round(value * MPH_KMH, 1)).otherwise(value)


def speed_limits(rules: Column) -> Column:
    """array<struct<max_speed:struct<value,unit>, when:string>> to array<struct<value_kmh, when>>."""
    return F.transform(rules, lambda r: F.struct(limit_kmh(r["max_speed"]["value"], r["max_speed"]["unit"]).alias("value_kmh"), r["when"].alias("when")))


def default_limit(limits: Column) -> Column:
    """The first limit without a condition, else the first."""
    plain = F.filter(limits, lambda r: r["when"].isNull())
    return F.coalesce(F.get(plain, F.lit(0))["value_kmh"], F.get(limits, F.lit(0))["value_kmh"])


def speed_ms(raw: Column) -> Column:
    """'30 mph' or km/h to m/s; null if there is no leading number."""
    s = F.lower(F.trim(raw))
    n = F.try_element_at(F.split(s, "\\s+"), F.lit(1)).try_cast("double")
    return F.when(s.contains("mph"), n * MPH_MS).otherwise(n / 3.6)


def max_speed_ms(raws: Column) -> Column:
    """The largest speed of an array of limits; zeros and unreadable ones don't count."""
    return F.array_max(F.filter(F.transform(raws, speed_ms), lambda v: v > 0))


def first_speed_ms(raws: Column, default: float = 13.9) -> Column:
    """The number and unit that the first limit starts with, else the default."""
    s = F.lower(F.coalesce(F.get(raws, F.lit(0)), F.lit("")))
    n = F.regexp_extract(s, "([0-9]+(?:\\.[0-9]+)?)\\s*(mph|km/h)?", 1)
    unit = F.regexp_extract(s, "([0-9]+(?:\\.[0-9]+)?)\\s*(mph|km/h)?", 2)
    return F.when(n == "", F.lit(default)).otherwise(n.try_cast("double") * F.when(unit == "mph", MPH_MS).otherwise(1 / 3.6))


def edge_speed_ms(maxspeed: Column, highway: Column) -> Column:
    """Limit clipped to 2.8..41.7 m/s, else the speed of the road class, else 11.1."""
    return F.coalesce(clip(max_speed_ms(maxspeed), 2.8, 41.7), lookup(F.get(highway, F.lit(0)), CLASS_SPEED, 11.1))


def travel_time(length: Column, speed: Column, straight: Column) -> Column:
    """Seconds over the length, or over the straight distance where the length isn't positive."""
    return F.when(length > 0, length).otherwise(straight) / speed


def road_class(highway: Column) -> Column:
    return lookup(F.coalesce(F.get(highway, F.lit(0)), F.lit("")), ROAD_CLASS, "other")


def lanes(raw: Column) -> Column:
    """The largest integer of '2;3' or of an array's texts; at least 1."""
    n = F.array_max(F.transform(F.split(raw, "[;,|]"), lambda x: F.trim(x).try_cast("double").cast("int")))
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))


def length_m(raw: Column) -> Column:
    """The first number of a tagged length in metres (feet, cm and mm are converted); null unless positive."""
    s = F.lower(F.trim(F.element_at(F.split(F.regexp_replace(raw, ",", "."), ";"), 1)))
    n = F.regexp_extract(s, "-?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")
    v = n * F.when(s.rlike("ft|feet|foot|'"), 0.3048).when(s.contains("cm"), 0.01).when(s.contains("mm"), 0.001).otherwise(1.0)
    return F.when(v > 0, v)


def tag_set(raw: Column) -> Column:
    """Distinct, trimmed, lower-cased, non-empty texts of an array, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def clock_seconds(raw: Column) -> Column:
    """'HH:MM:SS' with any number of hours to seconds; malformed gives 0."""
    p = F.split(F.trim(raw), ":")
    v = F.transform(p, lambda x: x.try_cast("double"))
    ok = (F.size(p) == 3) & ~F.exists(v, lambda x: x.isNull())
    return F.when(ok, v[0] * 3600 + v[1] * 60 + v[2]).otherwise(0.0)


def first_category(categories: Column, table: dict, default: str) -> Column:
    """The value of the first category that the table has, else the default."""
    return F.coalesce(F.get(F.filter(F.transform(categories, lambda c: lookup(c, table)), lambda v: v.isNotNull()), F.lit(0)), F.lit(default))


def lat_lon(raw: Column) -> Column:
    """struct<lat,lon> of a literal 'lat, lon', null for anything else."""
    pat = "^\\s*(-?[0-9]+(?:\\.[0-9]+)?)\\s*,\\s*(-?[0-9]+(?:\\.[0-9]+)?)\\s*$"
    lat, lon = (F.regexp_extract(raw, pat, k).try_cast("double") for k in (1, 2))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def is_one_way(flag: Column, flags: Column, directions: Column) -> Column:
    """One of three signals: the flag, a flag text, or lanes that all run one way."""
    d = F.array_distinct(F.filter(directions, lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.exists(flags, lambda x: x.isin("is_oneway", "oneway")), F.lit(False)) | F.coalesce((F.size(d) == 1) & d[0].isin("forward", "backward"), F.lit(False))
