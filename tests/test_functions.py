"""Values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cityweave.functions import emissions, motion, parse, raster, solar


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def near(a, b, eps=1e-6):
    assert a == pytest.approx(b, abs=eps)


def test_heights_speeds_lanes(spark):
    null = F.lit(None).cast("double")
    assert one(spark, parse.height(null, F.lit(4))) == 14.0
    assert one(spark, parse.height(F.lit(-1.0), F.lit(0), 9.0)) == 9.0
    near(one(spark, parse.limit_kmh(F.lit(30.0), F.lit("mph"))), 48.3)
    near(one(spark, parse.speed_ms(F.lit("30 mph"))), 13.4112)
    near(one(spark, parse.speed_ms(F.lit("50"))), 50 / 3.6)
    assert one(spark, parse.speed_ms(F.lit("walk"))) is None
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    near(one(spark, parse.max_speed_ms(arr("30", "50 mph", "none"))), 50 * 0.44704)
    near(one(spark, parse.first_speed_ms(arr("30", "50 mph"))), 30 / 3.6)
    assert one(spark, parse.first_speed_ms(arr("none"))) == 13.9
    assert one(spark, parse.first_speed_ms(F.array().cast("array<string>"))) == 13.9
    assert [one(spark, parse.lanes(F.lit(x))) for x in ("2", "2;3", "x", "0")] == [2, 3, 1, 1]
    near(one(spark, parse.length_m(F.lit("3,5 m;9"))), 3.5)
    near(one(spark, parse.length_m(F.lit("10 ft"))), 3.048)
    near(one(spark, parse.length_m(F.lit("350cm"))), 3.5)
    assert one(spark, parse.length_m(F.lit("-2"))) is None
    assert one(spark, parse.tag_set(arr(" B", "a", "b", ""))) == ["a", "b"]


def test_road_classes_and_clock(spark):
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    cases = [(("motorway_link",), "motorway"), (("residential",), "residential"), (("primary", "secondary"), "primary"), (("footway",), "other")]
    assert [one(spark, parse.road_class(arr(*h))) for h, _ in cases] == [c for _, c in cases]
    assert one(spark, parse.road_class(F.lit(None).cast("array<string>"))) == "other"
    assert one(spark, parse.clock_seconds(F.lit("25:10:00"))) == 90600.0
    assert one(spark, parse.clock_seconds(F.lit("25:10"))) == 0.0
    assert one(spark, parse.clock_seconds(F.lit("a:b:c"))) == 0.0
    assert one(spark, parse.lat_lon(F.lit("33.9, 35.5")))["lon"] == 35.5
    assert one(spark, parse.lat_lon(F.lit("Beach 3"))) is None
    flags = F.array().cast("array<string>")
    assert one(spark, parse.is_one_way(F.lit(None).cast("boolean"), flags, arr("forward", "forward")))
    assert not one(spark, parse.is_one_way(F.lit(None).cast("boolean"), flags, arr("forward", "backward")))
    assert one(spark, parse.first_category(arr("x", "cafe"), {"cafe": "C"}, "?")) == "C"


def test_emission_rates(spark):
    rate = lambda p, v, c: one(spark, emissions.rate_g_s(p, F.lit(float(v)), F.lit(c)))
    for v, co2, nox, pm in ((0, 0.6, 0.0009, 0.00004), (5, 2.513697, 0.001310435, 0.000064522), (10, 2.501879, 0.001304854, 0.000064243), (18, 2.413617, 0.001263172, 0.000062159)):
        near(rate("co2", v, "passenger"), co2)
        near(rate("nox", v, "passenger"), nox, 1e-9)
        near(rate("pm", v, "passenger"), pm, 1e-9)
    near(rate("co2", 10, "bus"), 9.094871)
    near(rate("nox", 10, "bus"), 0.011743688, 1e-9)
    assert rate("co2", 10, "submarine") == rate("co2", 10, "passenger")
    assert rate("co2", 10, "bicycle") < 0.1 * rate("co2", 10, "passenger")
    for ref, want in ((85.0, 65.969100), (55.0, 35.969100)):
        level = emissions.source_level(F.lit(50 / 3.6), ref)
        near(one(spark, emissions.energy_level(emissions.received_energy(level, F.lit(10.0)) + emissions.received_energy(level, F.lit(20.0)))), want)


def test_demand_signals_following(spark):
    for h, out, rush in ((3, 0.554134, 0.6), (8, 0.899866, 1.382425), (12, 0.588761, 0.702706), (18, 0.100134, 1.4)):
        near(one(spark, motion.outbound_share(F.lit(float(h)))), out)
        near(one(spark, motion.rush_factor(F.lit(float(h)))), rush)
    for v, green, yellow in ((13.9, 33.4099, 3.3167), (8.3, 25.5901, 3.0)):
        near(one(spark, motion.green_seconds(F.lit(v), F.lit(22.2))), green, 1e-4)
        near(one(spark, motion.yellow_seconds(F.lit(v))), yellow, 1e-4)
    none = F.lit(None).cast("double")
    near(one(spark, motion.idm_acceleration(F.lit(10.0), F.lit(13.9), none, F.lit(0.0))), 1.098180)
    near(one(spark, motion.idm_acceleration(F.lit(10.0), F.lit(13.9), F.lit(20.0), F.lit(4.0))), -1.702385)
    assert [one(spark, motion.turn(F.lit(0.0), F.lit(float(b)))) for b in (10, 90, 180, 270, 340)] == ["straight", "right", "u_turn", "left", "straight"]
    near(one(spark, motion.bearing(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0))), 270.0)
    near(one(spark, motion.turn_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0))), 90.0)
    assert one(spark, motion.turn_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0))) == 0.0
    assert [one(spark, motion.turn_speed(F.lit(float(a)))) for a in (10, 30, 60, 100, 170)] == [None, 8.3, 5.6, 3.9, 2.8]


def test_storms_and_sun(spark):
    steps = F.array(*(F.struct(F.lit(a).alias("t0"), F.lit(b).alias("t1"), F.lit(i).alias("mmh")) for a, b, i in ((0, 450, 12.8), (450, 1350, 88.8), (1350, 1800, 12.8))))
    near(one(spark, raster.rain_until(steps, F.lit(900))), 12.7)
    near(one(spark, raster.rain_until(steps, F.lit(9000))), 25.4)
    assert one(spark, raster.rain_at(steps, F.lit(450))) == 88.8 and one(spark, raster.rain_at(steps, F.lit(1800))) == 0.0
    for m, want in ((10, 118.4), (15, 97.4669), (60, 41.7), (5, 118.4)):
        near(one(spark, raster.intensity(F.lit(m), 10)), want, 1e-4)
    up, down = (one(spark, solar.sun_angles(F.lit(33.9), F.lit(35.5), F.lit(float(h)), F.lit(172))) for h in (12, 0))
    assert 1.2 < up.elevation < 1.45 and down.elevation < 0
    assert one(spark, solar.clear_sky(F.lit(-0.1))).ghi == 0
    assert one(spark, solar.simple_sun(F.lit(3.0))).z == -1.0
    assert one(spark, raster.bin_of(F.lit(10.0), 0.0, 10.0, 5)) == 4
    assert one(spark, raster.percent_change(F.lit(0.0), F.lit(5.0))) is None
    assert one(spark, raster.quantized(F.lit(None).cast("double"), 0.0, 0.1)) == 0
