import numpy as np
from pyspark.sql import functions as F

from cityweave.functions import projection as p


def test_known_distances():
    d, az = p.geodesic_inverse(0.0, 0.0, np.array([0.0, 1.0, 0.0]), np.array([1.0, 0.0, 0.0]))
    assert np.allclose(d[:2], [111319.4908, 110574.3886], atol=1e-3) and d[2] == 0
    assert np.allclose(np.degrees(az[:2]), [90, 0])
    # Flinders Peak to Buninyong, the usual example of the method (converted to this ellipsoid)
    d, az = p.geodesic_inverse(-37.95103341666667, 144.42486788888888, np.array([-37.65282113888889]), np.array([143.92649552777777]))
    assert abs(d[0] - 54972.271) < 0.05 and abs(np.degrees(az[0]) % 360 - 306.868) < 1e-3


def test_round_trips(spark):
    r = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(35.5 + r.normal(0, 0.05, 200), 33.9 + r.normal(0, 0.05, 200))]
    df = spark.createDataFrame(rows, "lon double, lat double")
    xy = df.withColumn("q", p.local_xy(F.col("lon"), F.col("lat"), 35.5, 33.9))
    back = xy.withColumn("l", p.local_lon_lat(F.col("q.x"), F.col("q.y"), 35.5, 33.9))
    assert back.where("abs(l.lon - lon) > 1e-9 OR abs(l.lat - lat) > 1e-9").count() == 0
    e, n = p.utm(F.col("lon"), F.col("lat"))
    u = df.withColumn("e", e).withColumn("n", n)
    lon, lat = p.utm_inverse(F.col("e"), F.col("n"))
    assert u.where((F.abs(lon - F.col("lon")) > 1e-8) | (F.abs(lat - F.col("lat")) > 1e-8)).count() == 0
    # the grid scale at these places is within 0.9996 and 1.0 of the true distance
    a = u.join(xy.select("lon", "lat", "q"), ["lon", "lat"]).limit(20).collect()
    for s, t in zip(a, a[1:]):
        ratio = np.hypot(s.e - t.e, s.n - t.n) / np.hypot(s.q.x - t.q.x, s.q.y - t.q.y)
        assert 0.9995 < ratio < 1.0011


def test_central_meridian_and_box(spark):
    e, n = p.utm(F.lit(33.0), F.lit(0.0))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(row.e - 500000) < 1e-6 and abs(row.n) < 1e-6
    w, s, east, north = p.box_around(35.5, 33.9, 1000.0)
    assert w < 35.5 < east and s < 33.9 < north and abs((north - s) * 110900 - 2000) < 10
