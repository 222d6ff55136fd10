import zipfile

import numpy as np
from pyspark.sql import functions as F

from cityweave.sources import pointcloud, sinks, tables


def test_transit(spark, tmp_path):
    files = {
        "routes.txt": "﻿route_id,route_type\nr1,3\nr2,0\n",
        "trips.txt": "trip_id,route_id\nt1,r1\nt2,r2\nt3,r1\n",
        "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt1,s2,10,25:10:00,25:10:30\nt1,s1,2,25:00:00,24:59:00\nt2,s1,1,08:00:00,08:00:00\nt2,s2,2,08:09:00,08:09:00\nt3,s1,1,bad,09:00:00\n",
        "stops.txt": "stop_id,stop_lat,stop_lon\ns1,33.9,35.5\ns2,33.8,35.6\n",
    }
    folder = tmp_path / "gtfs"
    folder.mkdir()
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        for name, text in files.items():
            (folder / name).write_text(text, encoding="utf-8")
            z.writestr("inner/" + name, text)
    for root in (str(folder), str(tmp_path / "g.zip")):
        t = [tables.transit_table(spark, root, n) for n in files]
        got = tables.bus_stop_times(*t).orderBy("trip_id", "seq").collect()
        assert [(r.trip_id, r.stop_id, r.seq, r.arrival_s, r.dwell_s) for r in got] == [("t1", "s1", 2, 90000.0, 0.0), ("t1", "s2", 10, 90600.0, 30.0)]
        assert tables.transit_table(spark, root, "shapes.txt").count() == 0
    no_bus = spark.createDataFrame([("r2", "0")], "route_id string, route_type string")
    assert tables.bus_stop_times(no_bus, *t[1:]).select("trip_id").distinct().collect()[0].trip_id == "t2"


def test_text_formats(spark, tmp_path):
    grid = tmp_path / "a.asc"
    header = {"ncols": 3, "nrows": 2, "xllcorner": 0, "yllcorner": 0, "cellsize": 2}
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 2, -2.25), (1, 1, None)], "row int, col int, z double")
    sinks.write_ascii_grid(cells, "z", header, str(grid))
    head, back = tables.ascii_grid(spark, str(grid))
    assert head["cellsize"] == 2
    assert sorted((r.row, r.col, r.value) for r in back.where("value is not null").collect()) == [(0, 0, 1.5), (0, 2, -2.25)]
    assert back.count() == 6
    rain = tmp_path / "x.rain"
    rain.write_text("# rain\n3 minutes\n4.0 2\n1.0 0\n9.0 2\n")
    assert [tuple(r) for r in tables.series(spark, str(rain)).collect()] == [(0.0, 1.0), (120.0, 4.0), (120.0, 9.0)]
    stage = tmp_path / "x.stage"
    stage.write_text("a b c\n1 2\n0.0 1.5 2.5\n1.0 nan? 2\n2.0 3 4\n")
    assert [list(r["values"]) for r in tables.number_rows(spark, str(stage), 3).orderBy("n").collect()] == [[0.0, 1.5, 2.5], [2.0, 3.0, 4.0]]
    storm = tmp_path / "s1.json"
    storm.write_text('{"steps": [[0, 450, 12.8],\n [450, 900, 5]]}')
    assert [tuple(r) for r in tables.storm_steps(spark, str(storm)).orderBy("t0").collect()] == [("s1", 0.0, 450.0, 12.8), ("s1", 450.0, 900.0, 5.0)]


def test_features(spark):
    row = spark.createDataFrame([(1, b"g", None, 4, None, ("brick", None)), (2, b"g", 8.0, 4, "wood", (None, "flat")), (3, None, 1.0, 1, None, None)], "id int, geometry binary, height double, num_floors int, facade_material string, properties struct<facade_material:string,roof_shape:string>")
    got = {r.id: r for r in tables.buildings(row).collect()}
    assert got[1].height_m == 14.0 and got[1].facade_material == "brick" and got[2].facade_material == "wood" and 3 not in got
    seg = "id int, geometry binary, class string, connectors array<struct<connector_id:string>>, road struct<is_oneway:boolean,flags:array<string>,lanes:array<struct<direction:string>>,speed_limits:array<struct<max_speed:struct<value:double,unit:string>,when:string>>,road_surface:array<struct<value:string>>,width_rules:array<struct<value:double>>>"
    s = spark.createDataFrame([(1, b"g", None, [("c1",)], (None, None, [("forward",), ("forward",)], [((50.0, "km/h"), "night"), ((30.0, "mph"), None)], [("paved",)], [(3.5,)])), (2, b"g", "primary", [], (None, [], [("forward",), ("backward",)], None, None, None))], seg)
    a, b = tables.street_segments(s).orderBy("id").collect()
    assert (a.oneway, a.maxspeed_kmh, a.surface, a.width_m, a.lanes, a.connectors) == (True, 48.3, "paved", 3.5, 2, ["c1"]) and a["class"] == "unclassified"
    assert (b.oneway, b.maxspeed_kmh, b["class"]) == (False, None, "primary")
    p = spark.createDataFrame([(b"1", (None, [("Bar",)]), ("cafe", ["tea"]), None, [("S 1", "B")]), (b"2", ("Low", None), ("x", None), 0.5, [])], "geometry binary, names struct<primary:string,common:array<struct<value:string>>>, categories struct<primary:string,alternate:array<string>>, confidence double, addresses array<struct<freeform:string,locality:string>>")
    got = tables.places(p).collect()
    assert [(r.name, r.categories, r.address) for r in got] == [("Bar", ["cafe", "tea"], "S 1, B")]


def test_point_cloud(spark, tmp_path):
    r = np.random.default_rng(1)
    points = np.column_stack([r.random((1000, 3)) * 50, r.integers(0, 65535, (1000, 3))])
    h = pointcloud.Header(227, 1000, (0.01, 0.01, 0.001), (5.0, 0.0, -1.0), (0, 0, 0), (50, 50, 50), 1000)
    path = tmp_path / "a.las"
    path.write_bytes(pointcloud.write_header(h) + pointcloud.points_bytes(points, h))
    back = pointcloud.read_header(path.read_bytes()[:227], path.stat().st_size)
    assert back == h and not back.partial
    df = pointcloud.read_points(spark, str(path), chunk=300)
    assert df.rdd.getNumPartitions() == 4
    got = np.array(sorted(map(tuple, df.collect())))
    assert np.allclose(got, np.array(sorted(map(tuple, np.column_stack([np.rint((points[:, :3] - h.shift) / h.scale) * h.scale + h.shift, points[:, 3:]])))))
    floor = pointcloud.cell_floor(df, 0.0, 60.0, 10.0)
    assert floor.agg(F.sum("n")).first()[0] == 1000 and floor.where("floor_points < 1 OR floor_points > n").count() == 0
    path.write_bytes(path.read_bytes()[:-30])
    assert pointcloud.read_header(path.read_bytes()[:227], path.stat().st_size).partial
    assert pointcloud.read_points(spark, str(path)).count() == 998


def test_xml_and_report(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, 2, 4, False, 13.888), ("b", 2, 1, 3, False, 8.3), ("c", 2, 3, 3, True, 8.3)], "edge_id string, u int, v int, lanes int, oneway boolean, speed_ms double")
    x = {r._id: r._numLanes for r in sinks.edge_elements(e).collect()}
    assert x == {"a": 2, "b": 1, "c": 3}
    sinks.write_xml(sinks.edge_elements(e), str(tmp_path / "x"), "edges", "edge")
    assert spark.read.format("xml").option("rowTag", "edge").load(str(tmp_path / "x")).count() == 3
    assert sinks.markdown_table(e.where("u = 1").select("edge_id", "speed_ms")).splitlines()[-1] == "| a | 13.89 |"
