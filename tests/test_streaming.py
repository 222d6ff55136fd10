from pyspark.sql import functions as F

from cityweave.streaming import live

DATA = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def events(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.select("ts", "user_id", "value").repartition(4).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema("ts timestamp, user_id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_windows_equal_their_batch_twins(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    for fn, args in ((live.sliding_counts, (["user_id"], "2 hours", "1 hour", "60 days")), (live.tumbling_means, (["user_id"], "value", "1 hour", "60 days"))):
        got = run(fn(stream, "ts", *args), fn.__name__, "complete")
        want = fn(batch, "ts", *args)
        key = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=str)
        assert key(got) == key(want)


def test_latest_status_retire(spark):
    rows = [("a", "t", "r", 1.0, 1.0, 0.0, 1.0, 100), ("a", "t", "r", 2.0, 1.0, 0.0, 1.0, 150), ("b", "t", "r", 0.0, 0.0, 0.0, 0.0, 90), (None, "t", "r", 5.0, 1.0, 0.0, 1.0, 90), ("c", "t", "r", 5.0, 1.0, 0.0, 1.0, None)]
    p = spark.createDataFrame(rows, live.SNAPSHOT)
    got = {r.vehicle_id: r for r in live.with_status(live.latest(live.valid(p)), 200).collect()}
    assert set(got) == {"a", "c"} and got["a"].lat == 2.0 and got["a"].live and got["a"].age_s == 50
    assert got["c"].age_s == float("inf") and not got["c"].live
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "poll int, vehicle_id string")
    polls = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "poll int, n int")
    assert [r.vehicle_id for r in live.retire_unseen(snap, polls).collect()] == ["b"]


def through(stream, path):
    with live.rocksdb_states(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/states").trigger(availableNow=True).start()
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def reports(spark, folder, rows):
    """Each list of rows a file of its own, in this order."""
    for part in rows:
        spark.createDataFrame(part, "vehicle_id string, t double, x double, y double, angle double, speed_ms double").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("vehicle_id string, t double, x double, y double, angle double, speed_ms double").option("maxFilesPerTrigger", 1).parquet(folder)


def test_tracked_positions_across_batches(spark, tmp_path):
    rows = [("v", 1000.0 + t, 10.0 * t, 0.0, 350.0 if t == 0 else 10.0, 5.0) for t in range(0, 22, 2)]
    got = through(live.tracked_positions(reports(spark, str(tmp_path / "in"), [rows[:4], rows[4:8], rows[8:]])), str(tmp_path)).orderBy("t").collect()
    pos, want = (0.0, 0.0, 350.0), [(0.0, 0.0, 350.0)]
    for t in range(2, 22, 2):
        pos = live.ease(pos, 10.0 * t, 0.0, 10.0)
        want.append(pos)
    assert [(r.x, r.y, r.angle) for r in got] == want and abs(want[1][2] - 353.6) < 1e-9


def test_unseen_vehicles_lose_their_state_and_late_rows_go(spark, tmp_path):
    r = lambda v, t, x=0.0: (v, 1000.0 + t, x, 0.0, 0.0, 0.0)
    parts = [[r("a", 0, 5.0), r("b", 0)], [r("b", 200)], [r("b", 400)], [r("a", 401, 9.0), r("b", 300), r("c", 10), r("a", 402, 9.0)]]
    got = through(live.tracked_positions(reports(spark, str(tmp_path / "in"), parts), ttl_s=90, late_s=30), str(tmp_path))
    rows = sorted((x.vehicle_id, x.t - 1000, x.x, x.retired) for x in got.collect())
    # a is retired at 90 and begins anew at 401, not eased from 5; b's row of 300 and c's of 10 are late; b is retired between
    assert [x for x in rows if x[0] == "a"] == [("a", 0.0, 5.0, False), ("a", 90.0, 5.0, True), ("a", 401.0, 9.0, False), ("a", 402.0, 9.0, False)]
    assert [x[1:] for x in rows if x[0] == "b"] == [(0.0, 0.0, False), (90.0, 0.0, True), (200.0, 0.0, False), (290.0, 0.0, True), (400.0, 0.0, False)]
    assert not [x for x in rows if x[0] == "c"]


def test_stuck_resets_across_batches(spark, tmp_path):
    rows = [("v", 1000.0 + t, 0.0, 0.0, 0.0, 0.0 if t > 1 else 5.0) for t in range(0, 22, 2)]
    got = through(live.stuck_resets(reports(spark, str(tmp_path / "in"), [rows[:4], rows[4:8], rows[8:]])), str(tmp_path)).orderBy("t").collect()
    assert [(r.t - 1000, r.stood_s) for r in got] == [(10.0, 8.0), (18.0, 8.0)]
    gone = [[("v", 1000.0, 0.0, 0.0, 0.0, 0.0)], [("w", 9000.0, 0.0, 0.0, 0.0, 0.0)], [("w", 9500.0, 0.0, 0.0, 0.0, 5.0), ("v", 9501.0, 0.0, 0.0, 0.0, 0.0)]]
    assert through(live.stuck_resets(reports(spark, str(tmp_path / "in2"), gone), ttl_s=60), str(tmp_path / "2")).count() == 0  # v was forgotten


def test_many_vehicles_share_groups_and_keep_their_own_states(spark, tmp_path):
    r = lambda v, t, x=0.0: (f"v{v}", 1000.0 + t, x, 0.0, 0.0, 0.0)
    n = 3 * live.GROUPS  # odd ones are retired after the third batch, every other even one after the fifth
    parts = [[r(v, 0) for v in range(n)], [r(v, 10, 100.0) for v in range(0, n, 2)], [r(-1, 125)], [r(v, 97, 100.0) for v in range(0, n, 4)], [r(-1, 131)]]
    stream = live.tracked_positions(reports(spark, str(tmp_path / "in"), parts))
    with live.rocksdb_states(spark):
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/states").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").where("vehicle_id <> 'v-1'").collect()
    want = [(f"v{v}", 0.0, 0.0, False) for v in range(n)] + [(f"v{v}", 90.0, 0.0, True) for v in range(1, n, 2)] + [(f"v{v}", 10.0, 18.0, False) for v in range(0, n, 2)]
    want += [(f"v{v}", 97.0, 32.76, False) for v in range(0, n, 4)] + [(f"v{v}", 100.0, 18.0, True) for v in range(2, n, 4)]
    assert sorted((x.vehicle_id, x.t - 1000, round(x.x, 9), x.retired) for x in got) == sorted(want)
    timers = [int(p.stateOperators[0].customMetrics["numRegisteredTimers"]) for p in q.recentProgress if p.stateOperators]
    assert 0 < max(timers) <= live.GROUPS  # calls to the store follow the groups, not the vehicles
