"""Live vehicle feeds: latest snapshots, staleness, sliding counts, eased positions, stuck timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SNAPSHOT = "vehicle_id string, trip_id string, route_id string, lat double, lon double, bearing double, speed double, timestamp bigint"
FRESH_S = 90
ALPHA = 0.18


def valid(positions: DataFrame) -> DataFrame:
    """Positions off the null island, with a vehicle."""
    return positions.where("vehicle_id is not null AND (lat <> 0 OR lon <> 0)")


def latest(positions: DataFrame) -> DataFrame:
    """The last report of each vehicle; batch or stream (update or complete mode)."""
    rest = [c for c in positions.columns if c not in ("vehicle_id", "timestamp")]
    return positions.groupBy("vehicle_id").agg(F.max("timestamp").alias("timestamp"), *(F.max_by(c, "timestamp").alias(c) for c in rest))


def retire_unseen(snapshots: DataFrame, polls: DataFrame) -> DataFrame:
    """Rows of the last poll with rows: an empty poll clears nothing."""
    last = polls.where("n > 0").agg(F.max("poll").alias("poll"))
    return snapshots.join(F.broadcast(last), "poll")


def with_status(rows: DataFrame, now: float, at: str = "timestamp") -> DataFrame:
    """age_s and whether a row is live (at most 90 s old); without a report the age is infinite."""
    age = F.coalesce(F.lit(float(now)) - F.col(at), F.lit(float("inf")))
    return rows.withColumn("age_s", age).withColumn("live", age <= FRESH_S)


def sliding_counts(events: DataFrame, ts: str, by: list[str], width: str = "180 seconds", slide: str = "60 seconds", late: str = "45 seconds") -> DataFrame:
    """Counts in sliding windows of event time; batch or stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def tumbling_means(events: DataFrame, ts: str, by: list[str], value: str, width: str = "5 seconds", late: str = "15 seconds") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *by, "n", "mean")


def ease(old: tuple[float, float, float], x: float, y: float, angle: float, alpha: float = ALPHA) -> tuple[float, float, float]:
    """A position moved a share of its way to a new one; the angle takes the shorter arc."""
    turn = (angle - old[2] + 180.0) % 360.0 - 180.0
    return old[0] + alpha * (x - old[0]), old[1] + alpha * (y - old[1]), (old[2] + alpha * turn) % 360.0


GROUPS = 1024  # keys of the states of vehicles; checkpoints depend on it


class Vehicles(StatefulProcessor):
    """What is known of each vehicle of a group: its id first, fields of its own, and when it was last seen (seen), until it
    hasn't been seen for ttl_s of event time. A call for each vehicle would cost more than its rows do; so a batch reads and
    writes the states of every group that it has reports of, and holds these reports, a group at a time."""

    FIELDS, SEEN, OUT = "", 0, ""

    def __init__(self, ttl_s: float):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", f"vehicle_id string, {self.FIELDS}")

    def expiry(self, of: tuple) -> int:
        return int((of[self.SEEN] + self.ttl_s) * 1000)

    def load(self) -> dict[str, tuple]:
        return {vehicle: tuple(of) for vehicle, *of in self.kept.get()}

    def store(self, kept: dict[str, tuple], timer: int | None) -> None:
        """Keeps the vehicles' states and one timer, that of the vehicle which expires first; `timer` is the one set before."""
        first = min(map(self.expiry, kept.values()), default=None)
        if kept:
            self.kept.put([(vehicle, *of) for vehicle, of in kept.items()])
        else:
            self.kept.clear()
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        names, types = zip(*(c.split() for c in self.OUT.split(", ")))
        return pd.DataFrame(out, columns=names).astype({n: {"double": float, "boolean": bool}.get(t, object) for n, t in zip(names, types)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.load()
        timer = min(map(self.expiry, kept.values()), default=None)
        out = self.advance(kept, pd.concat(list(rows)))
        self.store(kept, timer)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, now = self.load(), timerValues.getCurrentWatermarkInMs()
        gone = {vehicle: kept.pop(vehicle) for vehicle in [v for v, of in kept.items() if self.expiry(of) <= now]}
        self.store(kept, None)  # the timer that went off is deleted after this call
        yield self.frame(self.retire(gone))

    def advance(self, kept: dict[str, tuple], reports: pd.DataFrame) -> list[tuple]:
        """Rows that reports give; kept is changed in place."""
        raise NotImplementedError

    def retire(self, gone: dict[str, tuple]) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


def grouped(stream: DataFrame, columns: list[str], states: Vehicles, late_s: float) -> DataFrame:
    """A stream of reports with t in seconds, through the states of its vehicles, which share GROUPS keys."""
    s = stream.select("vehicle_id", *columns, F.timestamp_seconds("t").alias("_ts"), F.pmod(F.hash("vehicle_id"), F.lit(GROUPS)).alias("_group"))
    return s.withWatermark("_ts", f"{late_s} seconds").groupBy("_group").transformWithStateInPandas(states, states.OUT, "append", "eventTime")


class Tracker(Vehicles):
    """One eased position a vehicle."""

    FIELDS, SEEN, OUT = "t double, x double, y double, angle double", 0, "vehicle_id string, t double, x double, y double, angle double, retired boolean"

    def __init__(self, alpha: float, ttl_s: float):
        super().__init__(ttl_s)
        self.alpha = alpha

    def advance(self, kept: dict[str, tuple], reports: pd.DataFrame) -> list[tuple]:
        out = []
        frame = reports.sort_values(["t", "x", "y", "angle"], kind="stable")
        for vehicle, t, x, y, a in zip(*(frame[c].tolist() for c in ("vehicle_id", "t", "x", "y", "angle"))):
            seen, *now = kept.get(vehicle, (None,))
            if seen is not None and t < seen:
                continue
            if seen is not None and t >= seen + self.ttl_s:  # as its timer would, had the watermark come first
                out.append((vehicle, seen + self.ttl_s, *now, True))
                now = None
            now = ease(now, x, y, a, self.alpha) if now else (x, y, a)
            kept[vehicle] = (t, *now)
            out.append((vehicle, t, *now, False))
        return out

    def retire(self, gone: dict[str, tuple]) -> list[tuple]:
        return [(vehicle, t + self.ttl_s, *at, True) for vehicle, (t, *at) in gone.items()]


def tracked_positions(stream: DataFrame, alpha: float = ALPHA, ttl_s: float = FRESH_S, late_s: float = 30) -> DataFrame:
    """Eased positions of a stream of (vehicle_id, t seconds, x, y, angle), one row per report, and a last row (retired) for a
    vehicle that no report has come from for ttl_s of event time; its state is then gone, and a later report begins anew.

    Reports more than late_s behind the stream are dropped, and so are those older than the vehicle's last one; of one time
    they are taken by x, y and angle. The store of states must be RocksDB (rocksdb_states)."""
    return grouped(stream, ["t", "x", "y", "angle"], Tracker(alpha, ttl_s), late_s)


class Standing(Vehicles):
    """Since when each vehicle has stood; nothing is kept of one that moves."""

    FIELDS, SEEN, OUT = "since double, last double", 1, "vehicle_id string, t double, stood_s double"

    def __init__(self, slow: float, after_s: float, ttl_s: float):
        super().__init__(ttl_s)
        self.slow, self.after_s = slow, after_s

    def advance(self, kept: dict[str, tuple], reports: pd.DataFrame) -> list[tuple]:
        out = []
        frame = reports.sort_values(["t", "speed_ms"], kind="stable")
        for vehicle, t, v in zip(*(frame[c].tolist() for c in ("vehicle_id", "t", "speed_ms"))):
            since, last = kept.get(vehicle, (None, None))
            if v >= self.slow:
                kept.pop(vehicle, None)
                continue
            since = t if since is None or t >= last + self.ttl_s else since
            if t - since >= self.after_s:
                out.append((vehicle, t, t - since))
                since = t
            kept[vehicle] = (since, t)
        return out


def stuck_resets(stream: DataFrame, slow: float = 0.12, after_s: float = 8.0, ttl_s: float = 3600, late_s: float = 30) -> DataFrame:
    """An event each time a vehicle has stood for after_s seconds: vehicle_id, t, stood_s; the timer then begins anew.

    A vehicle that stands but isn't reported for ttl_s is forgotten. Reports more than late_s behind the stream are dropped."""
    return grouped(stream, ["t", "speed_ms"], Standing(slow, after_s, ttl_s), late_s)


@contextmanager
def rocksdb_states(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their states in RocksDB, which states with timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
