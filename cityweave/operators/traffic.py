"""Vehicles on paths: order, leaders, junctions, queues."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions import emissions as em
from cityweave.functions.motion import congestion, idm_acceleration


def leaders(agents: DataFrame, by: list[str], own_length: float = 4.5) -> DataFrame:
    """leader_id, gap (at least 0.1) and dv to the next vehicle ahead on the path; null for the first one."""
    w = Window.partitionBy(*by).orderBy("dist", "agent_id")
    ahead = lambda c: F.lead(c).over(w)
    return agents.withColumn("leader_id", ahead("agent_id")).withColumn("gap", F.when(ahead("dist").isNotNull(), F.greatest(F.lit(0.1), ahead("dist") - F.col("dist") - own_length))).withColumn("dv", F.when(ahead("dist").isNotNull(), F.col("speed_ms") - F.greatest(F.lit(0.0), ahead("speed_ms"))))


def front_vehicle(agents: DataFrame, by: list[str]) -> DataFrame:
    """The vehicle farthest along each path (ties: the larger id)."""
    return agents.groupBy(*by).agg(F.max(F.struct("dist", "agent_id", "speed_ms")).alias("x")).select(*by, F.col("x.agent_id").alias("agent_id"), F.col("x.dist").alias("dist"), F.col("x.speed_ms").alias("speed_ms"))


def next_path_leader(front: DataFrame, rear: DataFrame, succ: DataFrame, paths: DataFrame, own_length: float = 4.5) -> DataFrame:
    """For each path's front vehicle the least gap to the rear vehicle of a following path: way to the end plus its place."""
    j = front.join(paths.select("path_id", "length"), "path_id").join(succ, F.col("path_id") == F.col("from_path"))
    r = rear.select(F.col("path_id").alias("to_path"), F.col("dist").alias("_d"))
    gap = F.greatest(F.lit(0.1), F.col("length") - F.col("dist") + F.col("_d") - own_length)
    return j.join(r, "to_path").withColumn("gap", gap).groupBy("path_id", "agent_id").agg(F.min(F.struct("gap", "to_path")).alias("x")).select("path_id", "agent_id", F.col("x.gap").alias("gap"), F.col("x.to_path").alias("to_path"))


def junction_rank(front: DataFrame, to_node: str, to_end: str, within: float = 20.0, by: list[str] | None = None) -> DataFrame:
    """Front vehicles near a node ranked by their way to it; all but the first give way."""
    w = Window.partitionBy(*(by or []), to_node).orderBy(to_end, "agent_id")
    return front.where(F.col(to_end) <= within).withColumn("rank", F.row_number().over(w)).withColumn("yields", F.col("rank") > 1)


def stopline_gap(agents: DataFrame, to_stop: str, red: str, s0: float = 2.0) -> DataFrame:
    """The gap with a standing vehicle put at a red stop line, if that is nearer; a vehicle that stands at the line has none."""
    ghost = F.greatest(F.lit(0.1), F.col(to_stop) - s0)
    at = F.col(red) & (F.col(to_stop) <= 1e-3)
    return agents.withColumn("gap", F.when(at, F.lit(None).cast("double")).when(F.col(red), F.least(F.coalesce("gap", ghost), ghost)).otherwise(F.col("gap"))).withColumn("at_stop", at)


def accelerations(with_leaders: DataFrame, desired: str) -> DataFrame:
    return with_leaders.withColumn("accel", idm_acceleration(F.col("speed_ms"), F.col(desired), F.col("gap"), F.coalesce("dv", F.lit(0.0))))


def stuck_spells(samples: DataFrame, agent: str, t: str, slow: float = 0.12, least_s: float = 8.0, ties: str = "row_id") -> DataFrame:
    """Spells of consecutive slow samples: agent, start, end, seconds, samples; those of at least least_s."""
    w = Window.partitionBy(agent).orderBy(t, ties)
    s = samples.withColumn("_slow", F.col("speed_ms") < slow).withColumn("_n", F.row_number().over(w))
    s = s.where("_slow").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return s.groupBy(agent, "_g").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("samples")).withColumn("seconds", F.col("end") - F.col("start")).where(F.col("seconds") >= least_s).drop("_g")


def rising_edges(samples: DataFrame, agent: str, t: str, on: str, ties: str = "row_id") -> DataFrame:
    """How often a flag goes on, per agent; a first sample that is on counts."""
    was = F.lag(on, 1, False).over(Window.partitionBy(agent).orderBy(t, ties))
    return samples.withColumn("_rise", (F.col(on) & ~was).cast("int")).groupBy(agent).agg(F.sum("_rise").alias("rises"))


def path_congestion(agents: DataFrame, by: list[str], free_flow: float = 13.9) -> DataFrame:
    """Mean speed, number of vehicles and congestion class of each path that has some."""
    return agents.groupBy(*by).agg(F.avg("speed_ms").alias("mean_speed_ms"), F.count("*").alias("n")).withColumn("state", congestion(F.col("mean_speed_ms"), F.lit(free_flow)))


def fleet_health(agents: DataFrame, by: list[str], desired: str, own_length: float = 4.5, a_max: float = 1.5) -> DataFrame:
    """One row per path: vehicles, overlaps, least gap, variance of acceleration, share stopped, free and queued counts."""
    a = leaders(agents, by, 0.0).withColumn("_clear", F.when(F.col("leader_id").isNotNull(), F.lead("dist").over(Window.partitionBy(*by).orderBy("dist", "agent_id")) - F.col("dist") - own_length))
    v, d = F.col("speed_ms"), F.col(desired)
    count = lambda c: F.sum(c.cast("long"))
    return a.groupBy(*by).agg(
        F.count("*").alias("n"), count(v < 0).alias("negative"), count(v > d + 0.05).alias("overspeed"), F.coalesce(count(F.col("_clear") < 0), F.lit(0)).alias("overlaps"), F.min("_clear").alias("least_gap"),
        (F.avg((v < 0.1).cast("double")) >= 0.9).alias("gridlock"), count(v > 0.85 * d).alias("free"), count(v < 0.30 * d).alias("queued"),
    )


def rolling_count(ticks: DataFrame, by: list[str], tick: str, n: str, width: int = 180) -> DataFrame:
    """Sum of n over the last `width` ticks, this one included."""
    w = Window.partitionBy(*by).orderBy(tick).rangeBetween(-(width - 1), 0)
    return ticks.withColumn("rolling", F.sum(n).over(w))


def ema(series: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average from 0 at each step of each group.

    A step weighs (1 - alpha) to the power of its age; beyond the frame that is under 1e-17, less than a double holds."""
    frame = math.ceil(math.log(1e-17) / math.log(1 - alpha)) if alpha < 1 else 0
    w = Window.partitionBy(*by).orderBy(order, value).rowsBetween(-frame, 0)
    fold = F.aggregate(F.collect_list(F.col(value).cast("double")).over(w), F.lit(0.0), lambda acc, x: alpha * x + (1 - alpha) * acc)
    return series.select(*by, order, value, fold.alias("ema"))


def noise_grid(vehicles: DataFrame, cells: DataFrame, reference_db: float) -> DataFrame:
    """db at each cell (cx, cy) of a small grid from all vehicles (x, y, speed_ms).

    Sound energy falls with the square of the distance (at least 1 m), so the vehicles of one place are added up before
    they meet the grid, and no logarithm is taken per pair.
    """
    energy = F.pow(F.lit(10.0), em.source_level(F.col("speed_ms"), reference_db) / 10)
    places = vehicles.groupBy("x", "y").agg(F.sum(energy).alias("_e"))
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    j = places.crossJoin(F.broadcast(cells))  # a noise grid has 40,000 cells at most
    return j.groupBy("cx", "cy").agg(em.energy_level(F.sum(F.col("_e") / F.greatest(dx * dx + dy * dy, F.lit(1.0)))).alias("db"))


def noise_grid_size(width: float, height: float, cell: float = 25.0, most: int = 40_000) -> float:
    """Cell size, grown by half until the grid has at most `most` cells."""
    while (max(width, 1.0) / cell) * (max(height, 1.0) / cell) > most:
        cell *= 1.5
    return cell


def speed_caps(agents: DataFrame, crossings: DataFrame, emergencies: DataFrame) -> DataFrame:
    """cap_ms: 1.4 within 12 m of a crossing (crossing_id, px, py), 0.5 within 30 m of an emergency (unit_id, px, py), the lower of both."""
    from cityweave.operators.spatial import within

    a = agents.select("agent_id", "x", "y")
    slow = within(a, crossings, 12.0, strict=True).select("agent_id").distinct().withColumn("_c", F.lit(1.4))
    stop = within(a, emergencies, 30.0, strict=True).select("agent_id").distinct().withColumn("_e", F.lit(0.5))
    return agents.join(slow, "agent_id", "left").join(stop, "agent_id", "left").withColumn("cap_ms", F.least("_c", "_e")).drop("_c", "_e")


def recycle_pick(agents: DataFrame, by: list[str], idle: str, selected: str, x: float, y: float) -> DataFrame:
    """The vehicle to reuse in each group: idle ones first, then the farthest from a point; selected ones never."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    key = F.struct(F.col(idle).cast("int").alias("i"), d.alias("d"), F.col("agent_id").alias("a"))
    return agents.where(~F.col(selected)).groupBy(*by).agg(F.max(key).alias("k")).select(*by, F.col("k.a").alias("agent_id"))


def kpis(samples: DataFrame, by: list[str], t: str) -> DataFrame:
    """Per step: running vehicles, arrivals so far, mean time loss and waiting (over at least one vehicle)."""
    g = samples.groupBy(*by, t).agg(F.count_if(~F.col("arrived")).alias("running"), F.count_if("arrived").alias("_a"), F.try_divide(F.sum("time_loss"), F.greatest(F.count("*"), F.lit(1))).alias("mean_time_loss"), F.try_divide(F.sum("waiting"), F.greatest(F.count("*"), F.lit(1))).alias("mean_waiting"))
    w = Window.partitionBy(*by).orderBy(t)
    return g.withColumn("arrived_total", F.sum("_a").over(w)).drop("_a")


def safety_totals(events: DataFrame, by: list[str], severe: float = 8.3) -> DataFrame:
    """injuries, severe ones (from 8.3 m/s), and people exposed of collision events (ped_id, impact)."""
    hit = F.col("impact").isNotNull()
    return events.groupBy(*by).agg(F.count_if(hit).alias("injuries"), F.count_if(F.col("impact") >= severe).alias("severe"), F.count_distinct("ped_id").alias("exposed"))


def label_counts(rows: DataFrame, cls: str, labels: dict[str, str], order: list[str]) -> DataFrame:
    """position, label, n: counts by display label (an unknown class keeps its name), labels in a fixed order, then the rest."""
    from cityweave.functions.parse import lookup

    g = rows.groupBy(F.coalesce(lookup(F.col(cls), labels), F.col(cls)).alias("label")).agg(F.count("*").alias("n"))
    at = F.coalesce(lookup(F.col("label"), {k: i for i, k in enumerate(order)}), F.lit(len(order)))
    return g.withColumn("position", F.row_number().over(Window.orderBy(at, "label")))  # one row for each label


def rain_intervals(series: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """t0, t1, value of consecutive rows, where the value is positive and lasts over 0.01."""
    w = Window.partitionBy(*by).orderBy(t)
    return series.withColumn("t1", F.lead(t).over(w)).where((F.col(value) > 0) & (F.col("t1") - F.col(t) > 0.01)).select(*by, F.col(t).alias("t0"), "t1", F.col(value).alias("value"))
