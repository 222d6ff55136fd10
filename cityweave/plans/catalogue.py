"""The registered queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions import emissions as em
from cityweave.functions import motion, parse, raster, solar
from cityweave.operators import flood, grids, metrics, network, spatial, traffic
from cityweave.plans.registry import Views, query


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# SQL pieces of the emission law, written out once
_M = {p: "CASE vclass " + " ".join(f"WHEN '{c}' THEN {v[k]}" for c, v in em.VEHICLE_CLASS.items()) + " ELSE 1.0 END" for k, p in enumerate(em.POLLUTANTS)}
_FUEL = "CASE vclass " + " ".join(f"WHEN '{c}' THEN {em.CO2_PER_LITRE[v[3]]}" for c, v in em.VEHICLE_CLASS.items()) + " ELSE 2310.0 END"
_K = "greatest(speed_ms * 3.6, 3.0)"
_SHAPE = f"(1 + greatest(0.0, 0.95 * (65.0 / {_K} - 1)) + 0.55 * power(({_K} - 65.0) / 65.0, 2))"
_EF = {"co2": f"5.5 * {_M['co2']} * {_SHAPE} / 100 * {_FUEL}", "nox": f"0.06 * {_M['nox']} * {_SHAPE}", "pm": f"0.003 * {_M['pm']} * {_SHAPE}"}
_RATE = {p: f"CASE WHEN speed_ms < 0.3 THEN {em.IDLE[p]:.5f} * {_M[p]} ELSE {_EF[p]} * greatest(speed_ms * 3.6, 0) / 3600 + {em.IDLE[p]:.5f} * {_M[p]} * 0.2 END" for p in em.POLLUTANTS}


def totals_by_run(v: Views) -> DataFrame:
    sums = [F.sum(em.rate_g_s(p, F.col("speed_ms"), F.col("vclass"))).alias(p) for p in em.POLLUTANTS]
    return v.veh.groupBy("run").agg(*sums, F.avg("speed_ms").alias("mean_speed"), F.count("*").cast("double").alias("samples"))


_TOTALS = f"SELECT run, sum({_RATE['co2']}) AS co2, sum({_RATE['nox']}) AS nox, sum({_RATE['pm']}) AS pm, avg(speed_ms) AS mean_speed, CAST(count(*) AS DOUBLE) AS samples FROM veh GROUP BY run"


@query(f"""WITH t AS ({_TOTALS}), l AS (UNPIVOT t ON co2, nox, pm, mean_speed, samples INTO NAME metric VALUE value)
SELECT metric, round(max(value) FILTER (run = 0), 4) AS a, round(max(value) FILTER (run = 1), 4) AS b, round(max(value) FILTER (run = 1) - max(value) FILTER (run = 0), 4) AS delta,
round(100 * (max(value) FILTER (run = 1) - max(value) FILTER (run = 0)) / max(value) FILTER (run = 0), 4) AS delta_pct FROM l GROUP BY metric""", "veh")
def scenario_comparison(v: Views) -> DataFrame:
    return rounded(metrics.compare_totals(totals_by_run(v), "run", [*em.POLLUTANTS, "mean_speed", "samples"], 0, 1), 4)


@query("SELECT run, round(co2, 4) AS co2, round(nox, 6) AS nox, round(pm, 6) AS pm FROM (" + _TOTALS + ")", "veh")
def emission_totals_by_run(v: Views) -> DataFrame:
    return totals_by_run(v).select("run", r("co2", 4), r("nox"), r("pm"))


@query(f"SELECT row_id, round({_EF['co2']}, 6) AS co2_g_km, round({_RATE['nox']}, 9) AS nox_g_s FROM veh", "veh")
def emission_factors(v: Views) -> DataFrame:
    s, c = F.col("speed_ms"), F.col("vclass")
    return v.veh.select("row_id", F.round(em.factor_g_km("co2", s, c), 6).alias("co2_g_km"), F.round(em.rate_g_s("nox", s, c), 9).alias("nox_g_s"))


@query(f"SELECT vclass, CAST(count(*) AS BIGINT) AS n, round(sum({_RATE['co2']} * 5), 4) AS co2_g, round(sum({_RATE['pm']} * 5), 6) AS pm_g FROM veh GROUP BY vclass", "veh")
def emissions_by_class(v: Views) -> DataFrame:
    s, c = F.col("speed_ms"), F.col("vclass")
    return v.veh.groupBy("vclass").agg(F.count("*").alias("n"), F.round(F.sum(em.rate_g_s("co2", s, c) * 5), 4).alias("co2_g"), F.round(F.sum(em.rate_g_s("pm", s, c) * 5), 6).alias("pm_g"))


def noise_cells(v: Views, reference: float) -> DataFrame:
    grid = v.spark.range(400).select((F.col("id") % 20 * 50 + 25).cast("double").alias("cx"), (F.floor(F.col("id") / 20) * 50 + 25).cast("double").alias("cy"))
    return traffic.noise_grid(v.veh, grid, reference)


def _noise_sql(reference: float) -> str:
    return f"""SELECT cx, cy, 10 * log10(greatest(sum(pow(10, ({reference} + 10 * log10(greatest(speed_ms * 3.6, 1.0) / 50.0) - 20 * log10(greatest(sqrt(pow(cx - x, 2) + pow(cy - y, 2)), 1.0))) / 10)), 1e-12)) AS db
FROM veh, (SELECT CAST(range % 20 * 50 + 25 AS DOUBLE) AS cx, CAST(range // 20 * 50 + 25 AS DOUBLE) AS cy FROM range(400)) GROUP BY cx, cy"""


@query(f"SELECT cx, cy, round(db, 6) AS db FROM ({_noise_sql(55.0)})", "veh")
def noise_energy_sum(v: Views) -> DataFrame:
    return rounded(noise_cells(v, 55.0))


@query(f"SELECT CAST(count(*) FILTER (db > 65) * 5.0 AS DOUBLE) AS cell_seconds, CAST(count(*) FILTER (db >= 45) AS BIGINT) AS shown, round(max(db), 6) AS loudest FROM ({_noise_sql(85.0)})", "veh")
def noise_exceedance(v: Views) -> DataFrame:
    return noise_cells(v, 85.0).agg((F.count_if(F.col("db") > 65) * 5.0).alias("cell_seconds"), F.count_if(F.col("db") >= 45).alias("shown"), F.round(F.max("db"), 6).alias("loudest"))


_MEAN_TT = "SELECT run, edge_id, avg(tt) AS tt FROM runs GROUP BY run, edge_id"


@query(f"""WITH m AS ({_MEAN_TT}) SELECT a.edge_id, round(a.tt, 6) AS a, round(b.tt, 6) AS b, round(b.tt - a.tt, 6) AS delta, round(CASE WHEN abs(a.tt) > 1e-9 THEN 100 * (b.tt - a.tt) / a.tt END, 6) AS delta_pct
FROM m a JOIN m b ON a.edge_id = b.edge_id AND a.run = 'A' AND b.run = 'B'""", "runs")
def scenario_edge_delta(v: Views) -> DataFrame:
    m = v.runs.groupBy("run", "edge_id").agg(F.avg("tt").alias("tt"))
    return rounded(metrics.compare_runs(m.where("run = 'A'"), m.where("run = 'B'"), "edge_id", "tt"))


@query("SELECT edge_id, round(sum(tt) / (SELECT count(DISTINCT edge_id) FROM runs), 9) AS tt FROM runs GROUP BY edge_id", "runs")
def edge_tt_time_mean(v: Views) -> DataFrame:
    n = v.runs.agg(F.count_distinct("edge_id").alias("n"))
    return v.runs.groupBy("edge_id").agg(F.sum("tt").alias("s")).crossJoin(F.broadcast(n)).select("edge_id", F.round(F.col("s") / F.col("n"), 9).alias("tt"))


@query("SELECT list_sort(list(DISTINCT a.edge_id)) IS NOT NULL AS ok, CAST(count(DISTINCT a.edge_id) AS BIGINT) AS shared FROM runs a JOIN runs b ON a.edge_id = b.edge_id AND a.run = 'A' AND b.run = 'B'", "runs")
def shared_edges(v: Views) -> DataFrame:
    a, b = (v.runs.where(F.col("run") == k).select("edge_id") for k in "AB")
    return a.intersect(b).agg(F.lit(True).alias("ok"), F.count("*").alias("shared"))


_TT = """CAST(count(*) AS BIGINT) AS n, round(avg(abs(sim_s - ref_s) / greatest(ref_s, 1e-6)) * 100, 6) AS mape_pct, round(sqrt(avg(power(sim_s - ref_s, 2))), 6) AS rmse_s, round(avg(sim_s - ref_s), 6) AS bias_s,
round(corr(sim_s, ref_s), 6) AS pearson_r, round(avg(CASE WHEN sqrt(2 * power(sim_s - ref_s, 2) / greatest(sim_s + ref_s, 1e-6)) < 5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS geh_under5_pct, round(avg(sim_s), 6) AS sim_mean_s, round(avg(ref_s), 6) AS ref_mean_s"""


@query(f"SELECT {_TT} FROM pairs", "pairs")
def tt_metrics_overall(v: Views) -> DataFrame:
    return rounded(metrics.travel_time_metrics(v.pairs, "sim_s", "ref_s"))


@query(f"SELECT class, {_TT} FROM pairs GROUP BY class", "pairs")
def tt_metrics_by_class(v: Views) -> DataFrame:
    return rounded(metrics.travel_time_metrics(v.pairs, "sim_s", "ref_s", ["class"]))


@query("""SELECT class, CAST(count(*) AS BIGINT) AS n, round(avg(sim_s), 6) AS mean, round(quantile_cont(sim_s, 0.5), 6) AS p50, round(quantile_cont(sim_s, 0.95), 6) AS p95, round(max(sim_s), 6) AS max, round(sum(sim_s), 6) AS total FROM pairs GROUP BY class""", "pairs")
def timing_distribution(v: Views) -> DataFrame:
    return rounded(metrics.distribution(v.pairs, "sim_s", ["class"]))


@query("SELECT pair_id, class, sim_s, ref_s FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.class = p.class AND q.sim_s <= p.sim_s AND q.ref_s <= p.ref_s AND (q.sim_s < p.sim_s OR q.ref_s < p.ref_s))", "pairs")
def pareto_skyline(v: Views) -> DataFrame:
    return metrics.skyline(v.pairs, ["class"], "sim_s", "ref_s").select("pair_id", "class", "sim_s", "ref_s")


@query("""WITH ids AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) || CAST(l_partkey AS VARCHAR) AS rid FROM lineitem), k AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS key FROM supplier)
SELECT rid, arg_max(key, length(key)) AS key FROM ids JOIN k ON starts_with(rid, key) GROUP BY rid""")
def prefix_longest_match(v: Views) -> DataFrame:
    ids = v.lineitem.select(F.concat(F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("rid")).distinct()
    return metrics.prefix_match(ids, v.supplier.select(F.col("s_suppkey").cast("string").alias("key")), "rid", "key")


# vehicles on paths: the place along the path is x
def agents(v: Views) -> DataFrame:
    return v.veh.select("run", "path_id", "tick", F.col("row_id").alias("agent_id"), F.col("x").alias("dist"), "speed_ms", "vehicle_id", "t_s")


_AG = "ag AS (SELECT run, path_id, tick, row_id AS agent_id, x AS dist, speed_ms, vehicle_id, t_s FROM veh)"
_W = "OVER (PARTITION BY run, path_id ORDER BY dist, agent_id)"
_LEAD = f"ld AS (SELECT *, lead(agent_id) {_W} AS leader_id, CASE WHEN lead(dist) {_W} IS NOT NULL THEN greatest(0.1, lead(dist) {_W} - dist - 4.5) END AS gap, CASE WHEN lead(dist) {_W} IS NOT NULL THEN speed_ms - greatest(0.0, lead(speed_ms) {_W}) END AS dv FROM ag)"


@query(f"WITH {_AG}, {_LEAD} SELECT agent_id, leader_id, round(gap, 6) AS gap, round(dv, 6) AS dv FROM ld", "veh")
def leader_gap(v: Views) -> DataFrame:
    return rounded(traffic.leaders(agents(v), ["run", "path_id"]).select("agent_id", "leader_id", "gap", "dv"))


@query(f"""WITH {_AG}, {_LEAD} SELECT agent_id, round(least(greatest(1.5 * (1 - power(speed_ms / 13.9, 4) - CASE WHEN gap IS NULL THEN 0 ELSE power((2 + greatest(0.0, speed_ms * 1.5 + speed_ms * dv / (2 * sqrt(3.75)))) / gap, 2) END), -7.5), 1.5), 6) AS accel FROM ld""", "veh")
def idm_accel(v: Views) -> DataFrame:
    led = traffic.leaders(agents(v), ["run", "path_id"]).withColumn("desired", F.lit(13.9))
    return rounded(traffic.accelerations(led, "desired").select("agent_id", "accel"))


@query(f"WITH {_AG} SELECT run, path_id, arg_max(agent_id, dist * 1e9 + agent_id) AS agent_id, max(dist) AS dist FROM ag GROUP BY run, path_id", "veh")
def front_vehicle(v: Views) -> DataFrame:
    return traffic.front_vehicle(agents(v), ["run", "path_id"]).select("run", "path_id", "agent_id", "dist")


@query(f"""WITH {_AG}, f AS (SELECT run, path_id, path_id % 5 AS node, agent_id, 1000 - dist AS to_end, row_number() OVER (PARTITION BY run, path_id ORDER BY dist DESC, agent_id DESC) AS k FROM ag)
SELECT agent_id, node, to_end, row_number() OVER (PARTITION BY run, node ORDER BY to_end, agent_id) AS rank, row_number() OVER (PARTITION BY run, node ORDER BY to_end, agent_id) > 1 AS yields FROM f WHERE k = 1 AND to_end <= 20""", "veh")
def junction_conflict_rank(v: Views) -> DataFrame:
    front = traffic.front_vehicle(agents(v), ["run", "path_id"]).withColumn("node", F.col("path_id") % 5).withColumn("to_end", 1000 - F.col("dist"))
    return traffic.junction_rank(front, "node", "to_end", 20.0, ["run"]).select("agent_id", "node", "to_end", F.col("rank").cast("long").alias("rank"), "yields")


@query(f"""WITH {_AG}, n AS (SELECT *, row_number() OVER w AS k, speed_ms < 5 AS slow FROM ag WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_s, agent_id)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY vehicle_id ORDER BY t_s, agent_id) AS g FROM n WHERE slow)
SELECT vehicle_id, min(t_s) AS start, max(t_s) AS "end", CAST(count(*) AS BIGINT) AS samples, max(t_s) - min(t_s) AS seconds FROM g GROUP BY vehicle_id, g HAVING max(t_s) - min(t_s) >= 8""", "veh")
def stuck_islands(v: Views) -> DataFrame:
    return traffic.stuck_spells(agents(v), "vehicle_id", "t_s", slow=5.0, ties="agent_id")


@query("SELECT vehicle_id, CAST(sum(CASE WHEN on_ AND NOT was THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM (SELECT vehicle_id, speed_ms > 10 AS on_, lag(speed_ms > 10, 1, false) OVER (PARTITION BY vehicle_id ORDER BY t_s, row_id) AS was FROM veh) GROUP BY vehicle_id", "veh")
def rising_edge_count(v: Views) -> DataFrame:
    return traffic.rising_edges(v.veh.withColumn("on", F.col("speed_ms") > 10), "vehicle_id", "t_s", "on")


@query("SELECT run, path_id, round(avg(speed_ms), 6) AS mean_speed_ms, CAST(count(*) AS BIGINT) AS n, CASE WHEN avg(speed_ms) / 13.9 > 0.8 THEN 'free' WHEN avg(speed_ms) / 13.9 > 0.5 THEN 'slowing' ELSE 'jammed' END AS state FROM veh GROUP BY run, path_id", "veh")
def path_congestion(v: Views) -> DataFrame:
    return rounded(traffic.path_congestion(v.veh, ["run", "path_id"]))


@query(f"""WITH {_AG}, c AS (SELECT *, lead(dist) {_W} - dist - 4.5 AS clear FROM ag)
SELECT run, path_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (speed_ms > 13.95) AS BIGINT) AS overspeed, CAST(count(*) FILTER (clear < 0) AS BIGINT) AS overlaps, round(min(clear), 6) AS least_gap,
avg(CASE WHEN speed_ms < 0.1 THEN 1.0 ELSE 0.0 END) >= 0.9 AS gridlock, CAST(count(*) FILTER (speed_ms > 0.85 * 13.9) AS BIGINT) AS free, CAST(count(*) FILTER (speed_ms < 0.30 * 13.9) AS BIGINT) AS queued FROM c GROUP BY run, path_id""", "veh")
def fleet_health(v: Views) -> DataFrame:
    return rounded(traffic.fleet_health(agents(v).withColumn("desired", F.lit(13.9)), ["run", "path_id"], "desired").drop("negative"))


_TICKS = "SELECT path_id, tick, CAST(count(*) AS BIGINT) AS n FROM veh GROUP BY path_id, tick"


@query(_TICKS, "veh")
def density_ticks(v: Views) -> DataFrame:
    return v.veh.groupBy("path_id", "tick").agg(F.count("*").alias("n"))


@query(f"SELECT path_id, tick, n, CAST(sum(n) OVER (PARTITION BY path_id ORDER BY tick RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM ({_TICKS})", "veh")
def density_rolling_180(v: Views) -> DataFrame:
    return traffic.rolling_count(density_ticks(v), ["path_id"], "tick", "n")


@query("""WITH s AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY row_id) AS k, row_id, speed_ms FROM veh), m AS (SELECT path_id, k // 40 AS b, avg(speed_ms) AS a FROM s GROUP BY 1, 2),
l AS (SELECT path_id, list(a ORDER BY b) AS xs FROM m GROUP BY 1)
SELECT path_id, round(list_reduce(xs, lambda acc, x : 0.3 * x + 0.7 * acc, CAST(0 AS DOUBLE)), 9) AS ema FROM l""", "veh")
def aq_ema(v: Views) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("path_id").orderBy("row_id"))
    m = v.veh.withColumn("b", F.floor(k / 40)).groupBy("path_id", "b").agg(F.avg("speed_ms").alias("a"))
    e = traffic.ema(m, ["path_id"], "b", "a")
    return e.groupBy("path_id").agg(F.round(F.max_by("ema", "b"), 9).alias("ema"))


@query("""SELECT bx, by_ AS "by", round(sum(w), 6) AS weight FROM (SELECT least(CAST(floor(x / 999 * 60) AS BIGINT), 59) AS bx, least(CAST(floor(y / 999 * 60) AS BIGINT), 59) AS by_, speed_ms AS w FROM veh WHERE x BETWEEN 0 AND 999 AND y BETWEEN 0 AND 999) GROUP BY 1, 2""", "veh")
def emission_hist2d(v: Views) -> DataFrame:
    h = grids.histogram2d(v.veh, "speed_ms", 60, (0.0, 999.0, 0.0, 999.0))
    return h.select(F.col("bx").cast("long").alias("bx"), F.col("by").cast("long").alias("by"), F.round("weight", 6).alias("weight"))


# networks
@query("SELECT u, v, round(min(length), 6) AS length FROM edges GROUP BY u, v", "edges")
def parallel_edge_min(v: Views) -> DataFrame:
    return rounded(network.collapse(v.edges, "min", "length"))


@query("SELECT u, v, round(max(speed_ms), 6) AS speed_ms FROM edges GROUP BY u, v", "edges")
def parallel_edge_max(v: Views) -> DataFrame:
    return rounded(network.collapse(v.edges, "max", "speed_ms"))


@query("SELECT u, v, round(length, 6) AS length FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY seq DESC, length DESC) AS k FROM edges) WHERE k = 1", "edges")
def parallel_edge_last(v: Views) -> DataFrame:
    return rounded(network.collapse(v.edges, "last", "length", "seq"))


@query("SELECT u, v, length, highway FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, highway) AS k FROM edges) WHERE k = 1", "edges")
def lightest_edge(v: Views) -> DataFrame:
    return network.best_edge(v.edges, "length", "highway")


@query("SELECT highway, CAST(count(*) AS BIGINT) AS n FROM edges WHERE highway NOT IN ('footway', 'pedestrian', 'path', 'cycleway', 'steps', 'bridleway', 'track') GROUP BY highway", "edges")
def drivable_edges(v: Views) -> DataFrame:
    return network.drivable(v.edges).groupBy("highway").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT * FROM edges WHERE highway IN ('footway', 'pedestrian', 'path', 'cycleway', 'steps', 'bridleway', 'track')) SELECT u, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM w UNION ALL SELECT * FROM edges WHERE (SELECT count(*) FROM w) < 10) GROUP BY u", "edges")
def walkable_fallback(v: Views) -> DataFrame:
    return network.walkable(v.edges).groupBy("u").agg(F.count("*").alias("n"))


@query("SELECT node_id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT u AS node_id, v FROM edges UNION SELECT v, u FROM edges) GROUP BY 1 HAVING count(*) >= 3", "edges")
def node_degree3(v: Views) -> DataFrame:
    return network.junctions(v.edges)


@query("SELECT highway, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM edges r WHERE r.u = e.v AND r.v = e.u)) AS BIGINT) AS with_reverse FROM edges e GROUP BY highway", "edges")
def reverse_edge_exists(v: Views) -> DataFrame:
    return network.has_reverse(v.edges).groupBy("highway").agg(F.count_if("has_reverse").alias("with_reverse"))


@query("""WITH d AS (SELECT DISTINCT seq, u, v FROM edges), b AS (SELECT *, 'e_' || u || '_' || v AS base, row_number() OVER (PARTITION BY u, v ORDER BY seq) AS k FROM d)
SELECT seq, base || CASE WHEN k = 1 THEN '' ELSE '_' || (k - 2) END AS edge_id FROM b""", "edges")
def edge_ids_dedup(v: Views) -> DataFrame:
    d = v.edges.select("seq", "u", "v").distinct()
    return network.edge_ids(d, F.concat(F.lit("e_"), F.col("u"), F.lit("_"), F.col("v")), "seq").select("seq", "edge_id")


@query("WITH s AS (SELECT u, seq, max(length) AS length FROM edges GROUP BY u, seq) SELECT u, seq, round(sum(length) OVER (PARTITION BY u ORDER BY seq) - length, 6) AS along, round(sum(length) OVER (PARTITION BY u), 6) AS total FROM s", "edges")
def cum_length(v: Views) -> DataFrame:
    s = v.edges.groupBy("u", "seq").agg(F.max("length").alias("length"))
    return rounded(network.cumulative_length(s, "u", ["seq"], "length").select("u", "seq", "along", "total"))


@query("""WITH s AS (SELECT u, seq, max(length) AS length FROM edges GROUP BY u, seq), c AS (SELECT u, seq, sum(length) OVER (PARTITION BY u ORDER BY seq) - length AS a, sum(length) OVER (PARTITION BY u) AS t FROM s)
SELECT u, seq, round(5.0 * least(greatest(least(a, t - a) / 60.0, 0.0), 1.0), 6) AS z FROM c""", "edges")
def bridge_ramp(v: Views) -> DataFrame:
    s = v.edges.groupBy("u", "seq").agg(F.max("length").alias("length"))
    c = network.cumulative_length(s, "u", ["seq"], "length")
    return rounded(c.select("u", "seq", raster.ramp(raster.bridge_height(F.lit("yes"), F.lit(1)), F.col("along"), F.col("total"), 60.0).alias("z")))


_COST = "SELECT seq, length / speed_ms AS tt, (0.012 * 1400 * 9.81 + 0.5 * 1.20 * 0.30 * 2.2 * speed_ms * speed_ms) * length AS energy FROM edges"


@query(f"""WITH c AS ({_COST}), b AS (SELECT min(tt) AS a, max(tt) AS z, min(energy) AS d, max(energy) AS e FROM c)
SELECT c.seq, round((tt - a) / (z - a), 9) AS norm_tt, round(0.5 * (tt - a) / (z - a) + 0.5 * (energy - d) / (e - d), 9) AS combined FROM c, b""", "edges")
def edge_costs_minmax(v: Views) -> DataFrame:
    c = v.edges.select("seq", (F.col("length") / F.col("speed_ms")).alias("tt"), solar.mechanical_joules(F.col("length"), F.col("speed_ms")).alias("energy"))
    n = network.normalized(c, ["tt", "energy"])
    return n.select("seq", F.round("norm_tt", 9).alias("norm_tt"), F.round(0.5 * F.col("norm_tt") + 0.5 * F.col("norm_energy"), 9).alias("combined"))


@query("WITH c AS (SELECT u, v, min(length) AS cost FROM edges WHERE highway = 'primary' GROUP BY u, v) SELECT e.u, e.v, CAST(count(*) AS BIGINT) AS n, round(min(cost), 6) AS cost FROM edges e LEFT JOIN c ON c.u = e.u AND c.v = e.v GROUP BY e.u, e.v", "edges")
def graph_cost_join(v: Views) -> DataFrame:
    costs = v.edges.where("highway = 'primary'").select("u", "v", F.col("length").alias("cost"))
    return rounded(network.attach_costs(v.edges.select("u", "v"), costs, "cost").groupBy("u", "v").agg(F.count("*").alias("n"), F.min("cost").alias("cost")))


@query("""WITH p AS (SELECT DISTINCT u * 100 + v AS path_id, u, v FROM edges), j AS (SELECT a.path_id AS f, b.path_id AS t, b.v = a.u AS ut FROM p a JOIN p b ON a.v = b.u), s AS (SELECT *, sum(CASE WHEN ut THEN 0 ELSE 1 END) OVER (PARTITION BY f) AS k FROM j)
SELECT f AS from_path, CAST(count(*) AS BIGINT) AS ways, CAST(sum(t) AS BIGINT) AS check_sum FROM s WHERE NOT ut OR k = 0 GROUP BY f""", "edges")
def successor_paths(v: Views) -> DataFrame:
    p = v.edges.select((F.col("u") * 100 + F.col("v")).alias("path_id"), "u", "v").distinct()
    return network.successors(p).groupBy("from_path").agg(F.count("*").alias("ways"), F.sum("to_path").alias("check_sum"))


@query("""WITH RECURSIVE w AS (SELECT u, v, min(length) AS c FROM edges GROUP BY u, v), d(source, node, cost, k) AS (SELECT 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0 UNION ALL
SELECT source, v, min(cost), k FROM (SELECT d.source, w.v, d.cost + w.c AS cost, d.k + 1 AS k FROM d JOIN w ON d.node = w.u WHERE d.k < 12) GROUP BY source, v, k)
SELECT source, node AS node_id, round(min(cost), 6) AS cost FROM d GROUP BY source, node""", "edges")
def sssp_lengths(v: Views) -> DataFrame:
    return rounded(network.shortest_paths(v.edges, v.spark.range(1).select(F.col("id").alias("node_id")), "length"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT u, v FROM edges UNION SELECT v, u FROM edges), r(a, b) AS (SELECT u, u FROM e UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT a AS node_id, min(b) AS component FROM r GROUP BY a""", "edges")
def connected_components(v: Views) -> DataFrame:
    return network.components(v.edges)


# space
@query("""SELECT a.row_id, CAST(count(*) AS BIGINT) AS neighbours FROM veh a JOIN veh b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 12 GROUP BY a.row_id""", "veh")
def neighbour_count(v: Views) -> DataFrame:
    return spatial.neighbour_count(v.veh, "row_id", 12.0)


@query("""WITH d AS (SELECT row_id, node_id, sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) AS d FROM veh v JOIN nodes n ON true)
SELECT row_id, arg_min(node_id, d * 1e6 + node_id * 1e-6) AS node_id, round(min(d), 6) AS distance FROM d WHERE d <= 60 GROUP BY row_id""", "veh nodes")
def nearest_node(v: Views) -> DataFrame:
    n = v.nodes.select("node_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return rounded(spatial.nearest(v.veh, n, "row_id", "node_id", 60.0))


@query("""WITH d AS (SELECT row_id, node_id, sqrt(power(v.x - n.x, 2) + power(v.y - n.y, 2)) AS d FROM veh v JOIN nodes n ON true)
SELECT row_id, round(min(d), 6) AS distance FROM d GROUP BY row_id""", "veh nodes")
def nearest_node_any_distance(v: Views) -> DataFrame:
    n = v.nodes.select("node_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return rounded(spatial.nearest_small(v.veh, n, "row_id", "node_id").select("row_id", "distance"))


@query("""SELECT p.row_id, round(max(c.speed_ms), 6) AS impact FROM veh p JOIN veh c ON p.row_id % 3 = 0 AND c.row_id % 3 <> 0 AND c.speed_ms > 2 AND sqrt(power(p.x - c.x, 2) + power(p.y - c.y, 2)) < 1.4 GROUP BY p.row_id""", "veh")
def pedestrian_collisions(v: Views) -> DataFrame:
    cars = v.veh.where("row_id % 3 <> 0 AND speed_ms > 2").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("speed_ms").alias("car_speed"))
    hit = spatial.within(v.veh.where("row_id % 3 = 0").select("row_id", "x", "y"), cars, 1.4, strict=True)
    return rounded(hit.groupBy("row_id").agg(F.max("car_speed").alias("impact")))


_SEG = "seg AS (SELECT DISTINCT a.node_id * 100 + b.node_id AS sid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM edges e JOIN nodes a ON a.node_id = e.u JOIN nodes b ON b.node_id = e.v WHERE e.u < e.v)"


def segments(v: Views) -> DataFrame:
    n = v.nodes
    a, b = n.select(F.col("node_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay")), n.select(F.col("node_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = v.edges.where("u < v").select("u", "v").distinct()
    return e.join(a, "u").join(b, "v").select((F.col("u") * 100 + F.col("v")).alias("sid"), "ax", "ay", "bx", "by")


@query(f"""WITH {_SEG}, t AS (SELECT row_id, sid, x, y, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM veh JOIN seg ON true), d AS (SELECT *, least(greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0.0), 1.0) AS k FROM t)
SELECT row_id, round(min(sqrt(power(x - ax - k * dx, 2) + power(y - ay - k * dy, 2))), 6) AS distance FROM d GROUP BY row_id HAVING min(sqrt(power(x - ax - k * dx, 2) + power(y - ay - k * dy, 2))) <= 5""", "veh nodes edges")
def point_near_segment(v: Views) -> DataFrame:
    return rounded(spatial.points_near_segments(v.veh.select("row_id", "x", "y"), segments(v), "row_id", "sid", 5.0).select("row_id", "distance"))


@query("SELECT row_id, row_id % 3 = 0 OR (x - 500) * (x - 500) + (y - 500) * (y - 500) <= 90000 AS kept FROM veh", "veh")
def confidence_and_disc(v: Views) -> DataFrame:
    return v.veh.select("row_id", ((F.col("row_id") % 3 == 0) | spatial.in_disc(F.col("x") - 500, F.col("y") - 500, 250.0, 50.0)).alias("kept"))


@query("SELECT row_id, ((y < 300) <> (y < 800) AND x < 100.0 + 800.0 * (y - 300) / 500) <> ((y < 800) <> (y < 300) AND x < 100.0 + (y - 800) * 0) AS inside FROM veh", "veh")
def point_in_polygon(v: Views) -> DataFrame:
    return v.veh.select("row_id", spatial.in_polygon(F.col("x"), F.col("y"), [(100.0, 300.0), (900.0, 800.0), (100.0, 800.0)]).alias("inside"))


@query("SELECT round(x / 3, 2) AS rx, round(y / 3, 2) AS ry, min(row_id) AS first, row_number() OVER (ORDER BY min(row_id)) - 1 AS node_id FROM veh GROUP BY 1, 2", "veh")
def node_dedup(v: Views) -> DataFrame:
    d = spatial.dedup_nodes(v.veh.select("row_id", (F.col("x") / 3).alias("x"), (F.col("y") / 3).alias("y")), "row_id")
    return d.select("rx", "ry", "first", F.col("node_id").cast("long").alias("node_id"))


# grids and floods
@query("""SELECT CAST("row" // 5 AS BIGINT) AS "row", CAST(col // 5 AS BIGINT) AS col, round(avg(dem), 6) AS dem, bool_or(building) AS building, bool_and(NOT water) AS dry, round(sum(infil), 6) AS infil, round(min(depth), 6) AS depth FROM cells GROUP BY 1, 2 HAVING count(*) = 25""", "cells")
def coarsen_blocks(v: Views) -> DataFrame:
    c = v.cells.withColumn("dry", ~F.col("water"))
    return rounded(grids.coarsen(c, 5, mean=("dem",), any_=("building",), all_=("dry",), total=("infil",), low=("depth",)))


@query("""SELECT a."row", a.col, round(sum(b.depth), 6) AS depth_box FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a."row", a.col""", "cells")
def box_sum_5(v: Views) -> DataFrame:
    return rounded(grids.box_sum(v.cells, "depth", 2).select("row", "col", "depth_box"))


@query("""SELECT a."row", a.col, round(stddev_pop(b.dem), 6) AS std FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a."row", a.col""", "cells")
def roughness(v: Views) -> DataFrame:
    return rounded(grids.local_std(v.cells, "dem", 1).select("row", "col", "std"))


_FLOW = """n AS (SELECT a."row", a.col, b."row" AS tr, b.col AS tc, (a.dem - b.dem) / sqrt(power(a."row" - b."row", 2) + power(a.col - b.col, 2)) AS s FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND (a."row" <> b."row" OR a.col <> b.col) WHERE a.dem > b.dem),
best AS (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY s DESC, tr, tc) AS k FROM n), flow AS (SELECT c."row", c.col, tr AS to_row, tc AS to_col FROM cells c LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b."row" = c."row" AND b.col = c.col)"""


@query(f'WITH {_FLOW} SELECT "row", col, to_row, to_col FROM flow', "cells")
def d8_receivers(v: Views) -> DataFrame:
    return grids.receivers(v.cells).select("row", "col", "to_row", "to_col")


@query(f"""WITH RECURSIVE {_FLOW}, t(r, c, ar, ac) AS (SELECT "row", col, "row", col FROM flow UNION ALL SELECT t.r, t.c, f.to_row, f.to_col FROM t JOIN flow f ON f."row" = t.ar AND f.col = t.ac WHERE f.to_row IS NOT NULL)
SELECT ar AS "row", ac AS col, CAST(count(*) AS BIGINT) AS accumulation FROM t GROUP BY ar, ac""", "cells")
def flow_accumulation(v: Views) -> DataFrame:
    return grids.flow_accumulation(grids.receivers(v.cells))


@query("""SELECT a."row", a.col, round(max(b.depth), 6) AS max_depth FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 WHERE a.building GROUP BY a."row", a.col""", "cells")
def window_depth(v: Views) -> DataFrame:
    p = v.cells.where("building").select((F.col("row") * 50 + F.col("col")).alias("point_id"), "row", "col")
    w = grids.window_max(v.cells, p, "depth", 2)
    return rounded(w.select(F.floor(F.col("point_id") / 50).alias("row"), (F.col("point_id") % 50).alias("col"), "max_depth"))


_KPI = """round(count(*) FILTER (depth > 0.10) * 4.0 / 1e4, 6) AS flooded_ha, round(count(*) FILTER (depth > 0.30) * 4.0 / 1e4, 6) AS deep_ha, round(coalesce(max(depth), 0), 6) AS max_depth_m, round(coalesce(avg(depth) FILTER (depth > 0.10), 0), 6) AS mean_depth_m,
round(coalesce(sum(depth) * 4.0, 0), 6) AS volume_m3, round(coalesce(max(depth * (speed + 0.5)), 0), 6) AS peak_hazard, round(count(*) FILTER (depth * (speed + 0.5) > 0.75) * 4.0 / 1e4, 6) AS hazardous_ha, round(coalesce(quantile_cont(depth, 0.99) FILTER (depth > 0.10), 0), 6) AS p99_depth_m"""


@query(f"SELECT {_KPI} FROM cells WHERE NOT building", "cells")
def flood_summary(v: Views) -> DataFrame:
    return rounded(flood.summary(v.cells, mask=~F.col("building")))


@query(f"SELECT band, {_KPI} FROM cells GROUP BY band", "cells")
def flood_by_band(v: Views) -> DataFrame:
    return rounded(flood.summary(v.cells, by=["band"]))


@query("""WITH b AS (SELECT band, count(*) FILTER (depth > 0.05) * 4.0 AS x FROM cells GROUP BY band), a AS (SELECT band, count(*) FILTER (depth - 0.4 > 0.05) * 4.0 AS y FROM cells GROUP BY band)
SELECT b.band, round(x, 6) AS before, round(y, 6) AS after, round(CASE WHEN x = 0 THEN 0 ELSE -100 * (y - x) / x END, 6) AS reduction_pct FROM b JOIN a ON a.band = b.band""", "cells")
def flood_reduction(v: Views) -> DataFrame:
    after = v.cells.withColumn("depth", F.col("depth") - 0.4)
    a, b = (flood.flooded_area(c, ["band"], 2.0, 0.05) for c in (v.cells, after))
    return rounded(flood.reduction(a, b, ["band"], "flooded_m2"))


@query("""WITH j AS (SELECT depth AS a, speed AS b FROM cells), m AS (SELECT count(*) FILTER (a > 0.1 AND b > 0.1) / greatest(count(*) FILTER (a > 0.1 OR b > 0.1), 1.0) AS iou, corr(a, b) FILTER (a > 0.02 OR b > 0.02) AS depth_r,
sqrt(avg(power(b - a, 2)) FILTER (a > 0.02 OR b > 0.02)) AS rmse_m, avg(b - a) FILTER (a > 0.02 OR b > 0.02) AS bias_m, count(*) FILTER (a > 0.02 OR b > 0.02) AS wet_cells FROM j)
SELECT round(iou, 6) AS iou, round(depth_r, 6) AS depth_r, round(rmse_m, 6) AS rmse_m, round(bias_m, 6) AS bias_m, CAST(wet_cells AS BIGINT) AS wet_cells, CASE WHEN iou >= 0.7 AND depth_r >= 0.8 THEN 'AGREE' WHEN iou >= 0.5 THEN 'PARTIAL' ELSE 'DIVERGE' END AS verdict FROM m""", "cells")
def grid_agreement(v: Views) -> DataFrame:
    return rounded(flood.agreement(v.cells, v.cells.withColumn("depth", F.col("speed"))))


@query("""SELECT "row", col, round(depth * (speed + 0.5), 6) AS hazard, CASE WHEN depth >= 0.10 THEN CASE WHEN depth * (speed + 0.5) < 0.75 THEN 0 WHEN depth * (speed + 0.5) < 1.25 THEN 1 WHEN depth * (speed + 0.5) < 2 THEN 2 ELSE 3 END END AS cls FROM cells""", "cells")
def hazard_classes(v: Views) -> DataFrame:
    h = raster.hazard(F.col("depth"), F.col("speed"))
    return v.cells.select("row", "col", F.round(h, 6).alias("hazard"), raster.hazard_class(h, F.col("depth")).alias("cls"))


@query("SELECT round(sum(1 / (1 + exp(-least(greatest((depth - 0.05) / 0.01, -50), 50))) * CASE WHEN water THEN 0.0 ELSE 1.0 END * 4), 4) AS soft_m2 FROM cells", "cells")
def soft_flooded_area(v: Views) -> DataFrame:
    c = v.cells.withColumn("street", F.when(F.col("water"), 0.0).otherwise(1.0))
    return rounded(flood.soft_flooded(c, 2.0, "street"), 4)


@query("""WITH s AS (SELECT path_id, row_id AS t, sum(speed_ms) OVER (PARTITION BY path_id ORDER BY row_id) AS volume FROM veh)
SELECT path_id, t, round((volume - lag(volume) OVER w) / (t - lag(t) OVER w), 6) AS rate FROM s WINDOW w AS (PARTITION BY path_id ORDER BY t)""", "veh")
def outflow_rate(v: Views) -> DataFrame:
    w = Window.partitionBy("path_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    s = v.veh.select("path_id", F.col("row_id").alias("t"), F.sum("speed_ms").over(w).alias("volume"))
    return rounded(flood.rates(s, ["path_id"], "t", "volume").select("path_id", "t", "rate"))


@query("""WITH s AS (SELECT path_id, row_id AS t, speed_ms AS q FROM veh), a AS (SELECT *, (t - lag(t) OVER w) * (q + lag(q) OVER w) / 2 AS area FROM s WINDOW w AS (PARTITION BY path_id ORDER BY t))
SELECT path_id, round(coalesce(sum(area), 0), 6) AS integral, arg_max(q, t) AS last FROM a GROUP BY path_id""", "veh")
def inflow_integral(v: Views) -> DataFrame:
    return rounded(flood.trapezoid(v.veh.select("path_id", F.col("row_id").alias("t"), F.col("speed_ms").alias("q")), ["path_id"], "t", "q"))


@query("WITH l AS (SELECT path_id, list(speed_ms ORDER BY row_id) AS s FROM veh GROUP BY path_id) SELECT path_id, coalesce((s[-6] - s[-1]) / nullif(s[-1], 0) < 0.01, false) AS settled FROM l", "veh")
def storage_settled(v: Views) -> DataFrame:
    return flood.settled(v.veh, ["path_id"], "row_id", "speed_ms")


def _idf_sql(x: str) -> str:
    t, y = raster.IDF_MINUTES, raster.IDF[10]
    parts = " ".join(f"WHEN {x} <= {b} THEN exp(ln({p}) + (ln({x}) - ln({a})) / (ln({b}) - ln({a})) * (ln({q}) - ln({p})))" for a, b, p, q in zip(t, t[1:], y, y[1:]))
    return f"CASE WHEN {x} <= {t[0]} THEN {y[0]} {parts} ELSE {y[-1]} END"


@query(f"WITH m AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 1500 / 10.0 + 1 AS minutes FROM orders) SELECT id, minutes, round({_idf_sql('minutes')}, 6) AS mmh FROM m")
def idf_table(v: Views) -> DataFrame:
    m = v.orders.select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderkey") % 1500 / 10.0 + 1).alias("minutes"))
    return m.select("id", "minutes", F.round(raster.intensity(F.col("minutes"), 10), 6).alias("mmh"))


@query(f"""WITH b AS (SELECT range AS k, {_idf_sql('(range * 5)')} * range * 5 / 60 AS depth FROM range(1, 13)), i AS (SELECT k, depth - lag(depth, 1, 0) OVER (ORDER BY k) AS inc FROM b),
p AS (SELECT inc, list_extract([6, 5, 7, 4, 8, 3, 9, 2, 10, 1, 11, 0], CAST(k AS INTEGER)) AS position FROM i) SELECT CAST(s_suppkey AS BIGINT) AS catchment, CAST(position AS INTEGER) AS position, round(inc / 60 * (s_suppkey % 9 + 1) * 1000, 4) AS volume_m3 FROM p, supplier""")
def design_storm_10y(v: Views) -> DataFrame:
    """Rain on each catchment, block by block of the ten-year storm; the storm is a dozen rows."""
    storm = flood.design_storm(v.spark, 10).select("position", (F.col("depth_mm") * (1000 / 60)).alias("per_km2"))
    area = v.supplier.select(F.col("s_suppkey").cast("long").alias("catchment"), (F.col("s_suppkey") % 9 + 1).alias("km2"))
    return area.join(F.broadcast(storm)).select("catchment", "position", F.round(F.col("per_km2") * F.col("km2"), 4).alias("volume_m3"))


# scalar functions over rows
@query("""SELECT row_id, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing FROM (SELECT row_id, degrees(atan2(x - 500.5, y - 500.5)) AS d FROM veh)""", "veh")
def bearings(v: Views) -> DataFrame:
    return v.veh.select("row_id", F.round(motion.bearing(F.lit(500.5), F.lit(500.5), F.col("x"), F.col("y")), 6).alias("bearing"))


@query("SELECT row_id, CASE WHEN d < 30 OR d > 330 THEN 'straight' WHEN d < 150 THEN 'right' WHEN d > 210 THEN 'left' ELSE 'u_turn' END AS turn FROM (SELECT row_id, ((y - x) % 360 + 360) % 360 AS d FROM veh)", "veh")
def turn_directions(v: Views) -> DataFrame:
    return v.veh.select("row_id", motion.turn(F.col("x"), F.col("y")).alias("turn"))


def _bell(h: str, c: float, w: float) -> str:
    return f"exp(-0.5 * power(({h} - {c}) / {w}, 2))"


@query(f"""WITH h AS (SELECT row_id, (t_s % 86400) / 3600.0 AS hour FROM veh) SELECT row_id, round(least(greatest(0.7 + 0.7 * greatest({_bell('hour', 8, 1.2)}, {_bell('hour', 18, 1.2)}) - CASE WHEN hour < 10 THEN 0.4 * {_bell('hour', 3, 2.0)} ELSE 0 END, 0.6), 1.4), 6) AS rush,
round(least(greatest(0.5 + 0.4 * {_bell('hour', 8, 2.5)} - 0.4 * {_bell('hour', 18, 2.5)}, 0.1), 0.9), 6) AS outbound FROM h""", "veh")
def demand_curves(v: Views) -> DataFrame:
    h = v.veh.select("row_id", (F.col("t_s") % 86400 / 3600.0).alias("hour"))
    return h.select("row_id", F.round(motion.rush_factor(F.col("hour")), 6).alias("rush"), F.round(motion.outbound_share(F.col("hour")), 6).alias("outbound"))


@query("""WITH s AS (SELECT u AS node, highway, max(speed_ms) AS speed FROM edges GROUP BY u, highway), t AS (SELECT *, sum(speed) OVER (PARTITION BY node) AS total FROM s)
SELECT node, highway, round(least(greatest(14 + 31 * speed / total, 14), 45), 6) AS green, round(least(greatest(1 + speed / 6, 3), 5.5), 6) AS yellow FROM t""", "edges")
def signal_timings(v: Views) -> DataFrame:
    s = v.edges.groupBy(F.col("u").alias("node"), "highway").agg(F.max("speed_ms").alias("speed")).withColumn("total", F.sum("speed").over(Window.partitionBy("node")))
    return s.select("node", "highway", F.round(motion.green_seconds(F.col("speed"), F.col("total")), 6).alias("green"), F.round(motion.yellow_seconds(F.col("speed")), 6).alias("yellow"))


@query("""SELECT row_id, CASE WHEN t < 20 OR t >= 25 AND t < 40 THEN 'green' WHEN t < 23 OR t >= 40 AND t < 43 THEN 'yellow' ELSE 'all_red' END AS state, CASE WHEN t < 25 THEN 0 ELSE 1 END AS phase FROM (SELECT row_id, t_s % 45 AS t FROM veh)""", "veh")
def signal_states(v: Views) -> DataFrame:
    s = motion.signal_state(F.col("t_s"), [20.0, 15.0], [3.0, 3.0], 2.0)
    return v.veh.select("row_id", s["state"].alias("state"), s["phase"].alias("phase"))


@query("""SELECT seq, round(length / speed_ms, 6) AS tt, highway, CASE highway WHEN 'motorway' THEN 'motorway' WHEN 'primary' THEN 'primary' WHEN 'secondary' THEN 'secondary' WHEN 'residential' THEN 'residential' ELSE 'other' END AS class, CASE highway WHEN 'motorway' THEN 33.3 WHEN 'primary' THEN 13.9 WHEN 'secondary' THEN 13.9 WHEN 'residential' THEN 8.3 ELSE 11.1 END AS free FROM edges""", "edges")
def edge_travel_times(v: Views) -> DataFrame:
    h = F.array("highway")
    return v.edges.select("seq", F.round(parse.travel_time(F.col("length"), F.col("speed_ms"), F.lit(0.0)), 6).alias("tt"), "highway", parse.road_class(h).alias("class"), parse.edge_speed_ms(F.array().cast("array<string>"), h).alias("free"))


@query("""SELECT row_id, CAST(h * 3600 + m * 60 + s AS DOUBLE) AS seconds FROM (SELECT row_id, row_id % 30 AS h, row_id % 60 AS m, row_id % 47 AS s FROM veh)""", "veh")
def clock_times(v: Views) -> DataFrame:
    k = F.col("row_id")
    return v.veh.select("row_id", parse.clock_seconds(F.format_string("%02d:%02d:%02d", k % 30, k % 60, k % 47)).alias("seconds"))


_EL = "e AS (SELECT row_id, sin(pi() * ((t_s % 86400) / 3600.0 - 6) / 12) AS el FROM veh WHERE t_s % 43200 <> 21600)"


@query(f"""WITH {_EL}, p AS (SELECT row_id, el, CASE WHEN asin(el) <= 0 THEN 0 ELSE 1361.0 * power(0.7, power(greatest(1, 1 / greatest(sin(asin(el)), 1e-6)), 0.678)) END AS dni FROM e)
SELECT row_id, round(dni, 4) AS dni, round(CASE WHEN asin(el) <= 0 THEN 0 ELSE dni * sin(asin(el)) / (1 - 0.0721) END, 4) AS ghi FROM p""", "veh")
def clear_sky_day(v: Views) -> DataFrame:
    e = v.veh.where("t_s % 43200 <> 21600").select("row_id", F.asin(F.sin(3.141592653589793 * (F.col("t_s") % 86400 / 3600.0 - 6) / 12)).alias("el"))
    s = solar.clear_sky(F.col("el"))
    return e.select("row_id", F.round(s["dni"], 4).alias("dni"), F.round(s["ghi"], 4).alias("ghi"))


# kernels: no SQL says the same, tests hold them against invariants and brute force
@query()
def flood_run_kernel(v: Views) -> DataFrame:
    from cityweave.operators.floodsim import run_all

    c = v.cells.select(F.concat(F.lit("b"), F.floor(F.col("row") / 20)).alias("run_id"), (F.col("row") % 20).cast("int").alias("row"), F.col("col").cast("int").alias("col"), "dem", F.lit(0.03).alias("manning"), (F.col("infil") * 10).alias("infil_mmh"), F.lit("s").alias("storm"))
    return run_all(c, {"s": [(0.0, 300.0, 60.0)]}, 600.0, 2.0)


@query()
def edge_betweenness(v: Views) -> DataFrame:
    from cityweave.operators.routing import betweenness

    return betweenness(v.edges, "length")


@query()
def pareto_routes(v: Views) -> DataFrame:
    from cityweave.operators.routing import routes

    pairs = v.spark.range(100).select(F.col("id").alias("pair_id"), F.col("id").alias("origin"), (99 - F.col("id")).alias("destination"))
    return routes(v.edges.where("highway <> 'footway'"), pairs, "length", 3)
