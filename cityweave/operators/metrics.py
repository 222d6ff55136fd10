"""Accuracy and comparison metrics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.raster import percent_change
from cityweave.session import checkpointed

#: Keys that prefix_match broadcasts at most, and ids of one of its tasks, about.
FEW_KEYS, TASK_IDS = 1_000_000, 500_000


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from sums; null for fewer than two rows or a constant column."""
    n, sx, sy = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((n > 1) & (vx > 1e-9) & (vy > 1e-9), F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def travel_time_metrics(pairs: DataFrame, sim: str, ref: str, by: list[str] | None = None) -> DataFrame:
    """n, MAPE, RMSE, bias, Pearson r, share with GEH under 5, means; one row, or one for each group."""
    s, r = F.col(sim), F.col(ref)
    e = s - r
    geh = F.sqrt(2 * e * e / F.greatest(s + r, F.lit(1e-6)))
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), (F.avg(F.abs(e) / F.greatest(r, F.lit(1e-6))) * 100).alias("mape_pct"), F.sqrt(F.avg(e * e)).alias("rmse_s"), F.avg(e).alias("bias_s"),
        correlation(s, r).alias("pearson_r"), (F.avg((geh < 5).cast("double")) * 100).alias("geh_under5_pct"), F.avg(s).alias("sim_mean_s"), F.avg(r).alias("ref_mean_s"),
    )


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Inner join on key: a, b, delta = b - a and its percentage (null where a is 0)."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key).select(key, "a", "b", (F.col("b") - F.col("a")).alias("delta"), percent_change(F.col("a"), F.col("b")).alias("delta_pct"))


def compare_totals(table: DataFrame, run: str, metrics: list[str], run_a: str, run_b: str) -> DataFrame:
    """For each metric column: a, b, delta, delta_pct between two rows of a run table."""
    long = table.unpivot([run], metrics, "metric", "value")
    pick = lambda r: F.max(F.when(F.col(run) == r, F.col("value")))
    t = long.groupBy("metric").agg(pick(run_a).alias("a"), pick(run_b).alias("b"))
    return t.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), percent_change(F.col("a"), F.col("b")).alias("delta_pct"))


def prefix_match(results: DataFrame, keys: DataFrame, result_id: str, key: str) -> DataFrame:
    """Each result with the equal key, else the longest key that its id begins with.

    Beginnings are joined by equality: every id is expanded to its own prefixes of the lengths that keys have. Up to
    `FEW_KEYS` keys are broadcast, so the prefixes stay where they are. Ids are dealt into tasks of about `TASK_IDS`, and only
    the length of an id's longest key is kept, a number, so a task's memory doesn't grow with the table.
    """
    sizes = {r[0]: r[1] for r in keys.select(F.col(key).alias("_p")).distinct().groupBy(F.length("_p")).count().collect()}
    lengths, few = sorted(n for n in sizes if n is not None), sum(sizes.values()) <= FEW_KEYS
    results = checkpointed(results)
    n = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-results.count() // TASK_IDS))
    dealt = results.repartition(n, result_id)
    cut = dealt.select(F.col(result_id).alias("_r"), F.explode(F.array(*(F.lit(k) for k in lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).where(F.length("_r") >= F.col("_n"))
    known = keys.select(F.col(key).alias("_p")).distinct()
    cut = cut.withColumn("_p", F.expr("left(_r, _n)")).join(F.broadcast(known) if few else known.hint("merge"), "_p")
    hit = cut.groupBy("_r").agg(F.max("_n").alias("_n")).select(F.col("_r").alias(result_id), F.expr("left(_r, _n)").alias(key))
    return dealt.join(hit, result_id)


def skyline(routes: DataFrame, by: list[str], time: str, cost: str) -> DataFrame:
    """Rows that no other row of the group beats in one measure without losing in the other; equal rows all stay."""
    best = routes.groupBy(*by, time).agg(F.min(cost).alias("_best"))
    before = F.min("_best").over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_best") < F.col("_before"))).drop("_before")
    return routes.join(front, [*by, time]).where(F.col(cost) == F.col("_best")).drop("_best")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """by and a column for each share: exact percentiles between ranks; groups without a value are left out.

    Equal values are counted first; their ranks in a group are running sums over ranges of all values, so no task holds a
    group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    ranged = checkpointed(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_k").alias("_k"))  # few rows: a range holds few groups or is one's part
    group = Window.partitionBy(*by)
    before = parts.select(*by, "_part", (F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).alias("_before"), F.sum("_k").over(group).alias("_n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a._part") == F.col("b._part")]
    ranked = ranged.alias("a").join(F.broadcast(before.alias("b")), reduce(and_, same)).select(*(F.col(f"a.{c}").alias(c) for c in by), "_v", "_k", "a._part", "_before", "_n")
    upto = F.sum("_k").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    ranked = ranked.withColumn("_last", upto - 1).withColumn("_first", F.col("_last") - F.col("_k") + 1)
    held = lambda at: (F.col("_first") <= at) & (at <= F.col("_last"))
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1)
        lo, hi = F.max(F.when(held(F.floor(at)), F.col("_v"))), F.max(F.when(held(F.ceil(at)), F.col("_v")))
        part = F.max(at - F.floor(at))
        out.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).alias(name))
    return ranked.groupBy(*by).agg(*out)


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, p50, p95, max and sum; zeros where there is nothing."""
    v, by = F.col(value), by or []
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.max(v)).alias("max"), zero(F.sum(v)).alias("total"))
    found = percentiles(df, value, {"p50": 0.5, "p95": 0.95}, by)
    met = reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by), F.lit(True))
    return whole.alias("a").join(found.alias("b"), met, "left").select(*(F.col(f"a.{c}").alias(c) for c in by), "n", "mean", zero(F.col("p50")).alias("p50"), zero(F.col("p95")).alias("p95"), "max", "total")
