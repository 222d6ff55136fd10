"""Greedy choices that keep their distance, taken in parallel rounds with the rows of the sequential rule.

A row that no better undecided row competes with would be taken by the sequential rule too, whatever else happens; so a round
takes all such rows at once, drops what they rule out, and goes on with the rest. Better means a larger score, of equal
scores the smaller key; keys tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.session import checkpointed


def _around(reach: int) -> Column:
    return F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))).alias("n")


def spaced(points: DataFrame, key: str, score: str, spacing: float, most: int | None = None, least: float | None = None, examined: int | None = None) -> DataFrame:
    """key, x, y, score, rank: the best points, none nearer than `spacing` to a better one that was taken.

    Points lie in cells of spacing / sqrt(2), each of which can hold one taken point only: a round looks at the best point of
    each cell, first against the best of the cells around it, then against all their points. With `most`, points below the
    most-th best taken so far are let go, so few rounds see many points. Null scores and coordinates are left out."""
    p = points.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(score).cast("double").alias("s")).dropna()
    if least is not None:
        p = p.where(F.col("s") >= least)
    if examined is not None:
        p = p.orderBy(F.desc("s"), "key").limit(examined)
    side = spacing * 0.7071
    p = checkpointed(p.select("*", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    taken: DataFrame | None = None
    apart = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    ahead = (F.col("s") > F.col("s2")) | ((F.col("s") == F.col("s2")) & (F.col("key") < F.col("key2")))
    first = F.min(F.struct((-F.col("s")).alias("m"), "key", "x", "y", "s")).alias("b")
    as_second = lambda d: d.select(F.col("key").alias("key2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"), _around(2)).select("key2", "x2", "y2", "s2", "n.cx", "n.cy")
    unbeaten = lambda few, others: few.join(others.join(as_second(few), ["cx", "cy"]).where((apart < spacing * spacing) & ahead).select(F.col("key2").alias("key")).distinct(), "key", "left_anti")
    while not p.isEmpty():
        best = checkpointed(p.groupBy("cx", "cy").agg(first).select("b.key", "b.x", "b.y", "b.s", "cx", "cy"))
        won = checkpointed(unbeaten(checkpointed(unbeaten(best, best)), p).select("key", "x", "y", "s", "cx", "cy"))
        out = p.join(as_second(won), ["cx", "cy"]).where(apart < spacing * spacing).select("key").distinct()
        p, taken = p.join(out, "key", "left_anti"), won if taken is None else taken.unionByName(won)
        if most is not None:
            taken = checkpointed(taken.orderBy(F.desc("s"), "key").limit(most))
            last = taken.orderBy("s", F.desc("key")).first()
            if taken.count() >= most:
                p = p.where((F.col("s") > last.s) | ((F.col("s") == last.s) & (F.col("key") < last.key)))
        p = checkpointed(p)
    if taken is None:
        taken = p
    out = taken.select(F.col("key").alias(key), "x", "y", F.col("s").alias(score))
    if most is None:
        return out
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # `most` rows


def linked(pairs: DataFrame, most: int = 2) -> DataFrame:
    """a, b, distance: links taken nearest first while both ends have fewer than `most`; of equal distances the smaller a, then b.

    A link is sure to be taken once, at both its ends, fewer better links are undecided than the end has places left."""
    live, taken = checkpointed(pairs.select("a", "b", F.col("distance").cast("double").alias("distance"))), None
    used = live.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("used")).limit(0)
    while not live.isEmpty():
        ends = live.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("node"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("distance", "a", "b"))
        ranked = ends.withColumn("place", place).join(used, "node", "left").withColumn("room", F.lit(most) - F.coalesce("used", F.lit(0)))
        sure = ranked.groupBy("a", "b", "distance").agg(F.bool_and(F.col("place") <= F.col("room")).alias("sure"))
        won = checkpointed(sure.where("sure").select("a", "b", "distance"))
        taken = won if taken is None else taken.unionByName(won)
        new = won.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        used = checkpointed(used.unionByName(new).groupBy("node").agg(F.sum("used").alias("used")))
        full = used.where(F.col("used") >= most).select("node")
        live = live.join(won, ["a", "b"], "left_anti").join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
        live = checkpointed(live.select("a", "b", "distance"))
    return live if taken is None else taken


def spread(points: DataFrame, key: str, density: str, k: int, centre: tuple[float, float], span: float) -> DataFrame:
    """key, x, y, pick: k points, each far from those taken (0.72) and dense (0.28); the first is dense (0.65) and central (0.35).

    density is a share of its maximum. Far is the distance to the nearest taken point, up to a target spacing that follows
    from the span and k. Every pick is one pass over all points, which keep their distance to the nearest taken one."""
    target = max(12.0, span / max(k**0.5 * 1.6, 1.0))
    dist = lambda x, y: F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    p = points.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(density).cast("double").alias("d")).dropna()
    p = checkpointed(p.withColumn("far", dist(*(F.lit(c) for c in centre))))
    top = p.agg(F.max("far")).first()[0]
    chosen: list[tuple] = []
    score = F.lit(0.65) * F.col("d") + F.lit(0.35) * (F.lit(1.0) - F.col("far") / F.lit(max(top or 0.0, 1e-9)))
    while len(chosen) < k:
        best = p.agg(F.min(F.struct((-score).alias("m"), "key", "x", "y")).alias("b")).first().b
        if best is None:
            break
        away = dist(F.lit(best.x), F.lit(best.y))
        p = p.where(F.col("key") != best.key).withColumn("far", F.least("far", away) if chosen else away)
        chosen.append((best.key, best.x, best.y, len(chosen) + 1))
        if len(chosen) % 8 == 0:
            p = checkpointed(p)
        score = F.lit(0.72) * F.least(F.col("far") / target, F.lit(1.0)) + F.lit(0.28) * F.col("d")
    return points.sparkSession.createDataFrame(chosen, f"`{key}` {points.schema[key].dataType.simpleString()}, x double, y double, pick int")
