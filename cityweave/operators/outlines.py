"""Outlines of masks: the sides between cells and what lies outside, chained into rings by doubling pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.session import checkpointed, rewritten


def sides(cells: DataFrame) -> DataFrame:
    """id, row, col, x1, y1, x2, y2: a cell's sides that no other cell shares, the cell to the same hand of each (x = col, y = row)."""
    r, c = F.col("row"), F.col("col")
    # side: where it begins and ends, and the cell beyond it
    four = [(0, 0, 1, 0, -1, 0), (1, 0, 1, 1, 0, 1), (1, 1, 0, 1, 1, 0), (0, 1, 0, 0, 0, -1)]
    names = ("x1", "y1", "x2", "y2", "nr", "nc")
    each = [F.struct(F.lit(k).alias("side"), *(v.alias(n) for n, v in zip(names, (c + a, r + b, c + d, r + e, r + i, c + j)))) for k, (a, b, d, e, i, j) in enumerate(four)]
    x = cells.select("row", "col").distinct().withColumn("s", F.explode(F.array(*each))).select("row", "col", "s.*")
    there = cells.select(F.col("row").alias("nr"), F.col("col").alias("nc")).distinct()
    return x.join(there, ["nr", "nc"], "left_anti").select((r * F.lit(2**32) + c * 4 + F.col("side")).alias("id"), "row", "col", "x1", "y1", "x2", "y2")


def rings(cells: DataFrame) -> DataFrame:
    """ring, pos, id, row, col, x, y: the corners of each ring in order; a ring is named by its smallest side.

    Where two cells meet at a corner only, a ring stays with its cell, so rings are those of regions of four directions; rings
    round holes run the other way. Cells lie in 0 <= col < 2^29. Rounds are twice the logarithm of the longest ring."""
    s = checkpointed(sides(cells))
    after = s.select(F.col("id").alias("next"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    own = ((F.col("row") == F.col("r2")) & (F.col("col") == F.col("c2"))).cast("int")
    chain = checkpointed(s.join(after, ["x2", "y2"]).groupBy("id").agg(F.max_by("next", own).alias("next")))
    state = chain.select("id", "next", F.least("id", "next").alias("low"))
    while True:  # the smallest side of the ring: each round looks twice as far ahead
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("low").alias("low2"))
        state = rewritten(state.join(ahead, "next").select("id", F.col("then").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        if state.where("moved").isEmpty():
            break
    named = checkpointed(chain.join(state.select("id", F.col("low").alias("ring")), "id"))
    far = named.select("id", "ring", "next", F.lit(1).cast("long").alias("steps"))
    go = F.col("next") != F.col("ring")
    while not far.where(go).isEmpty():  # steps to the ring's first side, where pointers stop; one that stopped meets itself
        ahead = far.select(F.col("id").alias("at"), F.col("next").alias("then"), F.col("steps").alias("more"))
        met = far.withColumn("at", F.when(go, F.col("next")).otherwise(F.col("id"))).join(ahead, "at")
        far = rewritten(met.select("id", "ring", F.when(go, F.col("then")).otherwise(F.col("next")).alias("next"), (F.col("steps") + F.when(go, F.col("more")).otherwise(0)).alias("steps")))
    size = far.groupBy("ring").agg(F.max("steps").alias("n"))
    place = far.join(size, "ring").select("id", "ring", (F.col("n") - F.col("steps")).alias("pos"))
    return place.join(s, "id").select("ring", "pos", "id", "row", "col", F.col("x1").alias("x"), F.col("y1").alias("y"))


def measured(found: DataFrame) -> DataFrame:
    """ring, corners, area (negative round holes), row, col (its first side's cell) of rings."""
    step = {0: (1, 0), 1: (0, 1), 2: (-1, 0), 3: (0, -1)}
    side = F.pmod(F.col("id"), F.lit(4))
    dx, dy = (F.coalesce(*(F.when(side == k, v[i]) for k, v in step.items())) for i in (0, 1))
    twice = F.col("x") * (F.col("y") + dy) - (F.col("x") + dx) * F.col("y")
    first = F.min_by(F.struct("row", "col"), "id")
    return found.groupBy("ring").agg(F.count("*").alias("corners"), (F.sum(twice) / 2).alias("area"), first.alias("c")).select("ring", "corners", "area", "c.row", "c.col")


def longest(found: DataFrame, every: int = 1) -> DataFrame:
    """ring, pos, x, y: every so many corners of the ring with most corners (of equals the smallest ring)."""
    top = found.groupBy("ring").count().orderBy(F.desc("count"), "ring").limit(1).select("ring")
    return found.join(F.broadcast(top), "ring").where(F.col("pos") % every == 0).select("ring", "pos", "x", "y")
