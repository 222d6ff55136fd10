"""Heights of the ground along paths, sampled at even steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators import grids


def samples(vertices: DataFrame, spacing: float) -> DataFrame:
    """path_id, i, x, y, length, count: even places along paths (path_id, pos, x, y), both ends included.

    A path of length L has max(2, floor(L / spacing) + 2) samples. Each piece of a path makes its own, so nothing is searched;
    a path without length has two at its beginning, and one of a single vertex has none."""
    w = Window.partitionBy("path_id").orderBy("pos")
    whole = Window.partitionBy("path_id")
    p = vertices.select("path_id", "pos", "x", "y", F.lead("x").over(w).alias("nx"), F.lead("y").over(w).alias("ny")).where("nx IS NOT NULL AND ny IS NOT NULL")
    p = p.withColumn("_l", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    p = p.withColumn("_end", F.sum("_l").over(w)).withColumn("length", F.max("_end").over(whole)).withColumn("_last", F.lead("pos").over(w).isNull())
    p = p.withColumn("_from", F.lag("_end", 1, 0.0).over(w)).withColumn("count", F.greatest(F.lit(2), F.floor(F.col("length") / spacing) + 2).cast("int"))
    step = F.col("length") / (F.col("count") - 1)
    begins = lambda c: F.when(step > 0, F.ceil(F.try_divide(F.col(c), step) - 1e-9)).otherwise(0).cast("int")
    p = p.withColumn("_a", begins("_from")).withColumn("_z", F.when(F.col("_last"), F.col("count") - 1).otherwise(begins("_end") - 1))
    p = p.where("_a <= _z").withColumn("i", F.explode(F.sequence("_a", "_z")))
    share = F.coalesce(F.least(F.greatest(F.try_divide(F.col("i") * step - F.col("_from"), F.col("_l")), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return p.select("path_id", "i", (F.col("x") + share * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("ny") - F.col("y"))).alias("y"), "length", "count")


def heights_along(vertices: DataFrame, cells: DataFrame, layer: str, spacing: float = 5.0, res: float = 1.0, padded: bool = False) -> DataFrame:
    """path_id, length, count, profile: heights between the centres of cells (the first at 0, 0; `res` apart) at each sample, 0 off the grid.

    Padded profiles have zeros up to the longest one's count."""
    s = samples(vertices, spacing)
    at = s.select(F.struct("path_id", "i", "length", "count").alias("point_id"), (F.col("y") / res).alias("row"), (F.col("x") / res).alias("col"))
    z = grids.bilinear(cells, layer, at).select("point_id.*", "value")
    out = z.groupBy("path_id", "length", "count").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("profile"))
    if padded:
        most = s.agg(F.max("count").alias("_most"))
        out = out.crossJoin(F.broadcast(most)).withColumn("profile", F.concat("profile", F.array_repeat(F.lit(0.0), F.col("_most") - F.col("count")))).drop("_most")
    return out
