"""Numbers and running sums in a global order without one task that sees all rows: ranges, then offsets of the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.session import checkpointed


def _ranges(df: DataFrame, order: list) -> DataFrame:
    """df in ranges of the order, each sorted, with _part and _at (place in it); fixed by a checkpoint."""
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return checkpointed(ids.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))


def numbered(df: DataFrame, *order, name: str = "number", start: int = 0) -> DataFrame:
    """df with the place of each row in a total order; the order's columns should tell all rows apart."""
    r = _ranges(df, list(order))
    sizes = r.groupBy("_part").count()  # as many rows as ranges
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count") + start).alias("_before"))
    return r.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_sum(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """df with column_sum for each column: its sum over all rows up to this one; order tells all rows apart."""
    r = _ranges(df, [order])
    sums = r.groupBy("_part").agg(*(F.sum(c).alias(c) for c in columns))
    w = Window.orderBy("_part")
    before = sums.select("_part", *((F.sum(c).over(w) - F.col(c)).alias(f"_{c}") for c in columns))
    here = Window.partitionBy("_part").orderBy("_at")
    out = r.join(F.broadcast(before), "_part")
    for c in columns:
        out = out.withColumn(f"{c}_sum", F.sum(c).over(here) + F.col(f"_{c}"))
    return out.drop("_part", "_at", *(f"_{c}" for c in columns))
