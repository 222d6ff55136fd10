"""Designs and runs as versioned tables: edits, catalogues, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(objects: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of the same key."""
    return objects.join(changes.select(key), key, "left_anti").unionByName(changes)


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: fields that aren't null in changes replace those of the row."""
    fields = [c for c in rows.columns if c != key and c in changes.columns]
    c = changes.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return rows.join(c, key, "left").select(*(F.coalesce(f"_{f}", f).alias(f) if f in fields else F.col(f) for f in rows.columns))


def retire(objects: DataFrame, alive: DataFrame, key: str) -> DataFrame:
    """Objects whose key is alive."""
    return objects.join(alive.select(key).distinct(), key, "left_semi")


def paint(cells: DataFrame, row0: int, col0: int, values: list[list[int]], layer: str, editable: Column) -> DataFrame:
    """A rectangle of values written where cells are editable; parts off the grid fall away."""
    flat = [(row0 + i, col0 + j, v) for i, line in enumerate(values) for j, v in enumerate(line)]
    p = cells.sparkSession.createDataFrame(flat, f"row long, col long, _v {dict(cells.dtypes)[layer]}")
    return cells.join(F.broadcast(p), ["row", "col"], "left").withColumn(layer, F.when(F.col("_v").isNotNull() & editable, F.col("_v")).otherwise(F.col(layer))).drop("_v")


def clear_rect(cells: DataFrame, r0: int, c0: int, r1: int, c1: int, layer: str, base: str) -> DataFrame:
    """Cells of a rectangle go back to the base layer."""
    inside = F.col("row").between(r0, r1) & F.col("col").between(c0, c1)
    return cells.withColumn(layer, F.when(inside, F.col(base)).otherwise(F.col(layer)))


def run_catalogue(runs: DataFrame, meta: DataFrame, run: str, newest: str) -> DataFrame:
    """Runs with their optional results: finished tells whether there are some."""
    m = meta.withColumn("_m", F.lit(True))
    return runs.join(m, run, "left").withColumn("finished", F.coalesce("_m", F.lit(False))).drop("_m").withColumn("position", F.row_number().over(Window.orderBy(F.desc(newest), run)))


def cell_difference(a: DataFrame, b: DataFrame, layer: str) -> DataFrame:
    return a.select("row", "col", F.col(layer).alias("a")).join(b.select("row", "col", F.col(layer).alias("b")), ["row", "col"]).select("row", "col", (F.col("b") - F.col("a")).alias("difference"))


def storm_errors(storms: DataFrame) -> DataFrame:
    """Storms (storm, steps array<array<double>>) that can't run, and why."""
    why = F.when(F.col("steps").isNull() | (F.size("steps") == 0), "no steps").when(F.exists("steps", lambda s: F.size(s) != 3), "a step needs three values").when(F.exists("steps", lambda s: F.get(s, F.lit(1)) <= F.get(s, F.lit(0))), "a step ends before it begins")
    return storms.select("storm", why.alias("error")).where("error is not null")


def storm_totals(storms: DataFrame) -> DataFrame:
    """total_mm and duration (the last end plus half an hour) of storms."""
    mm = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + (s[1] - s[0]) * s[2] / 3600.0)
    return storms.select("storm", mm.alias("total_mm"), (F.array_max(F.transform("steps", lambda s: s[1])) + 1800.0).alias("duration"))


def first_of(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All rows of primary, and those of fallback whose key primary lacks."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti"))


def scale_series(peaks: DataFrame, by: list[str], order: str, peak: str) -> DataFrame:
    """Display scale over time: 1.1 times the peak ratchets it up, one under half of it sets it anew, else it decays by a tenth."""
    s = F.array_sort(F.collect_list(F.struct(order, peak)))
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0))

    def step(acc: Column, x: Column) -> Column:
        want = x[peak] * 1.1
        moved = F.when((want > last(acc)) | (want < 0.5 * last(acc)), F.greatest(want, F.lit(1e-6))).otherwise(F.greatest(want, last(acc) * 0.9, F.lit(1e-6)))
        return F.concat(acc, F.array(F.when(x[peak] > 0, moved).otherwise(last(acc))))

    g = peaks.groupBy(*by).agg(s.alias("s")).withColumn("e", F.aggregate("s", F.array().cast("array<double>"), step))
    return g.select(*by, F.explode(F.arrays_zip("s", "e")).alias("x")).select(*by, F.col(f"x.s.{order}").alias(order), F.col("x.e").alias("scale"))
