"""Sharding by fixed virtual slots.

Every record hashes into one of `SLOTS` slots, whatever the number of shards. Bytes are summed per slot, and a versioned
map from slots to shards is edited when shards are rebalanced: as few slots as needed move from heavy to light shards,
the others stay. Versions of a map are kept side by side in one table, so an older layout can be read again.

The law that holds is `bytes`: shards are near equal in size. (The map depends on the bytes of the slots, so doc_id and
shard count alone don't decide, and grown_shard is null.)

A run goes on from the last version at the map's path: it edits that version for the bytes of its rows and saves the next
one, or none where nothing moves. A version is a folder of its own that a repeated run overwrites.

Defined cases: null text has no bytes and size 1; null ids hash like any other value; rows of one id and text share a slot
unless they are more than `REPEATS`, which spread over the slots by their place among each other, however the table is
partitioned; groups of equal texts aren't kept together, as one may hold a third of all bytes; an empty table leaves the map as it is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.base import free_names, fresh_path, materialize, path_exists

SLOTS = 8192
SHARDS = 16
#: Shards may differ from the mean by this share before slots move ...
TOLERANCE = 0.0005
#: Rows of one id and text beyond which they are spread over the slots.
REPEATS = 1000


def first_map(slots: int, shards: int) -> np.ndarray:
    return np.arange(slots, dtype=np.int64) % shards


def rebalance(where: np.ndarray, weight: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """An edited copy of the slot-to-shard map: shards near equal in weight, few slots moved.

    Slots of shards that are gone move first; then the heaviest shard gives the lightest the slot that evens them best,
    or exchanges two slots, until they differ by less than the tolerance or no step helps.
    """
    where, weight = where.copy(), weight.astype(np.int64)
    lost = np.flatnonzero(where >= shards)
    where[lost] = 0
    load = np.bincount(np.delete(where, lost), np.delete(weight, lost), shards).astype(np.int64)
    for s in lost[np.argsort(-weight[lost], kind="stable")]:
        where[s] = int(load.argmin())
        load[where[s]] += weight[s]
    small = max(1, int(tolerance * load.sum() / shards))
    for _ in range(4 * len(where)):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        if gap <= small:
            break
        mine = np.flatnonzero((where == hi) & (weight > 0))
        fits = mine[weight[mine] < gap]
        move = fits[np.abs(weight[fits] - gap / 2).argmin()] if len(fits) else None
        gain = gap - abs(gap - 2 * int(weight[move])) if move is not None else 0
        back = None
        if gain < gap * 0.9:  # a pair may fit better than one slot
            theirs = np.flatnonzero((where == lo) & (weight > 0))
            theirs = theirs[np.argsort(weight[theirs], kind="stable")]
            if len(theirs) and len(mine):
                at = np.clip(np.searchsorted(weight[theirs], weight[mine] - gap / 2), 0, len(theirs) - 1)
                step = weight[mine] - weight[theirs[at]]
                score = np.where((step > 0) & (step < gap), gap - np.abs(gap - 2 * step), -1)
                if score.max() > gain:
                    k = int(score.argmax())
                    move, back, gain = mine[k], theirs[at[k]], int(score[k])
        if gain <= 0:
            break
        where[move] = lo
        load[hi] -= weight[move]
        load[lo] += weight[move]
        if back is not None:
            where[back] = hi
            load[hi] += weight[back]
            load[lo] -= weight[back]
    return where


def save_map(spark: SparkSession, path: str, version: int, where: np.ndarray) -> None:
    """Write one version; its folder is overwritten, so a repeated run changes nothing."""
    rows = [(int(s), int(k)) for s, k in enumerate(where)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """version, virtual_slot, shard of one version, by default the last."""
    t = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    return t.where(F.col("version") == (version if version is not None else t.agg(F.max("version")).first()[0])).select("version", "virtual_slot", "shard")


def last_map(spark: SparkSession, path: str, slots: int) -> tuple[int, np.ndarray] | None:
    """(version, shard of each slot) of the last version; None where there is none yet."""
    rows = load_map(spark, path).collect() if path_exists(spark, path) else []
    if not rows:
        return None
    if sorted(r.virtual_slot for r in rows) != list(range(slots)):
        raise ValueError(f"the map at {path} has {len(rows)} slots, not {slots}; their number is fixed for good")
    where = np.zeros(slots, np.int64)
    for r in rows:
        where[r.virtual_slot] = r.shard
    return rows[0].version, where


def virtual_slot(slots: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(slots)).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard, virtual_slot, map_version."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "size", "text_crc32"]
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "records")
    # more rows of one record than this are told apart by their place among each other, so that no slot holds them all
    many = numbered.groupBy(*key).count().where(F.col("count") > REPEATS).select(*(F.col(k).alias(f"{k}_") for k in key), F.lit(True).alias("many"))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_crc32") == F.col("text_crc32_")) & (F.col("size") == F.col("size_"))
    marked = numbered.join(many, same, "left").select(*key, "row", "many", F.shiftright("row", 33).alias("part"))
    # places by input partition: numbers within it, and how many came in the partitions before
    repeats = marked.where("many").withColumn("here", F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1)
    each = marked.where("many").groupBy(*key, "part").agg(F.count("*").alias("n"))  # a row a partition
    each = each.select(*(F.col(k).alias(f"{k}_") for k in key), F.col("part").alias("part_"), (F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).alias("before"))
    placed = repeats.join(each, same & (F.col("part") == F.col("part_"))).select(*key, "row", (F.col("before") + F.col("here")).alias("salt"))
    salted = marked.where("many IS NULL").select(*key, "row", F.lit(0).cast("long").alias("salt")).unionByName(placed)
    salt = F.col("salt")
    narrow = materialize(salted.select(*key, "row", virtual_slot(slots, F.col("doc_id"), F.col("text_crc32"), salt).alias("virtual_slot")), "records")
    sums = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # `slots` rows at most
    weight, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in sums:
        weight[r.virtual_slot], count[r.virtual_slot] = r.bytes, r.n
    path = map_path or fresh_path(spark, "slot-map")
    last = last_map(spark, path, slots)
    if last is None:
        last = 1, first_map(slots, shards)
        save_map(spark, path, *last)
    version, where = last[0], rebalance(last[1], weight, shards)
    if (where != last[1]).any():
        version += 1
        save_map(spark, path, version, where)
    before = np.zeros(slots, np.int64)
    for s in range(shards):
        own = np.flatnonzero(where == s)
        before[own] = np.cumsum(count[own]) - count[own]
    base = spark.createDataFrame([(k, int(before[k])) for k in range(slots)], "virtual_slot int, base long")
    layout = load_map(spark, path, version).join(F.broadcast(base), "virtual_slot")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "row"))
    return (
        narrow.withColumn("place", place)
        .join(F.broadcast(layout), "virtual_slot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
    )


def write_shards(docs: DataFrame, layout: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write docs under path/shard=N by a layout that assign() returned. Ids must be unique; docs has no columns shard or slot."""
    (own,) = free_names(docs, "layout_id")
    placed = docs.join(layout.select(F.col("doc_id").alias(own), "shard", "slot"), F.col(id_col).eqNullSafe(F.col(own))).drop(own)
    placed.repartition("shard", F.pmod("slot", F.lit(64))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
