"""What the operators of this subpackage share: reading tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.session import shared_folder

#: Rows of one Arrow batch handed to Python; whole texts are long, so batches are short.
BATCH_ROWS = 256
#: Bytes at which a batch is closed early.
BATCH_BYTES = 8 << 20
#: Stands for a null doc_id inside packed arrays: nulls order after every id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS, n_bytes: int = BATCH_BYTES) -> None:
    """Arrow batches of whole texts must stay small: larger settings of the session are lowered, lower ones are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", n_bytes)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; clear_scratch() deletes it."""
    return f"{shared_folder(spark)}/cityweave-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts lineage for good."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned and that no plan reads any more."""
    drop_path(df.sparkSession, df.scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results must have been read or written before."""
    drop_path(spark, scratch_folder(spark))


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that owns it."""
    p, system = _hadoop_path(spark, path)
    system.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, system = _hadoop_path(spark, path)
    return system.exists(p)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, lengthened where df has a column of that name already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """So many partitions that each holds about `each` bytes, and no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // each), 1)


#: What operators remember in a Python worker from task to task, by operator.
_remembered: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """A dictionary of this worker that lasts until a task of another operator begins."""
    return _remembered.setdefault(operator, {})


def let_go(but: str) -> list[str]:
    """Forget what all other operators remembered in this worker; returns whose it was."""
    others = [k for k in _remembered if k != but]
    for k in others:
        del _remembered[k]
    return others


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, operator: str = "") -> DataFrame:
    """mapInArrow over short batches. Workers outlive stages, so a task first lets go of what other operators remembered."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(operator)  # by name: a global of this closure would be a copy in the worker
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart; null and empty texts differ from each other."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))


def held_out(doc_id: Column, remainder: int) -> Column:
    """crc32 of the id's decimal text mod 5 equals `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int | None, most_bytes: int | None, id_col: str, text_col: str, label_col: str, tag: str) -> DataFrame:
    """text, y: one row for each of at most `most_rows` labelled ids, of at most `most_bytes` of text together, as a table;
    without these bounds (None) for each labelled id.

    Ids come in the order of a hash; the texts of the first of them that fit the bytes are taken whole. Of an id's labels the
    largest counts, of its texts that of the smallest hash; null ids, labels and texts are left out."""
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    if most_rows is not None:
        y = F.broadcast(y.orderBy(F.xxhash64("id"), "id").limit(most_rows))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(text_hash(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).alias("x"))
    one = materialize(rows.join(y, "id").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).select("id", "x.text", "y"), tag)
    if most_bytes is None:
        return one.select("text", "y")
    # with `most_rows`, that many sizes at most, in one task
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    fits = one.select("id", before.alias("so_far")).where(F.col("so_far") <= most_bytes).select("id")
    return one.join(F.broadcast(fits), "id").select("text", "y")
