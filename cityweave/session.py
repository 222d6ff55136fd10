"""The session's shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of our own, kept for the session: in the warehouse on a
    cluster, whose executors share no local folders, and a temporary one where driver and executors are one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="cityweave-")
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cityweave-{context.applicationId}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder, without its lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back, for loops that join a table with itself.

    A checkpoint keeps the planner's estimate of its size, which such a loop squares in every round: a number of 2^rounds digits."""
    path = f"{shared_folder(df.sparkSession)}/cityweave-{df.sparkSession.sparkContext.applicationId}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
