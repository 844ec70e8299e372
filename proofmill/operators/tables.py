"""Steps that are written once to the folder that driver and executors share, so that plans built on them do not repeat them and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="proofmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over two tasks for each core, by the hash of keys: a small file is read by one task, whatever the work on its rows costs. The number is given, so it is not cut down to
    what the bytes need; rows are streams, and each task sets large expressions up anew, so more tasks cost time and save none."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/proofmill/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
