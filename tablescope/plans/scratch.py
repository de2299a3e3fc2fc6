"""Written tables in the folder that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`. Only a local session without one gets a fresh /tmp folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back, so later branches share one set of rows and a short lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nobody refers to any more, before the next large shuffle.

    Python hands its dropped frames over to the JVM from a thread of its own, hence the short waits and the second round.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()
