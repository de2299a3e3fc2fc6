"""Profile new delimited files of a landing folder, each file once, and all files so far without reading them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablescope.functions import fixed_values as fx
from tablescope.operators.profile import column_profile, table_profile
from tablescope.operators.sketches import merge_states, profile_of_states, profile_state
from tablescope.sources.readers import missing_to_null, nan_to_null


def landing_stream(
    spark: SparkSession, folder: str, schema: str | T.StructType, max_files: int | None = None, encoding: str = "UTF-8",
    missing: tuple[str, ...] = fx.MISSING_WORDS, **options
) -> DataFrame:
    """New files as `read_csv` reads them: quotes doubled inside quotes, words of `missing` and NaN are null."""
    reader = spark.readStream.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return nan_to_null(missing_to_null(reader.csv(folder), missing))


def profile_landing(
    spark: SparkSession,
    folder: str,
    schema: str | T.StructType,
    out: str,
    name: str,
    max_files: int | None = None,
    encoding: str = "UTF-8",
    each_batch: bool = True,
    **options,
) -> StreamingQuery:
    """Take in all files that are new since the last call and write their rows, profiles and mergeable state, per batch.

    A batch that runs again after a failure overwrites its own folder below `name=`, so nothing is counted twice; the list of
    files that were taken in lies beside the results. Without `each_batch` a batch leaves its rows and its state only.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        place = f"name={name}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{out}/rows/{place}")
        rows = spark.read.schema(batch.schema).parquet(f"{out}/rows/{place}")
        profile_state(rows).write.mode("overwrite").parquet(f"{out}/state/{place}")
        if each_batch:
            table_profile(rows).write.mode("overwrite").parquet(f"{out}/table_profile/{place}")
            column_profile(rows).write.mode("overwrite").parquet(f"{out}/column_profile/{place}")

    return (
        landing_stream(spark, folder, schema, max_files, encoding, **options)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{out}/checkpoint/{name}")
        .trigger(availableNow=True)
        .start()
    )


def landing_states(spark: SparkSession, out: str, name: str | None = None) -> DataFrame:
    """The states of all batches taken in, of one intake or of all."""
    states = spark.read.parquet(f"{out}/state")
    return (states if name is None else states.where(F.col("name").cast("string") == name)).drop("name", "batch")


def landing_total(spark: SparkSession, out: str, name: str | None = None) -> DataFrame:
    """The column profile of every row taken in so far, from the stored states alone."""
    return profile_of_states(landing_states(spark, out, name))


def landing_state(spark: SparkSession, out: str, name: str | None = None) -> DataFrame:
    """The merged state, to be stored or merged with that of other folders."""
    return merge_states(landing_states(spark, out, name))
