"""Small helpers over whole frames: memory and disk of those that are done with, bounded samples."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.plans.scratch import release  # noqa: F401 (memory and disk belong together)


def smallest_hashes(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """At most `rows` rows: those with the smallest hashes of `keys`, in that order.

    A bound on the hash, from the counted rows, leaves about twice as many before anything is sorted, so tasks don't each
    hand on `rows` rows of a large table.
    """
    count = df.count()
    digest = F.xxhash64(*keys)
    if count > 2 * rows:
        df = df.where(digest < F.lit(-(1 << 63) + int((1 << 64) * (2 * rows / count))))
    return df.orderBy(digest, *keys).limit(rows)


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Lets about `size` bytes go to Python at once from now on, or one row: ten thousand texts can be a large part of a worker's
    memory, and twice that of the JVM, whereas narrow rows are best handed over by the ten thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name).lower().removesuffix("b")
    if not known.isdigit() or int(known) > size:
        spark.conf.set(name, str(size))


def tidy(run):
    """`run` for mapInArrow, with the memory that a task has used given back to the system at its end.

    Workers serve many tasks, also of later jobs, and otherwise each keeps the most it ever needed.
    """

    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only this C library knows it
            pass

    return tidied
