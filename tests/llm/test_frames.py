"""Batches that go to Python."""

import pyarrow as pa
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, language
from tablescope.llm.frames import small_batches


def test_batches_are_bounded_by_bytes_not_rows(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    session = spark.newSession()
    small_batches(session)
    wide = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 2998, 3000).otherwise(3 << 20).cast("int")).alias("text"))
    found = wide.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(x.rows for x in found) == 3000 and all(x.rows < 400 for x in found)
    narrow = session.range(0, 20_000, 1, 1).mapInArrow(sizes, "rows long, bytes long").collect()
    assert [x.rows for x in narrow] == [10_000, 10_000]
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") == "1000"


def test_texts_are_expanded_a_megabyte_at_a_time():
    assert language.PART_BYTES <= 1 << 20 and decontaminate.SHARD_BYTES <= 1 << 20
