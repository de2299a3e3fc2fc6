"""Operators called from SQL."""

import pytest
from pyspark.sql import functions as F

from tablescope.functions import text as tx
from tablescope.functions.scalars import compact_number, percent_change
from tablescope.operators import privacy
from tablescope.plans.sql_functions import register


def test_scalar_functions_are_those_of_the_library(spark):
    register(spark)
    register(spark)
    rows = [("a\u202fb \u2013 c\u2014d", 1234.5, 1000.0), (None, None, 0.0), ("", 12.345, 0.0), (" two words ", -5.0, None)]
    df = spark.createDataFrame(rows, "t string, v double, base double")
    df.createOrReplaceTempView("scalar_rows")
    got = spark.sql("SELECT clean_text(t) a, word_count(t) b, percent_change(v, base) c, compact_number(v) d, value_token(t, 's', 'n') e FROM scalar_rows")
    want = df.select(
        tx.clean_text(F.col("t")).alias("a"), tx.word_count(F.col("t")).alias("b"), percent_change(F.col("v"), F.col("base")).alias("c"),
        compact_number(F.col("v")).alias("d"), privacy.token(F.col("t"), "s", "n").alias("e"),
    )
    assert got.dtypes == want.dtypes and got.collect() == want.collect()


def test_table_functions(spark):
    register(spark)
    rows = [("a", k, float(2 * k + 1)) for k in range(50)] + [("b", 1, 5.0), ("c", 1, 3.0), ("c", 2, None), ("c", 3, 3.0), ("d", 1, None)]
    spark.createDataFrame(rows, "g string, d int, v double").createOrReplaceTempView("trend_rows")
    got = spark.sql("SELECT * FROM trend_of(TABLE(trend_rows) PARTITION BY g ORDER BY d)")
    assert got.columns == ["g", "n", "slope", "r2"]
    assert {r.g: (r.n, r.slope and round(r.slope, 9), r.r2 and round(r.r2, 9)) for r in got.collect()} == {"a": (50, 2.0, 1.0), "b": (1, None, None), "c": (2, 0.0, 0.0), "d": (0, None, None)}
    spark.createDataFrame([(1, "about 12.5K of 7"), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("mention_rows")
    found = spark.sql("SELECT * FROM mentions_of(TABLE(mention_rows))")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "12.5K"), (1, 1, "7")]
    with pytest.raises(Exception, match="at least 2 columns"):
        spark.sql("SELECT * FROM trend_of(TABLE(SELECT g FROM trend_rows))").collect()
