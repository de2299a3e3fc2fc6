"""Dates of mixed forms: readings by joint evidence, and what isn't read."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablescope.functions.dates import read_dates


def read(spark, values, keys=None):
    df = spark.createDataFrame([(k if keys is None else keys[k], v) for k, v in enumerate(values)], "k bigint, day string")
    reading = read_dates(df, "day", "k" if keys is not None else None)
    got = [r.t for r in df.select(reading.parsed(F.col("day")).alias("t")).collect()]
    return got, {r.form: tuple(r)[1:] for r in reading.evidence.collect()}


def test_every_form(spark):
    values = ["2024-01-05", "2024-1-5T10:30", "2024/01/05", "20240105", "Jan 5, 2024", "January 5 2024", "sept. 5, 2024", "5 Jan 2024", "05-JAN-24", "5. February 1968", "1/25/69", "1/25/68", None, "soon", "Janus 5, 2024", "2024-13-45"]
    got, evidence = read(spark, values)
    assert got[:10] == [datetime(2024, 1, 5), datetime(2024, 1, 5, 10, 30), datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 9, 5), datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(1968, 2, 5)]
    assert got[10:12] == [datetime(1969, 1, 25), datetime(2068, 1, 25)] and got[12:] == [None] * 4
    assert evidence["unread"][1] == 3 and evidence["y-m-d"] == ("ymd", 3, 2, 0, "form") and evidence["a/b/y"] == ("mdy", 2, 2, 0, "impossible days")


def test_impossible_days_settle_the_rest(spark):
    got, evidence = read(spark, ["05/02/2024", "25/02/2024", "02/02/2024", "04.05.24", "31.05.24"])
    assert [t.month for t in got] == [2, 2, 2, 5, 5]
    assert evidence == {"a/b/y": ("dmy", 3, 3, 1, "impossible days"), "a.b.y": ("dmy", 2, 2, 1, "impossible days")}
    mixed, found = read(spark, ["01/25/2024", "01/26/2024", "27/01/2024", "03/04/2024"])
    assert [(t.month, t.day) for t in mixed] == [(1, 25), (1, 26), (1, 27), (3, 4)] and found["a/b/y"] == ("mdy", 4, 4, 1, "impossible days")


def test_order_along_a_key_and_constant_day(spark):
    days = [f"{d:02d}-{m:02d}-2024" for m in range(1, 7) for d in (2, 7, 11)]
    got, evidence = read(spark, days, list(range(len(days))))
    assert evidence["a-b-y"][0] == "dmy" and evidence["a-b-y"][4] == "order along key" and [t.month for t in got] == [m for m in range(1, 7) for _ in range(3)]
    monthly, why = read(spark, [f"01/{m:02d}/2024" for m in range(2, 12)])
    assert [t.month for t in monthly] == list(range(2, 12)) and why["a/b/y"][4] == "constant day"
    _, doubt = read(spark, ["01/02/2024", "03/04/2024"])
    assert doubt["a/b/y"] == ("mdy", 2, 2, 2, "default")


@pytest.mark.parametrize("values", [[], [None], ["x"]])
def test_nothing_to_read(spark, values):
    got, evidence = read(spark, values)
    assert got == [None] * len(values) and (not evidence or evidence["unread"][1] == 1)
