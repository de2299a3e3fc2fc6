"""Runs on disk: whole commits only, columns of all runs, differences."""

import pytest
from pyspark.sql import functions as F

from tablescope.sources import stores


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids_of_any_characters_and_replaced_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for run, n in (("a/b", 1), ("a/c", 2), ("a", 3), ("a=b", 4), ("007", 5), ("7", 6), ("a/b", 7)):
        stores.save_findings({"t": spark.range(n)}, folder, run)
    got = stores.load_findings(spark, folder, "t").groupBy("run_id").count()
    assert rows(got) == sorted([("a/b", 7), ("a/c", 2), ("a", 3), ("a=b", 4), ("007", 5), ("7", 6)])
    assert stores.load_findings(spark, folder, "t", "a/b").count() == 7
    with pytest.raises(ValueError, match="no table"):
        stores.load_findings(spark, folder, "t", "b")


def test_a_save_that_dies_leaves_the_old_run(spark, tmp_path):
    folder = str(tmp_path / "runs")
    stores.save_findings({"a": spark.range(2), "b": spark.range(2)}, folder, "r")
    bad = spark.range(3).select(F.raise_error(F.lit("dies")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        stores.save_findings({"a": spark.range(9), "b": bad}, folder, "r")
    assert stores.load_findings(spark, folder, "a", "r").count() == 2
    assert stores.load_findings(spark, folder, "b").count() == 2


def test_columns_of_all_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    stores.save_findings({"t": spark.createDataFrame([(1, "x")], "k int, s string")}, folder, "old")
    stores.save_findings({"t": spark.createDataFrame([("y", 2.5, 3)], "s string, v double, k bigint")}, folder, "new")
    stores.save_findings({"t": spark.createDataFrame([], "k int, s string")}, folder, "none")
    got = stores.load_findings(spark, folder, "t")
    assert got.columns == ["k", "s", "v", "run_id"]
    assert rows(got.fillna({"v": -1.0})) == [("1", "x", -1.0, "old"), ("3", "y", 2.5, "new")]
    assert dict(stores.load_findings(spark, folder, "t", "new").dtypes)["k"] == "bigint"


def test_difference(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (3, "c", 3.0), (None, "n", 1.0)], "k int, s string, v double")
    after = spark.createDataFrame([(1, "a", 1.0, 9), (2, None, 2.0, None), (None, "m", 1.0, None), (4, "d", 4.0, None)], "k int, s string, v double, w int")
    got = stores.findings_difference(before, after, ["k"])
    assert sorted((r.k or 0, r.change, r.changed_columns) for r in got.collect()) == [
        (0, "changed", ["s"]), (1, "changed", ["w"]), (2, "changed", ["v"]), (3, "gone", []), (4, "added", []),
    ]
    assert stores.findings_difference(before, before, ["k"]).count() == 0
    assert stores.findings_difference(before.limit(0), after.limit(0), ["k", "s"]).count() == 0
