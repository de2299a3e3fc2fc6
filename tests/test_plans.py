"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tablescope.catalog.inputs import LINE_KEYS
from tablescope.functions import text as tx
from tablescope.operators import charts, checks, findings, groups, order, privacy, profile

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(text: str) -> list[str]:
    return re.findall(r"Exchange ([a-z]+)", text)


def test_group_statistics_shuffle_groups_once(lines):
    p = plan(groups.group_stats(lines, ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"]))
    assert shuffles(p) == ["hashpartitioning"] and p.count("HashAggregate") == 2 and "Expand" in p
    assert "l_extendedprice" not in p and "l_orderkey" not in p


def test_trend_has_one_range_shuffle_and_no_row_window(lines):
    p = plan(findings.trend(lines, ["l_quantity"], "l_shipdate", LINE_KEYS))
    assert shuffles(p).count("rangepartitioning") == 1
    above_ranges = p.split("rangepartitioning")[0]
    assert "HashAggregate(keys=[_range" in above_ranges  # only per-range rows reach the window
    assert "l_extendedprice" not in p


def test_metric_passes_do_not_shuffle_rows(lines):
    for df in (findings.outliers(lines, ["l_quantity"]), findings.correlations(lines, ["l_quantity", "l_tax"])):
        assert set(shuffles(plan(df))) <= {"single"} or "SinglePartition" in plan(df)


def test_projection_only_text_checks(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (
        checks.report_check(documents, "text", "doc_id"),
        documents.select(tx.clean_text(F.col("text"))),
        privacy.tokenise(documents, ["source"], "s"),
    ):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_searches_inside_texts_move_no_text(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert "ArrowEvalPython" in plan(documents.select(tx.json_payload(F.col("text"))))
    mentions = plan(tx.number_mentions(documents, "doc_id", "text"))
    assert mentions.count("MapInArrow") == 1 and "Exchange" not in mentions and "Window" not in mentions


def test_sample_is_filtered_before_it_is_ordered(spark):
    df = spark.range(100000).withColumnRenamed("id", "k")
    p = optimised(order.hash_sample(df, ["k"], 10))
    assert re.search(r"Filter \(md5.* < [0-9a-f]{8}\)", p) and p.index("Sort") < p.index("Filter")


def test_chart_spec_check_is_a_projection(lines):
    specs = lines.select(
        F.col("l_returnflag").alias("chart_type"), *[F.col("l_linestatus").alias(c) for c in ("x", "y", "z", "color")]
    )
    assert "Exchange" not in plan(charts.valid_charts(specs, lines))


def test_no_cross_joins(lines):
    for df in (
        findings.outliers(lines),
        charts.treemap(lines, "l_returnflag", "l_quantity"),
        profile.column_profile(lines.select("l_quantity", "l_returnflag")),
        charts.kpis(lines, ["l_quantity"], LINE_KEYS, "l_shipdate"),
    ):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_filters_reach_the_scan(lines):
    p = plan(charts.bar(lines.where("l_quantity > 40"), "l_returnflag", "l_tax"))
    assert "GreaterThan(l_quantity,40.0)" in p and "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in p
