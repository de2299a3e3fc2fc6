"""Category findings from one shared aggregate: every category x metric pair is grouped once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.columns import candidate_metrics, category_columns, date_column, require_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import number, parse_date, percent_change


METRICS_PER_JOB = 8  # keeps the buffer of one aggregate below the 100 fields that code generation takes
MEASURES = {
    "total": "coalesce(sum({m}), 0.0D)",
    "mean": "avg({m})",
    "sd": "stddev({m})",
    "n": "count({m})",
    "dated_mean": "avg(CASE WHEN _dated THEN {m} END)",
}


def group_stats(
    df: DataFrame,
    metrics: list[str] | None = None,
    categories: list[str] | None = None,
    date: str | None = None,
    measures: list[str] | None = None,
) -> DataFrame:
    """`category, key, metric, total, mean, sd, n, dated_mean, dated_rows` (or the chosen measures).

    The categories are unpivoted to (category, key), so one map-side combine and one shuffle of group rows serve
    all of them (per eight metrics), and a value that holds a third of the table is already reduced to one row per task. Null keys
    are dropped. `dated_*` use only the rows whose date can be read (all rows when there is no date column).
    """
    metrics = require_columns(df, metrics or candidate_metrics(df), numeric=True)
    categories = require_columns(df, categories or category_columns(df))
    measures = measures or list(MEASURES)
    date = date or date_column(df)
    parts = [
        _group_stats(df, metrics[at : at + METRICS_PER_JOB], categories, date, measures)
        for at in range(0, len(metrics), METRICS_PER_JOB)
    ]
    return reduce(DataFrame.unionByName, parts)


def _group_stats(
    df: DataFrame, metrics: list[str], categories: list[str], date: str | None, measures: list[str]
) -> DataFrame:
    dated = parse_date(df, date).isNotNull() if date and "dated_mean" in measures else F.lit(True)
    narrow = df.select(
        dated.alias("_dated"),
        *[number(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)],
        *[F.col(f"`{c}`").cast("string").alias(c) for c in categories],
    )
    ids = ["_dated", *[f"_m{i}" for i in range(len(metrics))]]
    long = narrow.unpivot(ids, categories, "category", "key").where(F.col("key").isNotNull())
    per_metric = [
        "struct({}) AS g{}".format(", ".join(f"{MEASURES[k].format(m=f'_m{i}')} AS {k}" for k in measures), i)
        for i in range(len(metrics))
    ]
    wide = long.groupBy("category", "key").agg(
        F.count_if("_dated").alias("dated_rows"), *[F.expr(e) for e in per_metric]
    )
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), *[F.col(f"g{i}.{k}").alias(k) for k in measures])
            for i, m in enumerate(metrics)
        ]
    )
    return wide.select("category", "key", "dated_rows", F.inline(rows)).select(
        "category", "key", "metric", *measures, "dated_rows"
    )


def _highest(value: str) -> Column:
    """Row of the highest value; the smallest key wins a tie."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col("key"))))


def _lowest(value: str) -> Column:
    return F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("key"))))


def _extremes(stats: DataFrame) -> DataFrame:
    return (
        stats.groupBy("category", "metric")
        .agg(_highest("mean").alias("high"), _lowest("mean").alias("low"))
        .where("high is not null")
        .select(
            "category",
            "metric",
            F.col("high.key").alias("high_key"),
            (-F.col("high.v")).alias("high_value"),
            F.col("low.key").alias("low_key"),
            F.col("low.v").alias("low_value"),
        )
    )


def directions(direction: dict[str, str] | None, default: str) -> Column:
    """Direction of each row's metric; the map is the caller's parameter, so it is small."""
    c = None
    for metric, way in (direction or {}).items():
        c = (F.when if c is None else c.when)(F.col("metric") == metric, F.lit(way))
    return F.lit(default) if c is None else c.otherwise(F.lit(default))


def performers(
    stats: DataFrame, direction: dict[str, str] | None = None, default_direction: str = "lower_is_better"
) -> DataFrame:
    """Best and worst category value by mean, read by the metric's direction."""
    lower = directions(direction, default_direction) == "lower_is_better"
    e = _extremes(stats)
    return e.select(
        "category",
        "metric",
        F.when(lower, F.col("high_key")).otherwise(F.col("low_key")).alias("worst"),
        F.round(F.when(lower, F.col("high_value")).otherwise(F.col("low_value")), 4).alias("worst_value"),
        F.when(lower, F.col("low_key")).otherwise(F.col("high_key")).alias("best"),
        F.round(F.when(lower, F.col("low_value")).otherwise(F.col("high_value")), 4).alias("best_value"),
        F.round(F.col("high_value") - F.col("low_value"), 4).alias("gap"),
    )


def segments(stats: DataFrame) -> DataFrame:
    """Category value with the highest (`best`) and lowest (`worst`) mean, whatever the direction."""
    return _extremes(stats).select(
        "category", "metric", F.col("high_key").alias("best"), F.col("low_key").alias("worst")
    )


def key_growth(stats: DataFrame) -> DataFrame:
    """Mean of the last category key against the first (alphabetical), in percent; 0 on a zero base."""
    ends = (
        stats.where("dated_rows > 0")
        .groupBy("category", "metric")
        .agg(F.max_by("dated_mean", "key").alias("last"), F.min_by("dated_mean", "key").alias("first"))
    )
    return ends.select(
        "category",
        "metric",
        F.round(percent_change(F.col("last"), F.col("first")), 2).alias("percent_growth"),
    )


def concentration(stats: DataFrame) -> DataFrame:
    """Share of the top category value in the total; no row where the total is 0."""
    tops = (
        stats.groupBy("category", "metric")
        .agg(_highest("total").alias("top"), F.sum("total").alias("all"))
        .where(F.col("all") != 0)
    )
    pct = F.round(F.try_divide(-F.col("top.v"), F.col("all")) * 100, 2)
    return tops.select(
        "category", "metric", F.col("top.key").alias("top_contributor"), pct.alias("contribution_pct")
    ).withColumn("is_concentrated", F.col("contribution_pct") > fx.CONCENTRATED_PCT)


def pareto_critical(shares: DataFrame) -> DataFrame:
    return shares.where(F.col("contribution_pct") > fx.CRITICAL_PCT)
