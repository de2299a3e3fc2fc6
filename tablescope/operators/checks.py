"""Quality checks over tables of run records: one row per run (or per record), all runs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx
from tablescope.functions.text import percent_sum, section_checks
from tablescope.plans.lookup import lookup_join



def domain_check(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Checks of `domain, confidence, metrics array, directions map`; `total` is the share that holds."""
    checks = {
        "valid_domain": F.col("domain").isin(fx.DOMAINS),
        "has_confidence": F.col("confidence").isin(fx.CONFIDENCES),
        "has_key_metrics": F.size("metrics") > 0,
        "has_directions": F.size("directions") > 0,
        "keys_match": F.forall("metrics", lambda m: F.map_contains_key("directions", m)),
    }
    checks = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    total = reduce(lambda a, b: a + b, [c.cast("int") for c in checks.values()]) / len(checks)
    return records.select(run, *[c.alias(n) for n, c in checks.items()], total.alias("total"))


def chart_check(specs: DataFrame, run: str = "run_id") -> DataFrame:
    """`run, violation_count, pass`. A repeated (x, y) counts for each spec after the first.

    Specs are first reduced per (run, x, y), with a map-side combine, so a run that holds a third of all specs does
    not reach one task as rows.
    """
    kind = F.col("chart_type")

    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    broken = (
        (F.coalesce(kind == "stacked_bar", F.lit(False)) & F.col("color").eqNullSafe(F.col("x"))).cast("int")
        + (F.coalesce(kind == "pivot_heatmap", F.lit(False)) & empty("z")).cast("int")
        + (F.coalesce(kind.isin("bar", "line", "scatter"), F.lit(False)) & empty("x")).cast("int")
    )
    pairs = specs.groupBy(run, "x", "y").agg(F.sum(broken).alias("broken"), (F.count(F.lit(1)) - 1).alias("repeats"))
    runs = pairs.groupBy(run).agg(F.sum(F.col("broken") + F.col("repeats")).alias("violation_count"))
    return runs.withColumn("pass", F.col("violation_count") == 0)


def repeated_pairs(
    specs: DataFrame, position: str, run: str = "run_id"
) -> DataFrame:
    """The specs with `repeated`: true when the same (run, x, y) stands at an earlier position."""
    first = specs.groupBy(run, "x", "y").agg(F.min(position).alias("_first"))
    first = first.select(F.struct(run, "x", "y").alias("_pair"), "_first")
    paired = specs.withColumn("_pair", F.struct(run, "x", "y"))
    joined = lookup_join(paired, first, "_pair", "inner")
    return joined.select(*specs.columns, (F.col(position) > F.col("_first")).alias("repeated"))


def report_check(reports: DataFrame, text: str = "report", run: str = "run_id") -> DataFrame:
    """Heading, action and length checks of every report; per row, no shuffle."""
    return reports.select(run, *[c.alias(n) for n, c in section_checks(F.col(text)).items()])


def causal_check(records: DataFrame, run: str = "run_id") -> DataFrame:
    """`run, connection_count, issue_count, pass` of records with a `connections` array.

    Each connection has `issue, internal_evidence, causal_mechanism, verdict, variance_decomposition` (text, struct or map).
    The array is checked in place, per row.
    """
    low, high = fx.PERCENT_SUM_RANGE
    as_text = isinstance(records.schema["connections"].dataType.elementType["variance_decomposition"].dataType, T.StringType)

    def blank(c: Column) -> Column:
        return F.coalesce(c == "", F.lit(True))

    def issues(c: Column) -> Column:
        parts = c["variance_decomposition"] if as_text else F.to_json(c["variance_decomposition"])
        total = F.coalesce(percent_sum(parts), F.lit(0))
        return (
            blank(c["internal_evidence"]).cast("int")
            + blank(c["causal_mechanism"]).cast("int")
            + F.coalesce(~c["verdict"].isin(fx.VERDICTS), F.lit(True)).cast("int")
            + (~total.between(low, high)).cast("int")
        )

    count = F.coalesce(F.size("connections"), F.lit(0))
    found = F.aggregate(
        F.coalesce(F.transform("connections", issues), F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x
    )
    return records.select(
        run,
        F.greatest(count, F.lit(0)).alias("connection_count"),
        F.when(count > 0, found).otherwise(1).alias("issue_count"),
        ((count > 0) & (found == 0)).alias("pass"),
    )


def node_scores(checks: DataFrame, node: str, run: str = "run_id") -> DataFrame:
    """`run, node, passed, total` per row of a check table: its boolean columns. No shuffle; `scorecard` adds them up."""
    flags = [f.name for f in checks.schema if f.dataType.typeName() == "boolean"]
    passed = reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags], F.lit(0))
    return checks.select(run, F.lit(node).alias("node"), passed.alias("passed"), F.lit(len(flags)).alias("total"))


def scorecard(nodes: list[DataFrame], run: str = "run_id") -> DataFrame:
    """`run, node, passed, total, node_score` with one extra `overall` row per run; scores are rounded percents.

    Nodes and overall come from one shuffle over both groupings.
    """
    rows = reduce(DataFrame.unionByName, nodes)
    both = rows.groupingSets([[F.col(run), F.col("node")], [F.col(run)]], F.col(run), F.col("node")).agg(
        F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.grouping("node").alias("_all")
    )
    score = F.coalesce(F.round(F.try_divide(F.col("passed"), F.col("total")) * 100), F.lit(0.0))
    named = F.when(F.col("_all") == 1, "overall").otherwise(F.col("node"))
    return both.select(run, named.alias("node"), "passed", "total", score.cast("int").alias("node_score"))
