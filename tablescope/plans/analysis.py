"""The whole battery over one flat table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.columns import candidate_metrics, category_columns, date_column, numeric_columns
from tablescope.functions.dates import read_dates
from tablescope.operators import findings as fd
from tablescope.operators import groups as gr
from tablescope.plans.scratch import write_scratch


def analyse(
    df: DataFrame,
    keys: list[str],
    metrics: list[str] | None = None,
    categories: list[str] | None = None,
    date: str | None = None,
    direction: dict[str, str] | None = None,
    store: bool = False,
) -> dict[str, DataFrame]:
    """All findings as named tables. `keys` identify a row.

    The metric statistics are one pass that four findings share; the category statistics are computed and written
    once for five more. With `store` the needed columns are written first: for an input that is itself a join or
    another costly plan, which every pass would otherwise repeat. A date column of texts is read once, each form in its own way;
    `date_evidence` then says how many values of each form were read, and how many not at all.
    """
    metrics = metrics or candidate_metrics(df)
    categories = category_columns(df) if categories is None else categories
    date = date or date_column(df)
    numeric = numeric_columns(df)
    if store:
        needed = {*keys, *metrics, *categories, *numeric, *([date] if date else [])}
        df = write_scratch(df.select(*[F.col(f"`{c}`") for c in df.columns if c in needed]), "input")
    dates = {}
    if date and isinstance(df.schema[date].dataType, T.StringType):
        reading = read_dates(df, date)
        df = df.withColumn(date, reading.parsed(F.col(f"`{date}`")))
        dates["date_evidence"] = reading.evidence
    stats = fd.metric_stats(df, list(dict.fromkeys(metrics + numeric)))
    found = dates | {
        "outliers": fd.outliers(df, metrics, stats=stats),
        "correlations": fd.correlations(df, numeric, stats=stats),
        "distribution": fd.distribution(df, metrics, stats=stats),
    }
    if date:
        found["trend"] = fd.trend(df, metrics, date, keys)
        found["period_growth"] = fd.period_growth(df, metrics, date)
    if categories:
        groups = write_scratch(gr.group_stats(df, metrics, categories, date), "groups")
        found["segments"] = gr.segments(groups)
        found["performers"] = gr.performers(groups, direction)
        found["concentration"] = gr.concentration(groups)
        found["pareto_critical"] = gr.pareto_critical(found["concentration"])
        if date:
            found["key_growth"] = gr.key_growth(groups)
    return found


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """All findings in one table with an `analysis` column; columns a finding lacks are null."""
    parts = [t.select(F.lit(name).alias("analysis"), "*") for name, t in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_json_rows(found: dict[str, DataFrame]) -> DataFrame:
    """`analysis, record`: each findings row as JSON text."""
    parts = [t.select(F.lit(name).alias("analysis"), F.to_json(F.struct("*")).alias("record")) for name, t in found.items()]
    return reduce(DataFrame.unionByName, parts)
