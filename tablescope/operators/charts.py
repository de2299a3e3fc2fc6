"""Chart-ready tables: bounded aggregates, no drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.columns import category_columns, date_column, numeric_columns, require_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import compact_number, number, parse_date, percent_change, title_label
from tablescope.operators.findings import correlation_matrix
from tablescope.operators.order import first_half, first_values, hash_sample, running_total
from tablescope.operators.quantiles import exact_quantiles
from tablescope.plans.scratch import write_scratch



def _keys(df: DataFrame, **names: str) -> list[Column]:
    return [F.col(f"`{c}`").alias(n) for n, c in names.items()]


def _grouped(df: DataFrame, keys: dict[str, str], y: str, how) -> DataFrame:
    """Group on the keys (null keys dropped) and aggregate the measure."""
    require_columns(df, list(keys.values()))
    require_columns(df, [y], numeric=True)
    rows = df.select(*_keys(df, **keys), number(df, y).alias("_y")).dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(how("_y").alias("y"))


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def bar(df: DataFrame, x: str, y: str) -> DataFrame:
    """`x, y`: sum of y per x."""
    return _grouped(df, {"x": x}, y, _sum)


def stacked_bar(df: DataFrame, x: str, y: str, color: str) -> DataFrame:
    """`x, color, y`: sum of y per pair."""
    return _grouped(df, {"x": x, "color": color}, y, _sum)


def treemap(df: DataFrame, x: str, y: str) -> DataFrame:
    """`x, y, share_pct` of the positive sums; the share is of their total."""
    positive = bar(df, x, y).where("y > 0")
    total = positive.agg(F.sum("y")).first()[0]
    return positive.withColumn("share_pct", F.col("y") / F.lit(total).cast("double") * 100)


def pareto(df: DataFrame, x: str, y: str) -> DataFrame:
    """`x, y, cumulative_pct`: means in falling order with their running share."""
    means = _grouped(df, {"x": x}, y, F.avg).where("y is not null")
    ranked = running_total(means, "y", [F.desc("y"), F.asc("x")])
    return ranked.select(
        "x", "y", (F.try_divide(F.col("running_total"), F.col("grand_total")) * 100).alias("cumulative_pct")
    )


def line(df: DataFrame, x: str, y: str, period: str | None = None, ordered: bool = False) -> DataFrame:
    """`x, y`: mean of y per point in time (or per period); rows whose date cannot be read are dropped."""
    require_columns(df, [x])
    require_columns(df, [y], numeric=True)
    when = parse_date(df, x)
    when = F.date_trunc(period, when) if period else when
    points = (
        df.select(when.alias("x"), number(df, y).alias("_y"))
        .where("x is not null")
        .groupBy("x")
        .agg(F.avg("_y").alias("y"))
    )
    return points.orderBy("x") if ordered else points


def histogram(df: DataFrame, column: str, bins: int = fx.HISTOGRAM_BINS) -> DataFrame:
    """`bin, lo, hi, n`: equal-width bins between min and max; one bin for a constant column."""
    require_columns(df, [column], numeric=True)
    v = number(df, column)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    lo, hi = ends["lo"], ends["hi"]
    if lo == hi:
        bins = 1
    width = (hi - lo) / bins
    place = F.least(F.floor((v - lo) / F.lit(width or 1.0)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        "n",
    )


def box(df: DataFrame, column: str) -> DataFrame:
    """`column, q25, q50, q75, whisker_low, whisker_high, beyond`: whiskers are values within 1.5 IQR."""
    require_columns(df, [column], numeric=True)
    q25, q50, q75 = exact_quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    v = number(df, column)
    reach = None if q25 is None else 1.5 * (q75 - q25)
    low = F.lit(None if q25 is None else q25 - reach).cast("double")
    high = F.lit(None if q25 is None else q75 + reach).cast("double")
    inside = F.when(v.between(low, high), v)
    return df.agg(
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if(~v.between(low, high)).alias("beyond"),
    ).select(
        F.lit(column).alias("column"),
        F.lit(q25).cast("double").alias("q25"),
        F.lit(q50).cast("double").alias("q50"),
        F.lit(q75).cast("double").alias("q75"),
        "whisker_low",
        "whisker_high",
        "beyond",
    )


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return correlation_matrix(df, columns)


def scatter_points(
    df: DataFrame, x: str, y: str, keys: list[str], color: str | None, size: int
) -> DataFrame:
    """`x, y[, color]`: a repeatable sample of points for the drawing."""
    require_columns(df, [x, y], numeric=True)
    chosen = hash_sample(df, keys, size)
    extra = [F.col(f"`{color}`").alias("color")] if color else []
    return chosen.select(number(df, x).alias("x"), number(df, y).alias("y"), *extra)


def ols_line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """`[color,] slope, intercept, r2, n` of the least-squares line over all rows."""
    require_columns(df, [x, y], numeric=True)
    groups = [F.col(f"`{color}`").alias("color")] if color else []
    rows = df.select(*groups, number(df, x).alias("x"), number(df, y).alias("y"))
    return rows.groupBy(*[c for c in rows.columns if c == "color"]).agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.regr_count("y", "x").alias("n"),
    )


def pivot_cells(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """`x, y, z`: mean of z per pair, long form; pairs without any z are left out."""
    return (
        _grouped(df, {"x": x, "color": y}, z, F.avg)
        .select("x", F.col("color").alias("y"), F.col("y").alias("z"))
        .where("z is not null")
    )


def pivot_heatmap(df: DataFrame, x: str, y: str, z: str, y_values: list | None = None) -> DataFrame:
    """One row per x, one column per y value. Without `y_values` they are looked up in the written cells; Spark's own
    `spark.sql.pivotMaxValues` limits them (`pivot_cells` has no limit)."""
    cells = pivot_cells(df, x, y, z)
    if y_values is None:
        cells = write_scratch(cells, "cells")
    return cells.groupBy("x").pivot("y", y_values).agg(F.first("z"))


def valid_charts(specs: DataFrame, table: DataFrame) -> DataFrame:
    """Chart specs with `reason` (why a spec cannot be drawn on `table`, else null) and `valid`.

    x, y, z and color are text; a list value is JSON text that starts with '['. The table's column names are a
    literal list from its schema, so nothing is joined or shuffled.
    """
    known = table.columns
    numeric = numeric_columns(table) + [f.name for f in table.schema if isinstance(f.dataType, T.BooleanType)]
    kind = F.col("chart_type")
    heatmap = F.coalesce(kind == "correlation_heatmap", F.lit(False))

    def is_list(c: str) -> Column:
        return F.coalesce(F.startswith(F.col(c), F.lit("[")), F.lit(False))

    def unknown(c: str) -> Column:
        listed = F.from_json(F.col(c), "array<string>")
        return F.coalesce(
            F.when(is_list(c), F.exists(listed, lambda v: ~v.isin(known))).otherwise(
                (F.col(c) != "") & ~F.col(c).isin(known)
            ),
            F.lit(False),
        )

    def not_numeric(c: str) -> Column:
        return F.coalesce((F.col(c) != "") & ~F.col(c).isin(numeric), F.lit(False))

    no_kind = kind.isNull() | (kind == "")
    reason = (
        F.when(no_kind, "missing chart_type")
        .when(is_list("x") & ~heatmap, "x is a list")
        .when(is_list("y"), "y is a list")
        .when(is_list("z"), "z is a list")
        .when(is_list("color"), "color is a list")
        .when(F.col("x").isNull() & ~heatmap, "x is missing")
        .when(F.col("y").isNull() & ~kind.isin("histogram", "correlation_heatmap"), "y is missing")
    )
    for c in ["x", "y", "z", "color"]:
        reason = reason.when(unknown(c), F.lit(f"{c} is not a column"))
    reason = reason.when(kind.isin("scatter", "histogram") & ~is_list("x") & not_numeric("x"), "x is not numeric")
    reason = reason.when(kind.isin("scatter", "bar") & not_numeric("y"), "y is not numeric")
    return specs.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def chosen_charts(specs: DataFrame, table: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first valid specs in the given order."""
    return valid_charts(specs, table).where("valid").orderBy(*order).limit(limit)


def kpis(
    df: DataFrame,
    metrics: list[str],
    keys: list[str],
    date: str | None = None,
    direction: dict[str, str] | None = None,
    default_direction: str = "higher_is_better",
    limit: int | None = None,
) -> DataFrame:
    """`label, value, value_str, direction, delta, is_good` of the given numeric metrics (the first `limit`, if one is given).

    delta compares the mean of the later half of the rows with the earlier half, in date order with unreadable
    dates last; `keys` make the order unique. No rows are sorted beyond those at the cut between the halves.
    """
    metrics = [m for m in metrics if m in numeric_columns(df)][:limit]
    if not metrics:
        raise ValueError("no numeric metric given")
    date = date or date_column(df)
    keys = require_columns(df, keys)
    narrow = df.select(
        *([parse_date(df, date).alias("_when")] if date else []),
        *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)],
        *[number(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)],
    )
    # Written once: the cut between the halves takes several looks at it.
    narrow = write_scratch(narrow, "kpis")
    early = first_half(narrow, [f"_k{i}" for i in range(len(keys))], "_when" if date else None)
    split = narrow.withColumn("_early", early)
    means = split.agg(
        *[F.avg(f"_m{i}").alias(f"v{i}") for i in range(len(metrics))],
        *[F.avg(F.when(F.col("_early"), F.col(f"_m{i}"))).alias(f"a{i}") for i in range(len(metrics))],
        *[F.avg(F.when(~F.col("_early"), F.col(f"_m{i}"))).alias(f"b{i}") for i in range(len(metrics))],
    )
    rows = []
    for i, m in enumerate(metrics):
        way = (direction or {}).get(m, default_direction)
        rows.append(
            F.struct(
                title_label(m).alias("label"),
                F.col(f"v{i}").alias("value"),
                compact_number(F.col(f"v{i}")).alias("value_str"),
                F.lit(way).alias("direction"),
                F.round(percent_change(F.col(f"b{i}"), F.col(f"a{i}")), 2).alias("delta"),
            )
        )
    good = ((F.col("delta") >= 0) & (F.col("direction") == "higher_is_better")) | (
        (F.col("delta") < 0) & (F.col("direction") == "lower_is_better")
    )
    return means.select(F.inline(F.array(*rows))).withColumn("is_good", good)


def dimensions(df: DataFrame, limit: int | None = None) -> list[str]:
    return category_columns(df)[:limit]


def dimension_values(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """`column, value`: first distinct values, by order of appearance, of the first dimension."""
    return first_values(df, dimensions(df)[0], order, limit)
