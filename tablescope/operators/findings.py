"""Findings over metrics: outliers, trend, correlations, distribution, period growth, confidence caps."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.columns import candidate_metrics, date_column, numeric_columns, require_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import kurtosis, number, parse_date, parse_date_strict, percent_change, skewness
from tablescope.operators.order import sorted_ranges

# An aggregate with more than about 100 buffer fields leaves whole-stage code generation, so wide ones are split.
METRICS_PER_JOB = 5
SUMS_PER_JOB = 40
PAIR_SUMS_PER_JOB = 40


def _metrics(df: DataFrame, metrics: list[str] | None) -> list[str]:
    return require_columns(df, metrics or candidate_metrics(df), numeric=True)


def _values(df: DataFrame, metrics: list[str], *others: Column) -> DataFrame:
    """Only the needed columns, metrics as double and without NaN."""
    return df.select(*others, *[number(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)])


@dataclass
class MetricStats:
    """One metric over the whole table; sd is the population deviation."""

    rows: int
    n: int
    mean: float | None
    sd: float | None
    low: float | None
    high: float | None
    skew: float | None
    kurt: float | None
    plain_skew: float | None = None
    plain_kurt: float | None = None

    def normality(self) -> float:
        """p of the Jarque-Bera test; 1 for a constant."""
        if not self.varies or self.plain_skew is None or self.plain_kurt is None:
            return 1.0
        return math.exp(-self.n / 12 * (self.plain_skew**2 + self.plain_kurt**2 / 4))

    @property
    def varies(self) -> bool:
        return self.n > 0 and self.low < self.high

    @property
    def complete(self) -> bool:
        return self.n == self.rows


def metric_stats(df: DataFrame, metrics: list[str] | None = None) -> dict[str, MetricStats]:
    """One scan of each metric without a shuffle; pass the result to the findings below to save their own.

    A few metrics per aggregate keep it inside code generation; the aggregates run side by side and each reads only
    its own columns.
    """
    metrics = _metrics(df, metrics)
    if not metrics:
        return {}
    parts = []
    for at in range(0, len(metrics), METRICS_PER_JOB):
        names = metrics[at : at + METRICS_PER_JOB]
        rows = []
        for i, m in enumerate(names):
            v = F.col(f"_m{i}")
            facts = [F.count(F.lit(1)), F.count(v), F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), skewness(v), kurtosis(v)]
            facts += [F.skewness(v), F.kurtosis(v)]
            rows.append(F.struct(F.lit(m).alias("m"), *[c.alias(f"p{j}") for j, c in enumerate(facts)]).alias(f"s{i}"))
        totals = _values(df, names).agg(*rows)
        parts.append(totals.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))]))))
    return {r[0]: MetricStats(*r[1:]) for r in reduce(DataFrame.unionAll, parts).collect()}


def outliers(
    df: DataFrame,
    metrics: list[str] | None = None,
    threshold: float = fx.OUTLIER_Z,
    stats: dict[str, MetricStats] | None = None,
) -> DataFrame:
    """`column, counts, max_zscore` of metrics that have values with |z| > threshold (population deviation)."""
    metrics = _metrics(df, metrics)
    stats = stats or metric_stats(df, metrics)
    metrics = [m for m in metrics if stats[m].varies]
    if not metrics:
        return df.sparkSession.createDataFrame([], "column string, counts bigint, max_zscore double")

    parts = []
    for at in range(0, len(metrics), SUMS_PER_JOB):
        names = metrics[at : at + SUMS_PER_JOB]
        rows = []
        for i, m in enumerate(names):
            z = F.abs((F.col(f"_m{i}") - F.lit(stats[m].mean)) / F.lit(stats[m].sd))
            rows.append(
                F.struct(
                    F.lit(m).alias("column"),
                    F.count_if(z > threshold).alias("counts"),
                    F.round(F.max(z), 3).alias("max_zscore"),
                ).alias(f"f{i}")
            )
        totals = _values(df, names).agg(*rows)
        parts.append(totals.select(F.inline(F.array(*[f"f{i}" for i in range(len(names))]))))
    return reduce(DataFrame.unionByName, parts).where("counts > 0")


def z_scores(df: DataFrame, metric: str) -> DataFrame:
    """The table with `zscore` of one metric; null for a constant metric."""
    require_columns(df, [metric], numeric=True)
    stats = df.agg(F.avg(number(df, metric)).alias("a"), F.stddev_pop(number(df, metric)).alias("s")).first()
    spread = stats["s"] or None
    return df.withColumn(
        "zscore", (number(df, metric) - F.lit(stats["a"]).cast("double")) / F.lit(spread).cast("double")
    )


def trend(
    df: DataFrame,
    metrics: list[str] | None = None,
    date: str | None = None,
    keys: list[str] | None = None,
    epsilon: float = fx.FLAT_SLOPE,
    strict: bool = False,
    axis: str = "index",
) -> DataFrame:
    """`column, trend, value, r2`: straight line of each metric over its date-ordered row index.

    `keys` make the order unique. The rows are range partitioned on (date, keys) once; each range gives its own
    count, mean, variance and covariance with the position, and the few range rows are merged with the usual
    formulas for pooled moments, so no global window is needed. Metrics with gaps are indexed over their own
    non-null rows. `axis='time'` regresses on seconds instead of the row index.
    """
    metrics = _metrics(df, metrics)
    date = date or date_column(df)
    if date is None or not metrics:
        return df.sparkSession.createDataFrame([], "column string, trend string, value double, r2 double")
    keys = require_columns(df, keys or [])
    if not keys and axis != "time":
        raise ValueError("trend needs unique row keys: they order rows of equal dates")
    parse = parse_date_strict if strict else parse_date
    when = parse(df, date)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = _values(
        df, metrics, when.alias("_when"), *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    ).where("_when is not null")
    fits = _time_fit(rows, metrics) if axis == "time" else _index_fit(rows, metrics, names)
    label = (
        F.when(F.abs("slope") <= epsilon, "NIL").when(F.col("slope") < 0, "Negative").when(F.col("slope") > 0, "Positive")
    )
    return fits.select(
        "column", label.alias("trend"), F.round("slope", 3).alias("value"), F.round("r2", 3).alias("r2")
    )


def _time_fit(rows: DataFrame, metrics: list[str]) -> DataFrame:
    x = F.unix_timestamp("_when").cast("double")
    fitted = rows.agg(
        *[
            F.struct(
                F.lit(m).alias("column"),
                F.regr_slope(F.col(f"_m{i}"), x).alias("slope"),
                F.when(F.min(f"_m{i}") == F.max(f"_m{i}"), 0.0)
                .otherwise(F.regr_r2(F.col(f"_m{i}"), x))
                .alias("r2"),
                F.count(f"_m{i}").alias("n"),
            ).alias(f"f{i}")
            for i, m in enumerate(metrics)
        ]
    )
    return fitted.select(F.inline(F.array(*[f"f{i}" for i in range(len(metrics))]))).where("n > 0")


def _index_fit(rows: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(f"_m{i}").alias(f"n{i}") for i in range(len(metrics))]
    ).first()
    dense = [i for i in range(len(metrics)) if counts[f"n{i}"] == counts["rows"]]
    sparse = [i for i in range(len(metrics)) if 0 < counts[f"n{i}"] < counts["rows"]]
    order = [F.col("_when"), *[F.col(k) for k in keys]]
    parts = []
    if dense:  # one sort for all of them; they are unpivoted only after their place is known
        named = [F.col(f"_m{i}").alias(metrics[i]) for i in dense]
        placed = sorted_ranges(rows.select("_when", *keys, *named), order)
        long = placed.unpivot(["_range", "_pos"], [metrics[i] for i in dense], "column", "_y")
        parts.append(_moments(long))
    if sparse:  # each metric has its own index, so the metric leads the order
        named = [F.col(f"_m{i}").alias(metrics[i]) for i in sparse]
        long = rows.select("_when", *keys, *named).unpivot(["_when", *keys], [metrics[i] for i in sparse], "column", "_y")
        parts.append(_moments(sorted_ranges(long.where("_y is not null"), [F.col("column"), *order])))
    if not parts:
        return rows.sparkSession.createDataFrame([], "column string, slope double, r2 double")
    return _pooled_line(reduce(DataFrame.unionByName, parts))


def _moments(placed: DataFrame) -> DataFrame:
    """Per range and metric: count, mean and variance of y, covariance of y with the position in the range."""
    return placed.groupBy("_range", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_y").alias("mean"),
        F.var_pop("_y").alias("var"),
        F.covar_pop(F.col("_pos").cast("double"), F.col("_y")).alias("cov"),
    )


def _pooled_line(ranges: DataFrame) -> DataFrame:
    """Merge the per-range moments (one row per range and metric) into slope and r2 over the whole index."""
    whole = Window.partitionBy("column")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n").cast("double")
    placed = ranges.select(
        "*",
        F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias("start"),
        F.sum(n).over(whole).alias("all_n"),
        (F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)).alias("all_mean"),
    )
    dx = F.col("start") + (n - 1) / 2 - (F.col("all_n") - 1) / 2
    dy = F.col("mean") - F.col("all_mean")
    sums = placed.groupBy("column", "all_n").agg(
        F.sum(n * (F.col("cov") + dx * dy)).alias("sxy"), F.sum(n * (F.col("var") + dy * dy)).alias("syy")
    )
    sxx = F.col("all_n") * (F.col("all_n") * F.col("all_n") - 1) / 12
    return sums.select(
        "column",
        F.try_divide(F.col("sxy"), sxx).alias("slope"),
        F.when(F.col("syy") == 0, F.lit(0.0))
        .otherwise(F.try_divide(F.col("sxy") * F.col("sxy"), sxx * F.col("syy")))
        .alias("r2"),
    )


def _pair_values(df: DataFrame, columns: list[str], stats: dict[str, MetricStats]) -> DataFrame:
    """`col1, col2, corr` over rows where both are present; null when a side is constant.

    Columns without gaps are standardised first, so a pair is one plain mean of products.
    """
    standard = [
        (number(df, c) - F.lit(stats[c].mean)) / F.lit(stats[c].sd) if stats[c].varies else F.lit(None).cast("double")
        for c in columns
    ]
    values = df.select(*[z.alias(f"_m{i}") for i, z in enumerate(standard)])

    def pair(i: int, j: int) -> tuple[Column, int]:
        a, b = F.col(f"_m{i}"), F.col(f"_m{j}")
        first, second = stats[columns[i]], stats[columns[j]]
        if (first.complete and second.complete) or not (first.varies and second.varies):
            return F.avg(a * b), 1
        a_both, b_both = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a_both) * F.stddev_pop(b_both)), 6

    found = [(i, j, *pair(i, j)) for i, j in combinations(range(len(columns)), 2)]
    if sum(size for *_, size in found) > PAIR_SUMS_PER_JOB:
        return _gram_values(values, columns)
    rows = [F.struct(F.lit(columns[i]).alias("col1"), F.lit(columns[j]).alias("col2"), c.alias("corr")) for i, j, c, _ in found]
    totals = values.agg(*[r.alias(f"r{k}") for k, r in enumerate(rows)])
    return totals.select(F.inline(F.array(*[f"r{k}" for k in range(len(rows))])))


def _gram_values(values: DataFrame, columns: list[str]) -> DataFrame:
    """`col1, col2, corr` of many standardised columns in one scan.

    Each task multiplies its blocks of rows into sums for all pairs at once, over rows where both sides are there, and hands
    on one row per pair.
    """
    width = len(columns)
    first, second = np.triu_indices(width, 1)

    def run(batches):
        sums = np.zeros((6, width, width))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(width)])
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            squares = x * x
            for k, (a, b) in enumerate(((m, m), (x, m), (m, x), (squares, m), (m, squares), (x, x))):
                sums[k] += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *(pa.array(s[first, second]) for s in sums)], names=names)

    names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]
    blocks = values.mapInArrow(run, "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = blocks.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])
    spread = lambda square, plain: F.col("n") * F.col(square) - F.col(plain) * F.col(plain)
    least = 1e-12 * F.col("n") * F.col("n")
    corr = F.when(
        (spread("sxx", "sx") > least) & (spread("syy", "sy") > least),
        (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sxx", "sx") * spread("syy", "sy")),
    )
    name = lambda at: F.get(F.array(*[F.lit(c) for c in columns]), F.col(at).cast("int"))
    return total.select(name("i").alias("col1"), name("j").alias("col2"), corr.alias("corr"))


def correlations(
    df: DataFrame,
    columns: list[str] | None = None,
    minimum: float = fx.CORRELATION_MIN,
    stats: dict[str, MetricStats] | None = None,
) -> DataFrame:
    """`col1, col2, corr, degree, warning` of pairs with |corr| >= minimum; col1 stands before col2 in the table."""
    columns = require_columns(df, columns or numeric_columns(df), numeric=True)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "col1 string, col2 string, corr double, degree string, warning string"
        )
    size = F.abs("corr")
    return (
        _pair_values(df, columns, stats or metric_stats(df, columns))
        .where(size >= minimum)
        .select(
            "col1",
            "col2",
            F.round("corr", 4).alias("corr"),
            F.when(size >= fx.CORRELATION_STRONG, "strong").otherwise("moderate").alias("degree"),
            F.when(size > fx.CORRELATION_SAME, "both columns might mean the same").alias("warning"),
        )
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`col1, col2, corr` for every ordered pair; 1 on the diagonal, null for a constant column."""
    columns = require_columns(df, columns or numeric_columns(df), numeric=True)
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    stats = metric_stats(df, columns)
    pairs = _pair_values(df, columns, stats)
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, 1.0 if stats[c].varies else None) for c in columns], "col1 string, col2 string, corr double"
    )
    mirrored = pairs.withColumn(
        "both",
        F.array(
            F.struct("col1", "col2", "corr"),
            F.struct(F.col("col2").alias("col1"), F.col("col1").alias("col2"), F.col("corr")),
        ),
    ).select(F.inline("both"))
    return mirrored.unionByName(diagonal).withColumn("corr", F.round("corr", 4))


def distribution(
    df: DataFrame, metrics: list[str] | None = None, stats: dict[str, MetricStats] | None = None
) -> DataFrame:
    """`column, skew, distribution, p_value, n`.

    Normality is the Jarque-Bera test over all rows, from the moments that are there already. It differs from
    Shapiro-Wilk on a sample, so a label can differ near p = 0.05.
    """
    metrics = _metrics(df, metrics)
    stats = stats or metric_stats(df, metrics)
    facts = [(m, stats[m].skew, stats[m].kurt, stats[m].n, stats[m].normality()) for m in metrics]
    found = df.sparkSession.createDataFrame(facts, "column string, skew double, kurt double, n bigint, p double")
    label = (
        F.when(F.col("n") < 3, F.lit(None))
        .when(F.col("p") > fx.NORMALITY_P, "normal")
        .when(F.col("kurt") > 3, "heavy_tailed")
        .when(F.col("skew") > 1, "right_skewed")
        .when(F.abs("skew") < 0.5, "symmetric")
        .when(F.col("skew") < -1, "left_skewed")
        .when(F.col("skew") > 0, "slightly_right_skewed")
        .otherwise("slightly_left_skewed")
    )
    return found.select(
        "column",
        "skew",
        label.alias("distribution"),
        F.when(F.col("n") >= 3, F.round("p", 2)).alias("p_value"),
        "n",
    )


def period_growth(
    df: DataFrame,
    metrics: list[str] | None = None,
    date: str | None = None,
    period: str = "month",
    how: str = "sum",
) -> DataFrame:
    """`metric, period, value, percent_growth` against the previous period that has rows."""
    if period not in ("day", "week", "month", "quarter", "year"):
        raise ValueError("period must be day, week, month, quarter or year")
    metrics = _metrics(df, metrics)
    date = date or date_column(df)
    if date is None or not metrics:
        return df.sparkSession.createDataFrame(
            [], "metric string, period timestamp, value double, percent_growth double"
        )
    agg = {"sum": F.sum, "avg": F.avg}[how]
    rows = _values(df, metrics, F.date_trunc(period, parse_date(df, date)).alias("period"))
    wide = (
        rows.where("period is not null")
        .groupBy("period")
        .agg(*[agg(f"_m{i}").alias(m) for i, m in enumerate(metrics)])
    )
    long = wide.unpivot(["period"], metrics, "metric", "value")
    earlier = F.lag("value").over(Window.partitionBy("metric").orderBy("period"))  # calendar periods only
    return long.withColumn("_earlier", earlier).select(
        "metric",
        "period",
        "value",
        F.round(percent_change(F.col("value"), F.col("_earlier")), 2).alias("percent_growth"),
    )


#: Periods from one period to the same one a year before.
YEAR_BEFORE = {"day": "INTERVAL 12 MONTH", "week": "INTERVAL 52 WEEK", "month": "INTERVAL 12 MONTH", "quarter": "INTERVAL 12 MONTH", "year": "INTERVAL 12 MONTH"}
STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 1 WEEK", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 12 MONTH"}


def period_growth_spine(
    df: DataFrame,
    metrics: list[str] | None = None,
    date: str | None = None,
    period: str = "month",
    how: str = "sum",
) -> DataFrame:
    """`metric, period, rows, value, percent_growth, percent_growth_year` of every calendar period from the first to the last.

    A period without rows stands there with 0 rows and no value. Growth is against the calendar period before and against the same
    one a year before (for weeks 52 before); it is null where one of the two has no value. Only one row per period is joined.
    """
    if period not in STEPS:
        raise ValueError("period must be day, week, month, quarter or year")
    metrics = _metrics(df, metrics)
    date = date or date_column(df)
    if date is None or not metrics:
        kind = "metric string, period timestamp, rows bigint, value double, percent_growth double, percent_growth_year double"
        return df.sparkSession.createDataFrame([], kind)
    agg = {"sum": F.sum, "avg": F.avg}[how]
    rows = _values(df, metrics, F.date_trunc(period, parse_date(df, date)).alias("period")).where("period is not null")
    wide = rows.groupBy("period").agg(F.count(F.lit(1)).alias("rows"), *[agg(f"_m{i}").alias(f"_m{i}") for i in range(len(metrics))])
    # One row per period from here on.
    span = wide.agg(F.min("period").alias("first"), F.max("period").alias("last")).where("first is not null")
    spine = span.select(F.explode(F.expr(f"sequence(first, last, {STEPS[period]})")).alias("period"))
    filled = spine.join(wide, "period", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m{i}").alias("value")) for i, m in enumerate(metrics)])
    now = filled.select("period", "rows", F.inline(pairs))
    before = now.select("metric", F.expr(f"period + {STEPS[period]}").alias("period"), F.col("value").alias("_before"))
    step = now.join(before, ["metric", "period"], "left")
    # A leap day has the last day of February before it, and no day has it.
    year = now.select("metric", F.col("period").alias("_then"), F.col("value").alias("_year"))
    joined = step.withColumn("_then", F.expr(f"period - {YEAR_BEFORE[period]}")).join(year, ["metric", "_then"], "left")
    growth = lambda base: F.round(percent_change(F.col("value"), F.col(base)), 2)
    return joined.select("metric", "period", "rows", "value", growth("_before").alias("percent_growth"), growth("_year").alias("percent_growth_year"))


def confidence_caps(
    metrics: list[str],
    shares: DataFrame,
    nulls: DataFrame,
    outlier_rows: DataFrame,
    geography: list[str],
) -> DataFrame:
    """`metric, cap, reasons`: MEDIUM when geography is concentrated, values are missing or outliers exist.

    All inputs are findings tables with a row per metric, column or category, so the joins are small.
    """
    base = nulls.where(F.col("column").isin(metrics)).select(F.col("column").alias("metric"), "null_percent")
    local = (
        shares.where(F.col("category").isin(geography))
        .groupBy("metric")
        .agg(F.max("contribution_pct").alias("top_pct"))
    )
    odd = outlier_rows.select(F.col("column").alias("metric"), "counts")
    joined = base.join(local, "metric", "left").join(odd, "metric", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("top_pct") > fx.CAP_GEOGRAPHY_PCT, "geographic concentration"),
            F.when(F.col("null_percent") > fx.CAP_MISSING_PCT, "missing data"),
            F.when(F.col("counts") > 0, "outliers"),
        )
    )
    return joined.select("metric", F.when(F.size(reasons) > 0, "MEDIUM").alias("cap"), reasons.alias("reasons"))
