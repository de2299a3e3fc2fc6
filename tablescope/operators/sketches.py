"""Mergeable profile state: what is kept of a batch of rows so that the profile of all batches needs no row again.

One state row per column holds counts, central moments, extremes, the shapes of its texts, a HyperLogLog sketch of its values
and a KLL sketch of its numbers. States of any batches merge exactly where that can be (counts, moments, extremes, shape
shares) and within the sketches' error elsewhere (distinct values about 1 %, quartiles about 1 % in rank). Merging is
associative, so merged states can be stored and merged again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import number, short_key
from tablescope.operators.profile import _chunks, _filled, _role

#: log2 of the HyperLogLog registers; size of the KLL sketch.
DISTINCT_LOG, QUANTILE_SIZE = 14, 800
#: Columns whose state one aggregate gathers.
COLUMNS_PER_JOB = 12
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
SHAPES = [f"date{i}" for i in range(len(fx.DATE_SHAPES))] + ["numbers"]
COUNTS = ["rows", "filled", "n", *SHAPES]
STATE = ["column", "dtype", "rows", "filled", "n", "mean", "m2", "m3", "m4", "min", "max", *SHAPES, "distinct", "quantiles"]


def _state_of(df: DataFrame, c: str) -> Column:
    """The state of one column as a struct."""
    kind = df.schema[c].dataType
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    text = isinstance(kind, T.StringType)
    value = short_key(F.col(f"`{c}`")) if text else _filled(df, c)
    key = F.when(value.isNotNull(), F.xxhash64(value))
    fields = {"column": F.lit(c), "dtype": F.lit(kind.simpleString()), "rows": F.count(F.lit(1)), "filled": F.count(value)}
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    v = number(df, c) if numeric else none.cast("double")
    n, m2 = F.count(v), F.var_pop(v) * F.count(v)
    # Shape moments of a constant are undefined; its central moments are 0.
    spread = F.coalesce(m2, F.lit(0.0)) > 0
    fields |= {
        "n": n,
        "mean": F.avg(v),
        "m2": F.coalesce(m2, F.lit(0.0)),
        "m3": F.when(spread, F.skewness(v) * m2 * F.sqrt(m2 / n)).otherwise(0.0),
        "m4": F.when(spread, (F.kurtosis(v) + 3) * m2 * m2 / n).otherwise(0.0),
        "min": F.min(v),
        "max": F.max(v),
    } if numeric else {"n": zero, **{m: none.cast("double") for m in ("mean", "m2", "m3", "m4", "min", "max")}}
    if text:
        tests = [F.expr(f'`{c}` RLIKE r"{shape}" AND try_to_timestamp(`{c}`, "{fmt}") IS NOT NULL') for fmt, shape in fx.DATE_SHAPES]
        fields |= dict(zip(SHAPES, [F.count_if(t) for t in (*tests, F.col(f"`{c}`").rlike(fx.NUMBER_SHAPE))]))
    else:
        fields |= {s: zero for s in SHAPES}
    fields["distinct"] = F.hll_sketch_agg(key, DISTINCT_LOG)
    fields["quantiles"] = F.when(n > 0, F.kll_sketch_agg_double(v, QUANTILE_SIZE)) if numeric else none.cast("binary")
    return F.struct(*[x.alias(name) for name, x in fields.items()])


def profile_state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One state row per column of `df`: one read of each column, only sketches and sums are shuffled."""
    parts = []
    for names in _chunks(columns or df.columns, COLUMNS_PER_JOB):
        totals = df.agg(*[_state_of(df, c).alias(f"s{i}") for i, c in enumerate(names)])
        parts.append(totals.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))]))))
    return reduce(DataFrame.unionAll, parts)


def merge_states(states: DataFrame) -> DataFrame:
    """One state row per column and type, of all batches together; a column that changed its type keeps a row for each."""
    keys = ["column", "dtype"]
    totals = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    centre = totals.select(*keys, F.col("mean").alias("centre"))
    apart = states.where("n > 0").join(centre, keys).withColumn("d", F.col("mean") - F.col("centre"))
    moved = apart.groupBy(*keys).agg(
        F.expr("sum(m2 + n * d * d)").alias("m2"),
        F.expr("sum(m3 + 3 * d * m2 + n * d * d * d)").alias("m3"),
        F.expr("sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d)").alias("m4"),
    )
    merged = totals.join(moved, keys, "left").na.fill(0.0, ["m2", "m3", "m4"])
    return merged.withColumn("quantiles", F.when(F.col("n") > 0, F.col("quantiles"))).select(STATE)


def _kind_role() -> Column:
    """Role by type for typed columns, by shapes and counts for texts."""
    dtype = F.col("dtype")
    typed = F.when(dtype.isin("date", "timestamp", "timestamp_ntz"), "date").when(
        dtype.rlike(r"^(tinyint|smallint|int|bigint|float|double|boolean|decimal.*)$"), "numeric"
    )
    return F.when(dtype == "string", _role(T.StringType())).otherwise(typed)


def profile_of_states(states: DataFrame) -> DataFrame:
    """The column profile of all rows behind `states`, as `column_profile` has it; cardinality and quartiles are estimates."""
    merged = merge_states(states)
    n, m2 = F.col("n").cast("double"), F.col("m2")
    varied = F.col("min") < F.col("max")
    flat = F.when(F.col("min") == F.col("max"), F.lit(0.0))
    skew = F.try_divide(F.col("m3") / n, F.pow(m2 / n, F.lit(1.5)))
    kurt = F.try_divide(F.col("m4") * n, m2 * m2) - 3
    missing = F.col("rows") - F.col("filled")
    dates = F.greatest(*[F.col(s) for s in SHAPES[:-1]])
    facts = merged.withColumns({
        "cardinality": F.hll_sketch_estimate("distinct"),
        "date_share": F.coalesce(F.try_divide(dates, F.col("rows")), F.lit(0.0)),
        "number_share": F.coalesce(F.try_divide(F.col("numbers"), F.col("rows")), F.lit(0.0)),
    })
    return facts.select(
        "column",
        "dtype",
        "rows",
        missing.alias("null_count"),
        F.coalesce(F.round(F.try_divide(missing, F.col("rows")) * 100, 2), F.lit(0.0)).alias("null_percent"),
        "cardinality",
        "mean",
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
        "min",
        *[F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(q) for q, p in QUARTILES.items()],
        "max",
        F.when(n >= 3, F.coalesce(flat, F.when(varied, F.round(skew * F.sqrt(n * (n - 1)) / (n - 2), 3)))).alias("skewness"),
        F.when(n >= 4, F.coalesce(flat, F.when(varied, F.round((n - 1) * ((n + 1) * kurt + 6) / ((n - 2) * (n - 3)), 3)))).alias("kurtosis"),
        _kind_role().alias("role"),
    )
