"""Table and column profile, imputation, type clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.columns import date_column, numeric_columns, string_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import date_format, kurtosis, number, short_key, skewness
from tablescope.operators.quantiles import exact_quantiles
from tablescope.plans.scratch import write_scratch

COLUMNS_PER_JOB = 25
TEXT_COLUMNS_PER_JOB = 8
MOMENT_COLUMNS_PER_JOB = 4  # keeps an aggregate below the 100 buffer fields that code generation takes
QUARTILES = [0.25, 0.5, 0.75]


def _chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _one_row_per_column(totals: DataFrame, rows: list[Column]) -> DataFrame:
    return totals.select(F.inline(F.array(*rows)))


def _filled(df: DataFrame, c: str) -> Column:
    """The column with NaN read as missing; type unchanged."""
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(df.schema[c].dataType))
    return col


def _distinct_key(df: DataFrame, c: str) -> Column:
    return short_key(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, T.StringType) else _filled(df, c)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column, null_count, null_percent`."""
    parts = []
    for names in _chunks(columns or df.columns, COLUMNS_PER_JOB):
        totals = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(_filled(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
        )
        parts.append(
            _one_row_per_column(
                totals,
                [
                    F.struct(
                        F.lit(c).alias("column"),
                        (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                        F.round(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")) * 100, 2).alias(
                            "null_percent"
                        ),
                    )
                    for i, c in enumerate(names)
                ],
            )
        )
    return _union(parts)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """`column, cardinality`, nulls not counted.

    Each column is counted in its own small aggregate, so a scan reads one column and only distinct values are
    shuffled; one aggregate with many distinct counts would repeat every row once per column.
    """
    columns = columns or df.columns
    if approx:
        totals = df.agg(*[F.approx_count_distinct(_filled(df, c), 0.01).alias(f"d{i}") for i, c in enumerate(columns)])
        return _one_row_per_column(
            totals,
            [
                F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("cardinality"))
                for i, c in enumerate(columns)
            ],
        )
    return _union(
        [
            df.agg(F.lit(c).alias("column"), F.countDistinct(_distinct_key(df, c)).alias("cardinality"))
            for c in columns
        ]
    )


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal rows (nulls equal).

    Pass one shuffles an 8-byte hash per row. Only rows whose hash occurs more than once can be duplicates; those hashes are
    written, and such rows are compared in full. Adaptive execution broadcasts the hashes if they are few, by their measured
    size; otherwise the rows are shuffled by hash once, for the join and the comparison.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_hash", F.xxhash64(*names))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    repeated = write_scratch(repeated, "repeated")
    if repeated.isEmpty():
        return 0
    rows = hashed.join(repeated, "_hash", "left_semi")
    groups = rows.groupBy("_hash", *names).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates."""
    duplicates = duplicate_rows(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(duplicates).cast("bigint").alias("duplicates")
    )


def _share(hit: str) -> str:
    return f"coalesce(try_divide(sum(CASE WHEN {hit} THEN n END), sum(n)), 0.0D)"


# Over values `v` that stand for `n` rows each. The shape test keeps other texts away from the parsers. Written as
# SQL text because one column would otherwise take hundreds of small expression calls to build.
DATE_SHARE = "greatest({})".format(
    ", ".join(_share(f'v RLIKE r"{shape}" AND try_to_timestamp(v, "{fmt}") IS NOT NULL') for fmt, shape in fx.DATE_SHAPES)
)
NUMBER_SHARE = _share(f'v RLIKE r"{fx.NUMBER_SHAPE}"')


def _role(kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("date")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit("numeric")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("string")
    return (
        F.when(F.col("date_share") > fx.DATE_SHARE, "date")
        .when(F.col("number_share") > fx.NUMBER_SHARE, "numeric")
        .when(F.col("cardinality") >= fx.ID_SHARE * F.col("rows"), "id")
        .when(F.col("cardinality") < fx.CATEGORY_LIMIT, "categorical")
    )


def _text_facts(df: DataFrame, columns: list[str], approx_distinct: bool = False) -> list[DataFrame]:
    """`column, rows, filled, cardinality, date_share, number_share` per string column.

    Each column is first grouped to its distinct values, which the exact distinct count needs anyway, so the shape
    and parse tests run once per distinct value. With `approx_distinct` nothing is shuffled and they run per row.
    """
    parts = []
    for c in columns:
        v = F.col("v")
        if approx_distinct:
            values = df.select(short_key(F.col(f"`{c}`")).alias("v"), F.lit(1).alias("n"))
            distinct = F.approx_count_distinct(v, 0.01)
        else:
            values = df.groupBy(short_key(F.col(f"`{c}`")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            distinct = F.count(v)
        parts.append(
            values.agg(
                F.lit(c).alias("column"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
                distinct.alias("cardinality"),
                F.expr(DATE_SHARE).alias("date_share"),
                F.expr(NUMBER_SHARE).alias("number_share"),
            )
        )
    return parts


def _typed_facts(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """`column, rows, filled` and the moments, for the columns that are not strings, in side-by-side aggregates of a few columns."""
    parts = []
    for names in _chunks(columns, MOMENT_COLUMNS_PER_JOB):
        numeric = {c: isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in names}
        none = F.lit(None).cast("double")
        values = df.select(
            *[(number(df, c) if numeric[c] else _filled(df, c)).alias(f"v{i}") for i, c in enumerate(names)]
        )
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(names):
            v = F.col(f"v{i}")
            aggs.append(F.count(v).alias(f"n{i}"))
            if numeric[c]:
                aggs.append(F.struct(*_moments(v)).alias(f"m{i}"))
        parts.append(
            _one_row_per_column(
                values.agg(*aggs),
                [
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("rows"),
                        F.col(f"n{i}").alias("filled"),
                        *[(F.col(f"m{i}.{m}") if numeric[c] else none).alias(m) for m in MOMENTS],
                    )
                    for i, c in enumerate(names)
                ],
            )
        )
    return parts


MOMENTS = ["mean", "std", "min", "max", "skewness", "kurtosis"]


def _moments(v: Column) -> list[Column]:
    return [
        F.avg(v).alias("mean"),
        F.stddev(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.round(skewness(v), 3).alias("skewness"),
        F.round(kurtosis(v), 3).alias("kurtosis"),
    ]


def _split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    texts = string_columns(df)
    return texts, [c for c in df.columns if c not in texts]


def column_roles(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """`column, cardinality, date_share, number_share, role`; the shares are null for typed columns."""
    texts, typed = _split_columns(df)
    parts = [
        facts.select(
            "column",
            "cardinality",
            F.round("date_share", 6).alias("date_share"),
            F.round("number_share", 6).alias("number_share"),
            _role(T.StringType()).alias("role"),
        )
        for facts in _text_facts(df, texts, approx_distinct)
    ]
    if typed:
        none = F.lit(None).cast("double")
        counts = distinct_counts(df, typed, approx_distinct)
        parts.append(
            counts.select(
                "column",
                "cardinality",
                none.alias("date_share"),
                none.alias("number_share"),
                _by_column({c: _role(df.schema[c].dataType) for c in typed}).alias("role"),
            )
        )
    return _union(parts)


def _by_column(choices: dict[str, Column]) -> Column:
    """The expression that belongs to the row's `column`; the choices come from the schema."""
    out = None  # one flat CASE: a nested one has a level per column
    for name, value in choices.items():
        out = (F.when if out is None else out.when)(F.col("column") == name, value)
    return F.lit(None) if out is None else out


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """`column, count, mean, std, min, q25, q50, q75, max, skewness, kurtosis` of the numeric columns."""
    columns = columns or [
        f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    facts = _union(_typed_facts(df, columns))
    return facts.select(
        "column",
        F.col("filled").alias("count"),
        "mean",
        "std",
        "min",
        *_quartiles(df, columns, exact),
        "max",
        "skewness",
        "kurtosis",
    )


def _quartiles(df: DataFrame, columns: list[str], exact: bool) -> list[Column]:
    """The three quartiles as literals by column; exact ones by rank search, otherwise from the sketch."""
    if exact:
        found = exact_quantiles(df, columns, QUARTILES)
    else:
        row = df.agg(*[F.percentile_approx(number(df, c), QUARTILES) for c in columns]).first()
        found = {c: row[i] or [None] * len(QUARTILES) for i, c in enumerate(columns)}
    return [
        _by_column({c: F.lit(found[c][j]).cast("double") for c in columns}).cast("double").alias(q)
        for j, q in enumerate(["q25", "q50", "q75"])
    ]


def text_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`column, count, unique, top, freq` of string columns; the smallest value wins a tie for `top`."""
    columns = columns or string_columns(df)
    long = df.select(*columns).unpivot([], columns, "column", "value").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupBy("column")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("best"),
        )
        .select("column", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.m")).alias("freq"))
    )


def describe(df: DataFrame) -> DataFrame:
    """Numeric summary, or the text form when the table has no numeric column."""
    return numeric_summary(df) if numeric_columns(df) else text_summary(df)


def column_profile(df: DataFrame, exact: bool = True, approx_distinct: bool = False) -> DataFrame:
    """One row per column: type, missing values, cardinality, moments, quartiles and role.

    The columns are read side by side, several times in all: give a stored columnar table, not a costly plan.
    """
    texts, typed = _split_columns(df)
    numeric = [c for c in typed if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    none = F.lit(None).cast("double")
    measures = ["mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"]
    common = ["column", "rows", "filled", "cardinality"]
    parts = [
        facts.select(*common, *[none.alias(m) for m in measures], _role(T.StringType()).alias("role"))
        for facts in _text_facts(df, texts, approx_distinct)
    ]
    if typed:
        facts = _union(_typed_facts(df, typed)).unionByName(
            distinct_counts(df, typed, approx_distinct), allowMissingColumns=True
        )
        facts = facts.groupBy("column").agg(*[F.max(c).alias(c) for c in facts.columns if c != "column"])
        quartiles = _quartiles(df, numeric, exact) if numeric else [none.alias(q) for q in ("q25", "q50", "q75")]
        role = _by_column({c: _role(df.schema[c].dataType) for c in typed}).alias("role")
        parts.append(facts.select(*common, *MOMENTS, *quartiles, role).select(*common, *measures, "role"))
    missing = F.col("rows") - F.col("filled")
    return _union(parts).select(
        "column",
        _by_column({n: F.lit(k) for n, k in df.dtypes}).alias("dtype"),
        missing.alias("null_count"),
        F.coalesce(F.round(F.try_divide(missing, F.col("rows")) * 100, 2), F.lit(0.0)).alias("null_percent"),
        "cardinality",
        *measures,
        "role",
    )


def column_types(df: DataFrame) -> DataFrame:
    """`position, column, dtype` of the table."""
    return df.sparkSession.createDataFrame(
        [(i, n, k) for i, (n, k) in enumerate(df.dtypes)], "position int, column string, dtype string"
    )


def _gap_facts(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """`column, rows, filled, mean, skew` of numeric columns."""
    parts = []
    for names in _chunks(columns, MOMENT_COLUMNS_PER_JOB):
        values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(names)])
        rows = [
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count(f"v{i}").alias("filled"),
                F.avg(f"v{i}").alias("mean"),
                skewness(F.col(f"v{i}")).alias("skew"),
            ).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
        totals = values.agg(*rows)
        parts.append(_one_row_per_column(totals, [F.col(f"s{i}") for i in range(len(names))]))
    return parts


def impute(df: DataFrame, date: str | None = None) -> DataFrame:
    """Fill strings with 'Unknown' and numbers with the mean, or the median when |skewness| > 1 or undefined.

    The date column is left alone. Columns without gaps keep their type; filled integer columns become double.
    """
    date = date or date_column(df)
    numbers = [c for c in numeric_columns(df) if c != date]
    fills: dict[str, float | None] = {}
    facts = [t.select("column", "rows", "filled", "mean", "skew") for t in _gap_facts(df, numbers)]
    for r in _union(facts).collect() if numbers else []:
        if r["filled"] < r["rows"]:
            fills[r["column"]] = r["mean"] if r["skew"] is not None and abs(r["skew"]) <= 1 else None
    medians = exact_quantiles(df, [c for c, v in fills.items() if v is None], [0.5])
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if f.name in fills:
            value = fills[f.name] if fills[f.name] is not None else medians[f.name][0]
            col = F.coalesce(number(df, f.name), F.lit(value).cast("double"))
        elif isinstance(f.dataType, T.StringType) and f.name != date:
            col = F.coalesce(col, F.lit(fx.MISSING_TEXT))
        out.append(col.alias(f.name))
    return df.select(*out)


def _named_like_date(name: str) -> bool:
    n = name.lower()
    return n in ("date", "modified") or n.endswith(("_at", "_time")) or n.startswith("timestamp")


def normalise_types(df: DataFrame, keep_leading_zeros: bool = False) -> DataFrame:
    """All-numeric string columns become numbers; columns named like dates become timestamps where every value is one.

    What cannot be converted whole stays text, so no value is lost.
    """
    texts = string_columns(df)
    if not texts:
        return df
    numeric: dict[str, str] = {}
    dated = {c: date_format(df, c) for c in texts if _named_like_date(c)}
    dated = {c: found for c, found in dated.items() if found.values and found.read == found.values}
    for names in _chunks(texts, TEXT_COLUMNS_PER_JOB):
        cols = [F.col(f"`{c}`") for c in names]
        checks = df.agg(
            *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
            *[F.count_if(~c.rlike(fx.NUMBER_SHAPE)).alias(f"bad{i}") for i, c in enumerate(cols)],
            *[F.count_if(~c.rlike(fx.INTEGER_SHAPE)).alias(f"frac{i}") for i, c in enumerate(cols)],
            *[F.count_if(c.rlike(fx.LEADING_ZERO_SHAPE)).alias(f"zero{i}") for i, c in enumerate(cols)],
        ).first()
        for i, c in enumerate(names):
            zeros = keep_leading_zeros and checks[f"zero{i}"]
            if checks[f"n{i}"] and not checks[f"bad{i}"] and not zeros:
                numeric[c] = "double" if checks[f"frac{i}"] else "bigint"
    out = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if f.name in dated:
            col = dated[f.name].parsed(col)
        elif f.name in numeric:
            col = F.trim(col).cast(numeric[f.name])
        out.append(col.alias(f.name))
    return df.select(*out)
