"""Column choices made from the schema alone: no job runs here."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx

PLAIN_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_column(df: DataFrame) -> str | None:
    """First column whose name contains 'date', in any case."""
    return next((c for c in df.columns if "date" in c.lower()), None)


def category_columns(df: DataFrame) -> list[str]:
    """String columns except the date column."""
    date = date_column(df)
    return [c for c in string_columns(df) if c != date]


def candidate_metrics(df: DataFrame, limit: int | None = None) -> list[str]:
    """Number columns whose names do not look like keys, codes or calendar parts; all of them unless a limit is given."""
    names = [f.name for f in df.schema if isinstance(f.dataType, PLAIN_NUMBERS)]
    return [n for n in names if not any(w in n.lower() for w in fx.METRIC_NAME_EXCLUSIONS)][:limit]


def require_columns(df: DataFrame, names: Iterable[str], numeric: bool = False) -> list[str]:
    """Check names (and number type) before any plan is built."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}; table has {df.columns}")
    if numeric:
        wrong = [n for n in names if not isinstance(df.schema[n].dataType, (T.NumericType, T.BooleanType))]
        if wrong:
            raise ValueError(f"columns are not numeric: {wrong}")
    return names


def low_cardinality_columns(df: DataFrame, limit: int = fx.CHART_CATEGORY_LIMIT) -> DataFrame:
    """`column, cardinality` of the non-numeric columns with fewer than `limit` distinct values."""
    from tablescope.operators.profile import distinct_counts

    names = [c for c in df.columns if c not in numeric_columns(df)]
    return distinct_counts(df, names).where(F.col("cardinality") < limit)


def slim_profile(profile: DataFrame) -> DataFrame:
    """The narrow form of a column profile: names, missing share and role."""
    return profile.select("column", "null_percent", "role")
