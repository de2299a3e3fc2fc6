"""Number, date and label expressions shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx


def number(df: DataFrame, name: str) -> Column:
    """The column as double, with NaN read as missing."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c.cast("double")


@dataclass
class DateFormat:
    """The format that reads most values of a text column (None: ISO forms), how many values there are and how many it reads."""

    fmt: str | None
    values: int
    read: int

    def parsed(self, c: Column) -> Column:
        return F.try_to_timestamp(c, F.lit(self.fmt)) if self.fmt else F.try_to_timestamp(c)


def date_format(df: DataFrame, name: str) -> DateFormat:
    """The best single format of a text column, by one aggregate; the first of the list at equal counts."""
    c = F.col(f"`{name}`")
    tries = [(None, F.when(c.rlike(fx.ISO_DATE_SHAPE), F.try_to_timestamp(c)))] + [(f, F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(f)))) for f, shape in fx.DATE_FORMATS]
    counts = df.agg(F.count(c), *[F.count(t) for _, t in tries]).first()
    best = max(range(len(tries)), key=lambda i: counts[i + 1])
    return DateFormat(tries[best][0], counts[0], counts[best + 1])


def parse_date(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """Lenient date parse: what cannot be read becomes null. Timestamps keep their type.

    A text column without a given format is read in the one that fits most of its values; none that fits is an error.
    """
    if fmt is None and isinstance(df.schema[name].dataType, T.StringType):
        found = date_format(df, name)
        if found.values and not found.read:
            raise ValueError(f"no value of {name} can be read as a date; give its format")
        fmt = found.fmt
    return _as_time(df, name, F.try_to_timestamp, fmt)


def parse_date_strict(df: DataFrame, name: str, fmt: str | None = None) -> Column:
    """Strict date parse: a bad value fails the query."""
    return _as_time(df, name, lambda c, *f: F.to_timestamp(c, fmt) if f else F.to_timestamp(c), fmt)


def _as_time(df: DataFrame, name: str, parse, fmt: str | None) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return parse(c, F.lit(fmt)) if fmt else parse(c)
    return c if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("timestamp")


def short_key(c: Column) -> Column:
    """A text that stands for the value in distinct counts: long texts are replaced by their SHA-256.

    Keeps whole texts out of the shuffle. Numbers keep their form at any length, so they can still be recognised.
    """
    return F.when(
        (F.length(c) > 64) & ~c.rlike(fx.NUMBER_SHAPE), F.concat(F.lit("sha256 "), F.sha2(c, 256))
    ).otherwise(c)


def skewness(c: Column) -> Column:
    """Bias-corrected sample skewness; null below three values, 0 for a constant."""
    n = F.count(c).cast("double")
    return F.when(
        n >= 3,
        F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(
            F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)
        ),
    )


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant."""
    n = F.count(c).cast("double")
    return F.when(
        n >= 4,
        F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(
            F.try_divide((n - 1) * ((n + 1) * F.kurtosis(c) + 6), (n - 2) * (n - 3))
        ),
    )


def percent_change(new: Column, base: Column) -> Column:
    """Change in percent; 0 when the base is 0, null when a side is missing."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(new - base, base) * 100)


def title_label(name: str) -> Column:
    return F.initcap(F.lit(name.replace("_", " ")))


def compact_number(c: Column) -> Column:
    """1234.5 -> '1.23K'; below a thousand the value to two places."""
    v = c.cast("double")
    return F.when(v >= 1000, F.format_string("%.2fK", v / 1000)).otherwise(F.round(v, 2).cast("string"))
