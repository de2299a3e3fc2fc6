"""Dates in text columns of mixed forms: which reading each form has, and how many values it reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.functions.scalars import number

# Forms of dates, the parts in their groups, and the months.
TIME = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?\s*$"
FORMS = {
    "y-m-d": (r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})" + TIME, "ymd"),
    "y/m/d": (r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})" + TIME, "ymd"),
    "yyyymmdd": (r"^\s*(\d{4})(\d{2})(\d{2})" + TIME, "ymd"),
    "name d, y": (r"^\s*([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})" + TIME, "ndy"),
    "d name y": (r"^\s*(\d{1,2})\.?[ -]([A-Za-z]{3,9})\.?[ -](\d{4}|\d{2})" + TIME, "dny"),
    "a/b/y": (r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})" + TIME, None),
    "a-b-y": (r"^\s*(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})" + TIME, None),
    "a.b.y": (r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})" + TIME, None),
}
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Two digits of a year stand for the hundred years from this one on.
FIRST_SHORT_YEAR = 1969
#: How much better one order of day and month must go along with the key.
KEY_MARGIN = 0.05


def _month(name: Column) -> Column:
    """Number of a month's name or of its beginning of three letters or more."""
    out = None
    for i, full in enumerate(MONTH_NAMES, 1):
        hit = F.startswith(F.lit(full), F.lower(name)) | ((F.lower(name) == "sept") & F.lit(full == "september"))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def _parts(c: Column) -> Column:
    """The value's form and its parts as texts; null where no form fits. Month and day are `first` and `second`, as written."""
    out = None
    for form, (pattern, order) in FORMS.items():
        year = order.index("y") + 1 if order else 3
        first, second = [k for k in (1, 2, 3) if k != year]
        groups = {"first": first, "second": second, "year": year, "hour": 4, "minute": 5, "second_of": 6}
        parts = F.struct(F.lit(form).alias("form"), *[F.regexp_extract(c, pattern, k).alias(n) for n, k in groups.items()])
        hit = c.rlike(pattern)
        out = F.when(hit, parts) if out is None else out.when(hit, parts)
    return out


def _as_time(parts: Column, month_first: Column) -> Column:
    """The parts as a timestamp; null where that is no date."""
    year = parts["year"].try_cast("int")
    short = FIRST_SHORT_YEAR + F.pmod(year - FIRST_SHORT_YEAR, F.lit(100))
    year = F.when(F.length(parts["year"]) == 2, short).otherwise(year)
    month, day = (F.when(month_first, parts[a]).otherwise(parts[b]) for a, b in (("first", "second"), ("second", "first")))
    month = F.coalesce(month.try_cast("int"), _month(month))
    hour, minute, second = (F.coalesce(parts[n].try_cast("int"), F.lit(0)) for n in ("hour", "minute", "second_of"))
    return F.try_make_timestamp(year, month, day.try_cast("int"), hour, minute, second.cast("decimal(8,6)"))


@dataclass
class DateReading:
    """How a text column's dates are read: for each form the order of its parts, and what it does for values of the other order."""

    orders: dict[str, str]
    evidence: DataFrame

    def parsed(self, c: Column) -> Column:
        """The column as timestamps; a value that only the other order makes a date is read in that one."""
        day_first = [f for f, order in self.orders.items() if order in ("dmy", "dny")]
        free = [f for f, (_, order) in FORMS.items() if order is None]

        def read(parts: Column) -> Column:
            month_first = ~parts["form"].isin(*day_first) if day_first else F.lit(True)
            return F.coalesce(_as_time(parts, month_first), F.when(parts["form"].isin(*free), _as_time(parts, ~month_first)))

        # Of an array of one, so that the parts are taken once.
        return F.transform(F.array(_parts(c)), read)[0]


def read_dates(df: DataFrame, column: str, key: str | None = None) -> DateReading:
    """The reading of a text column, by one aggregate over all its values.

    Where day and month can change places, the order is that of the values in which only one order makes a date; the majority
    of them counts for values in doubt. Without such values, the order that goes along with `key` (a number or time that rises
    with the dates) by a clearly higher correlation; then the one in which a place that never changes is the day, as in monthly
    figures; then month first.

    `evidence` has `form, reading, values, read, doubtful, reason` for each form that occurs: values of that form, those that
    are dates, and those that the other order makes another date; and a row `unread` for values that no form reads.
    """
    c = F.col(f"`{column}`")
    along = F.lit(None).cast("double")
    if key:
        timed = dict(df.dtypes)[key] in ("timestamp", "timestamp_ntz", "date")
        along = F.col(f"`{key}`").cast("timestamp").cast("double") if timed else number(df, key)
    split = df.where(c.isNotNull()).select(_parts(c).alias("parts"), along.alias("along"))
    month_first, day_first = (_as_time(F.col("parts"), F.lit(x)) for x in (True, False))
    times = split.select("parts.form", "along", month_first.alias("m"), day_first.alias("d"), *[F.col(f"parts.{n}").try_cast("int").alias(n) for n in ("first", "second")])
    only_m, only_d = F.expr("m IS NOT NULL AND d IS NULL"), F.expr("d IS NOT NULL AND m IS NULL")
    doubt = F.expr("m <> d")
    rows = times.groupBy("form").agg(
        F.count(F.lit(1)).alias("n"), F.count("m").alias("read_m"), F.count("d").alias("read_d"), F.count(F.coalesce("m", "d")).alias("read"),
        F.count_if(only_m).alias("only_m"), F.count_if(only_d).alias("only_d"), F.count_if(doubt).alias("doubt"),
        *[(F.max(x) - F.min(x)).alias(f"{x}_range") for x in ("first", "second")],
        *[F.corr("along", F.when(doubt, F.col(x)).cast("double")).alias(f"corr_{x}") for x in ("m", "d")],
    )
    facts = {r.form: r for r in rows.collect()}  # one row per form
    orders, found, unread = {}, [], 0
    for form, r in facts.items():
        fixed = FORMS[form][1] if form else None
        if not form:
            unread += r.n
        elif fixed:
            read = r.read_d if fixed == "dny" else r.read_m
            orders[form] = fixed
            found.append((form, fixed, r.n, read, 0, "form"))
            unread += r.n - read
        else:
            orders[form], reason = _order(r)
            found.append((form, orders[form], r.n, r.read, r.doubt, reason))
            unread += r.n - r.read
    if unread:
        found.append(("unread", None, unread, 0, 0, None))
    kinds = "form string, reading string, values bigint, read bigint, doubtful bigint, reason string"
    return DateReading(orders, df.sparkSession.createDataFrame(sorted(found), kinds))


def _order(facts) -> tuple[str, str]:
    """The order of day and month in one form, and why."""
    if facts.only_m != facts.only_d:
        return ("mdy" if facts.only_m > facts.only_d else "dmy"), "impossible days"
    if facts.corr_m is not None and facts.corr_d is not None and abs(abs(facts.corr_m) - abs(facts.corr_d)) > KEY_MARGIN:
        return ("mdy" if abs(facts.corr_m) > abs(facts.corr_d) else "dmy"), "order along key"
    if (facts.first_range == 0) != (facts.second_range == 0):
        return ("dmy" if facts.first_range == 0 else "mdy"), "constant day"
    return "mdy", "default"
