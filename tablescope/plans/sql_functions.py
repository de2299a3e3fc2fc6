"""The operators that SQL users call: scalar SQL functions, and table functions over any table argument.

`register(spark)` makes them known to the session. Expressions become temporary SQL functions, which the optimiser sees through.
What needs rows becomes a table function, whose columns follow from the table that it is called with:

    SELECT * FROM trend_of(TABLE(SELECT nation, order_date, revenue FROM sales) PARTITION BY nation ORDER BY order_date)
    SELECT * FROM mentions_of(TABLE(SELECT doc_id, text FROM reports))

A table function with PARTITION BY sees one group after the other, row by row, and keeps a few sums of it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tablescope.functions import fixed_values as fx
from tablescope.functions.rounded import ROUNDED_PATTERN

#: Name and parameters, type and body of each scalar function.
SCALARS = {
    "clean_text(t STRING)": ("STRING", f"replace(translate(t, '{fx.SPACE_LIKE}{fx.HYPHEN_LIKE}', '  --'), '{fx.EM_DASH}', '--')"),
    "word_count(t STRING)": ("INT", r"regexp_count(t, r'\S+')"),
    "percent_change(now DOUBLE, base DOUBLE)": ("DOUBLE", "CASE WHEN base = 0 THEN 0.0D ELSE try_divide(now - base, base) * 100 END"),
    "compact_number(v DOUBLE)": ("STRING", "CASE WHEN v >= 1000 THEN format_string('%.2fK', v / 1000) ELSE string(round(v, 2)) END"),
    "value_token(v STRING, secret STRING, namespace STRING)": ("STRING", "CASE WHEN v IS NOT NULL THEN concat('ID-', substring(sha2(concat_ws('~', secret, namespace, v), 256), 1, 16)) END"),
}


def _columns(table: AnalyzeArgument, least: int, name: str) -> list[T.StructField]:
    if not table.isTable or len(table.dataType.fields) < least:
        raise ValueError(f"{name} takes a table of at least {least} columns")
    return table.dataType.fields


class TrendOf:
    """The table's first column (the group), how many rows of it have a number in the last column, the slope of that column along
    the rows in their order, and r squared. Rows without a number don't count; below two rows both are null."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        group = _columns(table, 2, "trend_of")[0]
        return AnalyzeResult(T.StructType([
            T.StructField(group.name, group.dataType), T.StructField("n", T.LongType()), T.StructField("slope", T.DoubleType()), T.StructField("r2", T.DoubleType()),
        ]))

    def __init__(self):
        self.group, self.n = None, 0
        self.mean_x = self.mean_y = self.xx = self.yy = self.xy = 0.0

    def eval(self, row):
        self.group, y = row[0], row[-1]
        if y is None or math.isnan(y):
            return
        x, y = float(self.n), float(y)
        self.n += 1
        dx, dy = x - self.mean_x, y - self.mean_y
        self.mean_x += dx / self.n
        self.mean_y += dy / self.n
        self.xx += dx * (x - self.mean_x)
        self.yy += dy * (y - self.mean_y)
        self.xy += dx * (y - self.mean_y)

    def terminate(self):
        slope = self.xy / self.xx if self.n > 1 else None
        r2 = None if self.n < 2 else self.xy**2 / (self.xx * self.yy) if self.yy else 0.0
        yield self.group, self.n, slope, r2


class MentionsOf:
    """Every number in the table's last column, a text, with its place among them; the first column goes along."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        key = _columns(table, 2, "mentions_of")[0]
        return AnalyzeResult(T.StructType([T.StructField(key.name, key.dataType), T.StructField("place", T.IntegerType()), T.StructField("mention", T.StringType())]))

    def __init__(self):
        self.pattern = re.compile(ROUNDED_PATTERN, re.ASCII)

    def eval(self, row):
        for place, m in enumerate(self.pattern.finditer(row[-1] or "")):
            yield row[0], place, m[0]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, in place of earlier ones of their names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("trend_of", udtf(TrendOf))
    spark.udtf.register("mentions_of", udtf(MentionsOf))
