"""Exact linear-interpolation quantiles without collecting a column's values into one task.

The built-in exact `percentile` keeps every distinct value of a group in one buffer. Here the approximate
sketch only brackets each wanted rank; the bracket is counted exactly, narrowed while it is large, and only
the values inside it are grouped. The answer is exact whatever the sketch error was.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions.scalars import number

SKETCH_ACCURACY = 10_000
BRACKET_ROWS = 500_000
#: Columns or brackets that one aggregate takes; the aggregates of all run side by side in one job.
TOGETHER = 8


@dataclass
class Bracket:
    """A value range that should hold one rank (0-based, may lie between two rows) of a double column."""

    column: str
    rank: float
    low: float
    high: float
    least: float
    greatest: float
    below: int = 0
    inside: int = 0
    sure: tuple[float, float] | None = None  # the last ends that held the rank

    def holds_rank(self) -> bool:
        return self.below <= math.floor(self.rank) and math.ceil(self.rank) < self.below + self.inside

    def contains(self) -> Column:
        return F.col(f"`{self.column}`").between(self.low, self.high)


@dataclass
class Found:
    """The rows next to a rank: their values, and how many rows hold a smaller value than the lower one."""

    lower: float
    upper: float
    before: int


def sketch(c: Column, probs: list[float]) -> Column:
    """Bracket ends around each probability, two sketch errors to each side."""
    slack = 2.0 / SKETCH_ACCURACY
    ends = [max(0.0, min(1.0, p + d)) for p in probs for d in (-slack, slack)]
    return F.percentile_approx(c, ends, SKETCH_ACCURACY)


def _gathered(values: DataFrame, items: list, aggregates) -> list:
    """A struct of aggregates for each item. Each aggregate reads only the columns of its own items."""
    parts = []
    for at in range(0, len(items), TOGETHER):
        own = items[at : at + TOGETHER]
        totals = values.agg(*[aggregates(x).alias(f"r{k}") for k, x in enumerate(own)])
        parts.append(totals.select(F.inline(F.array(*[F.struct(F.lit(at + k).alias("i"), F.col(f"r{k}").alias("r")) for k in range(len(own))]))))
    rows = reduce(DataFrame.unionAll, parts).collect()  # one row per item
    return [x.r for x in sorted(rows, key=lambda x: x.i)]


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], bracket_rows: int = BRACKET_ROWS
) -> dict[str, list[float | None]]:
    """`{column: [value per prob]}`; None for a column without values."""
    if not columns:
        return {}
    values = df.select(*[number(df, c).alias(c) for c in columns])

    def facts(c: str) -> Column:
        v = F.col(f"`{c}`")
        return F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), sketch(v, probs).alias("ends"))

    first = _gathered(values, columns, facts)
    places, brackets = [], []
    for i, c in enumerate(columns):
        n, lo, hi, ends = first[i]
        for j, p in enumerate(probs if n else []):
            low, high = ends[2 * j : 2 * j + 2]
            places.append((c, j))
            brackets.append(Bracket(c, (n - 1) * p, low, high, lo, hi))
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for (c, j), b, found in zip(places, brackets, find_ranks(values, brackets, bracket_rows)):
        out[c][j] = found.lower + (found.upper - found.lower) * (b.rank - math.floor(b.rank))
    return out


def find_ranks(values: DataFrame, brackets: list[Bracket], bracket_rows: int = BRACKET_ROWS) -> list[Found]:
    """Exact rows next to the rank of each bracket."""
    if not brackets:
        return []
    _narrow(values, brackets, bracket_rows)
    return _read(values, brackets)


def _narrow(values: DataFrame, brackets: list[Bracket], bracket_rows: int) -> None:
    """Count the brackets; widen those that miss their rank, sketch again inside those that hold too many rows.

    Each round divides the rows inside a bracket by about 2500, down to the rows of a few heavy values, which
    grouping collapses. A bracket that misses its rank goes back to the last ends that held it and stays there, or to the
    whole column; so every bracket holds its rank in the end.
    """
    todo = list(brackets)
    while todo:
        _count(values, todo)
        large, again = [], []
        for b in todo:
            if not b.holds_rank():
                b.low, b.high = b.sure or (b.least, b.greatest)
                again.append(b)
            elif b.inside > bracket_rows and b.low < b.high and (b.low, b.high) != b.sure:
                b.sure = (b.low, b.high)
                large.append(b)
        todo = again + _sketch_inside(values, large)


def _count(values: DataFrame, brackets: list[Bracket]) -> None:
    counted = lambda b: F.struct(F.count_if(F.col(f"`{b.column}`") < b.low).alias("below"), F.count_if(b.contains()).alias("inside"))
    for b, found in zip(brackets, _gathered(values, brackets, counted)):
        b.below, b.inside = found


def _sketch_inside(values: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """Tighten the brackets and return those that changed."""
    if not brackets:
        return []
    inner = lambda b: F.struct(sketch(F.when(b.contains(), F.col(f"`{b.column}`")), [(b.rank - b.below) / max(b.inside - 1, 1)]).alias("ends"))
    ends = [r.ends for r in _gathered(values, brackets, inner)]
    changed = []
    for b, (low, high) in zip(brackets, ends):
        if (low, high) != (b.low, b.high):
            b.low, b.high = low, high
            changed.append(b)
    return changed


def _read(values: DataFrame, brackets: list[Bracket]) -> list[Found]:
    """Group the values inside each bracket (map-side first) and read the rows on both sides of each rank."""
    parts = []
    for at in range(0, len(brackets), TOGETHER):
        targets = [
            F.when(b.contains(), F.struct(F.lit(at + k).alias("target"), F.col(f"`{b.column}`").alias("value")))
            for k, b in enumerate(brackets[at : at + TOGETHER])
        ]
        parts.append(values.select(F.explode(F.array(*targets)).alias("t")).where("t is not null").select("t.*"))
    inside = reduce(DataFrame.unionAll, parts)
    counted = inside.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("target").orderBy("value")
    ranked = counted.withColumn("seen", F.sum("n").over(upto))
    lower = _by_target([math.floor(b.rank) - b.below for b in brackets])
    upper = _by_target([math.ceil(b.rank) - b.below for b in brackets])
    rows = (
        ranked.groupBy("target")
        .agg(
            F.min(F.when(F.col("seen") > lower, F.struct("value", (F.col("seen") - F.col("n")).alias("before")))).alias("at"),
            F.min(F.when(F.col("seen") > upper, F.col("value"))).alias("upper"),
        )
        .collect()
    )
    found = {r["target"]: r for r in rows}
    return [
        Found(found[i]["at"]["value"], found[i]["upper"], found[i]["at"]["before"] + b.below)
        for i, b in enumerate(brackets)
    ]


def _by_target(numbers: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in numbers]).cast("array<bigint>"), F.col("target") + 1)
