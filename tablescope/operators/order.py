"""Row order at scale: range-partitioned sort, row index, running totals, hash samples.

A window without partition keys would put every row into one task. Here the rows are range partitioned on the
complete order (date plus a unique key), so a date that holds a third of the table is still split, and
`monotonically_increasing_id` gives the range number and the position inside it without a second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.operators.quantiles import Bracket, find_ranks, sketch
from tablescope.plans.scratch import write_scratch

POSITION_BITS = 33  # fixed by monotonically_increasing_id


def sorted_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with `_range` (ordered range number) and `_pos` (0-based place inside the range).

    Use the result in one branch only: the range bounds belong to this one shuffle. For several branches,
    write it first (`row_index`, `running_total`).
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    return placed.select(
        "*",
        F.shiftright("_id", POSITION_BITS).alias("_range"),
        F.col("_id").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("_pos"),
    ).drop("_id")


def _join_offsets(placed: DataFrame, per_range: DataFrame) -> DataFrame:
    """Add `_before` and `_all`, the running and complete sums of the per-range totals, which hold one row per range (task)."""
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        F.sum("_total").over(before).alias("_before"),
        F.sum("_total").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    return placed.join(F.broadcast(offsets), "_range")


def row_index(df: DataFrame, order: list[Column]) -> DataFrame:
    """Dense 0-based `row_index` in the given (unique) order, plus `row_count`."""
    written = write_scratch(sorted_ranges(df, order), "sorted")
    placed = _join_offsets(written, written.groupBy("_range").agg(F.count(F.lit(1)).alias("_total")))
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_pos")).alias("row_index"),
        F.col("_all").alias("row_count"),
    )


def running_total(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """`running_total` of `value` down the order and `grand_total` on every row."""
    written = write_scratch(sorted_ranges(df, order), "sorted")
    inside = Window.partitionBy("_range").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = written.withColumn("_inside", F.sum(value).over(inside))
    placed = _join_offsets(placed, written.groupBy("_range").agg(F.sum(value).alias("_total")))
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.coalesce(F.col("_before"), F.lit(0.0)) + F.col("_inside")).alias("running_total"),
        F.col("_all").alias("grand_total"),
    )


def first_half(df: DataFrame, keys: list[str], when: str | None = None) -> Column:
    """Condition that is true for exactly the first floor(n/2) rows in order of (`when` nulls last, unique keys).

    Nothing is sorted but the rows that share the date at the cut: the date there is found as an exact rank, and
    only among its rows (a third of the table at worst) the keys are range sorted to find the last one to take.
    """
    if when is None:
        return _keys_before(df, df.count() // 2, keys)
    at = F.unix_micros(F.col(when).cast("timestamp"))
    stamps = df.select(at.cast("double").alias("at"))
    n, dated, least, greatest, ends = stamps.agg(
        F.count(F.lit(1)), F.count("at"), F.min("at"), F.max("at"), sketch(F.col("at"), [0.5])
    ).first()
    rank = n // 2
    if rank == 0:
        return F.lit(False)
    if rank < dated:
        low, high = ends if n == dated else (least, greatest)
        cut = find_ranks(stamps, [Bracket("at", rank, low, high, least, greatest)])[0]
        earlier, ties, taken = at < int(cut.lower), at == int(cut.lower), rank - cut.before
    else:
        earlier, ties, taken = F.col(when).isNotNull(), F.col(when).isNull(), rank - dated
    earlier = F.coalesce(earlier, F.lit(False))
    if taken == 0:
        return earlier
    return earlier | (F.coalesce(ties, F.lit(False)) & _keys_before(df.where(ties), taken, keys))


def _keys_before(df: DataFrame, rank: int, keys: list[str]) -> Column:
    indexed = row_index(df.select(*keys), [F.col(k) for k in keys])
    cut = indexed.where(F.col("row_index") == rank).select(*keys).first()
    if cut is None:
        return F.lit(True)
    before = F.lit(False)
    for k in reversed(keys):
        bound = F.lit(cut[k]).cast(df.schema[k].dataType)
        before = (F.col(k) < bound) | ((F.col(k) == bound) & before)
    return before


def row_hash(keys: list[str]) -> Column:
    """md5 of the row key; the same text as SQL `md5(concat_ws('~', ...))`."""
    return F.md5(F.concat_ws("~", *[F.col(f"`{k}`").cast("string") for k in keys]))


def hash_limit(rows: int, wanted: int) -> str | None:
    """Upper hash bound that keeps about four times `wanted` rows; None when all rows are needed.

    With unique keys the number of kept rows is binomial, so fewer than `wanted` is out of the question
    (below exp(-1.1 * wanted)); the exact bottom-k is then taken from this small remainder.
    """
    aim = 4 * wanted + 1000
    if rows <= aim:
        return None
    return f"{int(aim / rows * 2**32):08x}"


def hash_sample(df: DataFrame, keys: list[str], size: int, rows: int | None = None) -> DataFrame:
    """Repeatable sample: the `size` rows with the smallest key hash. `keys` must be unique."""
    rows = df.count() if rows is None else rows
    hashed = df.withColumn("_hash", row_hash(keys))
    bound = hash_limit(rows, size)
    if bound is not None:
        hashed = hashed.where(F.col("_hash") < bound)
    return hashed.orderBy("_hash").limit(size).drop("_hash")


def first_row(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row; with `keys` always the same one."""
    return df.orderBy(*keys).limit(1) if keys else df.limit(1)


def first_values(df: DataFrame, column: str, order: list[str], size: int) -> DataFrame:
    """The first `size` distinct values in order of appearance."""
    seen = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    return seen.orderBy("_first").limit(size).select(F.lit(column).alias("column"), "value")
