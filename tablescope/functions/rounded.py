"""Numbers in texts that were rounded or carry a unit, held against exact values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How numbers and their units are written.
ROUNDED_PATTERN = r"(\d[\d,]*(?:\.\d+)?)(?:\s?(%|percent\b|thousand\b|million\b|billion\b|[KkMmBb]\b))?"
UNITS = {"thousand": 3, "k": 3, "million": 6, "m": 6, "billion": 9, "b": 9}
PERCENT = ("%", "percent")
#: Decimal places that count; digits of the longest number.
PLACES, DIGITS = 10, 18


def mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """`<key>, place, mention, digits, shown, power, percent`: every number with its digits as a whole number, its decimal
    places, and the power of ten of its unit. Numbers of more digits or places than are read have null `digits`."""
    pattern = F.lit(ROUNDED_PATTERN)
    parts = F.arrays_zip(
        F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("mention"),
        F.regexp_extract_all(F.col(text), pattern, F.lit(1)).alias("number"),
        F.regexp_extract_all(F.col(text), pattern, F.lit(2)).alias("unit"),
    )
    rows = df.select(key, F.posexplode(parts).alias("place", "z")).select(key, "place", "z.mention", "z.number", F.lower("z.unit").alias("unit"))
    plain = F.replace(F.col("number"), F.lit(","), F.lit(""))
    digits = F.replace(plain, F.lit("."), F.lit(""))
    shown = F.length(F.substring_index(plain, ".", -1))
    shown = F.when(F.contains(plain, F.lit(".")), shown).otherwise(0)
    power = F.lit(0)
    for unit, p in UNITS.items():
        power = F.when(F.col("unit") == unit, p).otherwise(power)
    percent = F.col("unit").isin(*PERCENT)
    readable = (F.length(digits) <= DIGITS) & (shown <= F.when(percent, PLACES - 2).otherwise(PLACES))
    return rows.select(key, "place", "mention", F.when(readable, digits.try_cast("bigint")).alias("digits"), shown.alias("shown"), power.alias("power"), percent.alias("percent"))


def _truth_keys(truth: DataFrame, value: str, scales: list[int]) -> DataFrame:
    """`scale, bucket, n`: how many distinct values lie in each half unit of each scale, its ends included.

    A mention of c units of 10^scale stands for the values from c - 1/2 to c + 1/2 units: the half units 2c - 1 and 2c. A value
    on the end between two mentions belongs to both, so it is also counted in the half unit below.
    """
    whole = F.abs(F.col(value).try_cast(f"decimal({DIGITS + PLACES},{PLACES})"))
    values = truth.select(whole.alias("v")).where("v IS NOT NULL").distinct()
    double = values.select(F.expr(f"cast(v * {10**PLACES}BD as decimal(38,0)) * 2").cast("decimal(38,0)").alias("x"))
    each = []
    for s in scales:
        unit = 10 ** (s + PLACES)
        # No mention has so many units that a larger value could be meant.
        bucket = F.expr(f"CASE WHEN x <= {4 * 10**DIGITS * unit}BD THEN x div {unit}BD END")
        shared = F.expr(f"x % {unit}BD = 0") & (bucket % 2 == 1)
        each += [F.struct(F.lit(s).alias("scale"), b.alias("bucket")) for b in (bucket, F.when(shared, bucket - 1))]
    keys = double.select(F.explode(F.array(*each)).alias("k")).select("k.*").where("bucket IS NOT NULL")
    return keys.groupBy("scale", "bucket").agg(F.count(F.lit(1)).alias("n"))


def rounded_numbers(df: DataFrame, key: str, text: str, truth: DataFrame, value: str) -> DataFrame:
    """`<key>, place, mention, low, high, matches, supported` of every number of every text.

    `matches` counts the distinct values of `truth` that round to what is shown: those from `low` to `high`, half a unit of the
    last shown digit on each side. A percentage also stands for shares, a hundredth of it. The join is one of equal keys: a mention
    covers two half units of its own scale, and the values are counted by half unit on the scales that occur. Signs are
    ignored. Values beyond 18 digits before or 10 places behind the point aren't compared. `key` must be unique.
    """
    found = mentions(df, key, text)
    plain = F.col("power") - F.col("shown")
    readings = F.when(F.col("percent"), F.array(plain, plain - 2)).otherwise(F.array(plain))
    known = found.where("digits IS NOT NULL")
    # Units and shown places bound the scales to some twenty.
    scales = sorted(r.s for r in known.select(F.explode(readings).alias("s")).distinct().collect())
    scale_unit = F.pow(F.lit(10.0), plain.cast("double"))
    marked = found.select(
        key, "place", "mention", "digits",
        F.when(F.col("digits") > 0, (F.col("digits") - 0.5) * scale_unit).when(F.col("digits") == 0, 0.0).alias("low"),
        ((F.col("digits") + 0.5) * scale_unit).alias("high"),
        F.explode_outer(F.when(F.col("digits").isNotNull(), readings)).alias("scale"),
    )
    twice = F.col("digits") * 2
    asked = marked.withColumn("bucket", F.explode_outer(F.when(F.col("scale").isNotNull(), F.array(twice - 1, twice))))
    counted = _truth_keys(truth, value, scales) if scales else df.sparkSession.createDataFrame([], "scale int, bucket bigint, n bigint")
    joined = asked.join(counted, ["scale", "bucket"], "left")
    total = joined.groupBy(key, "place", "mention", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("matches"))
    return total.select(key, "place", "mention", "low", "high", "matches", (F.col("matches") > 0).alias("supported"))
