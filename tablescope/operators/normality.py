"""Shapiro-Wilk test on a repeatable sample, by order statistics, normal scores and Royston's coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.columns import candidate_metrics, require_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import number
from tablescope.operators.order import hash_limit, row_hash

#: Rows of the sample of each metric: those with the smallest key hashes.
SAMPLE = 5000

# Published coefficients, by ascending power.
# Normal quantile, centre and tail (Wichura, AS 241).
CENTRE_TOP = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
CENTRE_BOTTOM = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
TAIL_TOP = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640]
TAIL_BOTTOM = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 0.00000000105075007164441684324]
# Largest and second weight from 1 / sqrt(n); mean and log deviation of the transformed statistic (Royston, AS R94).
LAST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN, SMALL_LOG = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN, LARGE_LOG = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]
SMALL_OFFSET = [-2.273, 0.459]
# Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17).
UPPER = [0.0, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def _polynomial(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution, for p from 1e-11 to 1 - 1e-11."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _polynomial(CENTRE_TOP, r) / _polynomial(CENTRE_BOTTOM, r)
    t = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    tail = F.signum(q) * _polynomial(TAIL_TOP, t) / _polynomial(TAIL_BOTTOM, t)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(tail)


def normal_upper(z: Column) -> Column:
    """Probability above z, to seven decimals."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    above = F.exp(-z * z / 2) * 0.3989422804014327 * _polynomial(UPPER, t)
    return F.when(z >= 0, above).otherwise(1 - above)


def metric_sample(df: DataFrame, metrics: list[str], keys: list[str], size: int = SAMPLE) -> DataFrame:
    """`column, value`: of each metric the `size` values whose rows have the smallest key hashes; all where there are fewer."""
    totals = df.agg(*[F.count(number(df, m)) for m in metrics]).first()
    bounds = {m: hash_limit(n, size) for m, n in zip(metrics, totals)}
    hashed = df.select(row_hash(keys).alias("_hash"), *[number(df, m).alias(m) for m in metrics])
    long = hashed.unpivot(["_hash"], metrics, "column", "value").where("value IS NOT NULL")
    near = F.lit(True)
    for m, bound in bounds.items():
        if bound is not None:
            near = near & ((F.col("column") != m) | (F.col("_hash") < bound))
    order = Window.partitionBy("column").orderBy("_hash", "value")
    # After the bound a column has a few times `size` rows at most.
    return long.where(near).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).select("column", "value")


def shapiro_wilk(values: DataFrame) -> DataFrame:
    """`column, n, w, p` from samples (`column, value`) of at most a few thousand values each.

    Below three values there is no test; a constant has w = 1 and p = 1.
    """
    whole = Window.partitionBy("column")
    placed = values.select(
        "column",
        (F.col("value") - F.avg("value").over(whole)).alias("x"),
        F.row_number().over(whole.orderBy("value")).alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    scored = placed.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    i, n, x, m = (F.col(c) for c in "inxm")
    edge = F.when(n > 5, 2).otherwise(1)
    inner = (i > edge) & (i <= n - edge)
    sums = scored.groupBy("column", "n").agg(
        F.sum(x * x).alias("ss"),
        F.sum(m * m).alias("mm"),
        F.coalesce(F.sum(F.when(inner, m * x)), F.lit(0.0)).alias("mx"),
        F.max(F.when(i == n, m)).alias("m1"),
        F.max(F.when(i == n - 1, m)).alias("m2"),
        (F.max(x) - F.min(x)).alias("outer"),
        (F.max(F.when(i == n - 1, x)) - F.max(F.when(i == 2, x))).alias("next"),
    )
    u, many = 1 / F.sqrt(n), n > 5
    mm, m1, m2 = F.col("mm"), F.col("m1"), F.col("m2")
    weighted = sums.withColumn("a1", _polynomial(LAST, u) + m1 / F.sqrt(mm)).withColumn("a2", _polynomial(SECOND, u) + m2 / F.sqrt(mm))
    a1, a2 = F.col("a1"), F.col("a2")
    phi = F.when(many, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    line = F.when(n == 3, F.col("outer") * F.sqrt(F.lit(0.5))).otherwise(
        F.col("mx") / F.sqrt(phi) + a1 * F.col("outer") + F.when(many, a2 * F.col("next")).otherwise(0.0)
    )
    w = F.when(n >= 3, F.when(F.col("ss") == 0, 1.0).otherwise(F.least(F.lit(1.0), line * line / F.col("ss"))))
    found = weighted.withColumn("w", w)
    y, log_n = F.log(1 - F.col("w")), F.log(n)
    small = (-F.log(_polynomial(SMALL_OFFSET, n) - y) - _polynomial(SMALL_MEAN, n)) / F.exp(_polynomial(SMALL_LOG, n))
    large = (y - _polynomial(LARGE_MEAN, log_n)) / F.exp(_polynomial(LARGE_LOG, log_n))
    three = 6 / F.pi() * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75))))
    # Beyond the offset the statistic is smaller than any chance.
    p = (
        F.when(F.col("w") == 1, 1.0)
        .when(n == 3, F.greatest(three, F.lit(0.0)))
        .when(n <= 11, F.when(y >= _polynomial(SMALL_OFFSET, n), 0.0).otherwise(normal_upper(small)))
        .otherwise(normal_upper(large))
    )
    return found.select("column", "n", "w", F.when(n >= 3, p).alias("p"))


def normality(df: DataFrame, keys: list[str], metrics: list[str] | None = None, size: int = SAMPLE) -> DataFrame:
    """`column, n, w, p_value, normal` of each metric with a value, on its sample of at most `size` rows; `keys` are unique."""
    metrics = require_columns(df, metrics or candidate_metrics(df), numeric=True)
    require_columns(df, keys)
    found = shapiro_wilk(metric_sample(df, metrics, keys, size))
    return found.select("column", "n", F.round("w", 6).alias("w"), F.round("p", 4).alias("p_value"), (F.col("p") > fx.NORMALITY_P).alias("normal"))
