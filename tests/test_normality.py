"""Shapiro-Wilk against published results and a plain computation."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tablescope.operators import normality


def test_published_example(spark):
    # Weights of eleven men (Shapiro and Wilk, 1965); W = 0.7888, p = 0.006704 in the usual packages.
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("w", float(x)) for x in weights], "column string, value double")
    got = normality.shapiro_wilk(df).first()
    assert got.n == 11 and abs(got.w - 0.78881) < 2e-5 and abs(got.p - 0.006704) < 2e-6


def plain(values):
    """W by weights written out one by one."""
    x, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
    mm, u = sum(v * v for v in m), 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        last = sum(c * u**k for k, c in enumerate(normality.LAST)) + m[-1] / math.sqrt(mm)
        second = sum(c * u**k for k, c in enumerate(normality.SECOND)) + m[-2] / math.sqrt(mm)
        if n > 5:
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [-last, -second, *[v / math.sqrt(phi) for v in m[2:-2]], second, last]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [-last, *[v / math.sqrt(phi) for v in m[1:-1]], last]
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_w_of_many_sizes(spark):
    r = random.Random(2)
    samples = {f"{n}{kind}": [f(r) for _ in range(n)] for n in (3, 4, 5, 6, 7, 11, 12, 50, 700) for kind, f in (("n", lambda r: r.gauss(1e6, 1)), ("e", lambda r: r.expovariate(1)), ("t", lambda r: r.randint(1, 4)))}
    samples = {k: v for k, v in samples.items() if len(set(v)) > 1}
    df = spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v], "column string, value double")
    got = {r.column: r for r in normality.shapiro_wilk(df).collect()}
    assert got.keys() == samples.keys()
    for k, v in samples.items():
        assert abs(got[k].w - min(1, plain(v))) < 1e-7 and 0 <= got[k].p <= 1
    assert got["700n"].p > 0.001 and got["700e"].p < 1e-6 and got["50e"].p < 0.01


def test_quantile_and_tail(spark):
    df = spark.createDataFrame([(p,) for p in (1e-9, 1e-4, 0.02, 0.075, 0.4, 0.5, 0.93, 0.999)], "p double")
    for r in df.select("p", normality.normal_quantile(F.col("p")).alias("q")).collect():
        assert abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-12
    for r in df.select(normality.normal_quantile(F.col("p")).alias("z")).select("z", normality.normal_upper(F.col("z")).alias("u")).collect():
        assert abs(r.u - (1 - NormalDist().cdf(r.z))) < 1e-7


def test_sample_is_bounded_and_edges(spark):
    df = spark.range(40_000).select("id", F.randn(5).alias("a"), F.when(F.col("id") < 2, 1.0).alias("b"), F.lit(4).alias("c"), F.lit(None).cast("double").alias("d"))
    got = {r.column: r for r in normality.normality(df, ["id"], ["a", "b", "c", "d"]).collect()}
    assert (got["a"].n, got["a"].normal, got["b"].n, got["b"].w, got["b"].normal) == (5000, True, 2, None, None)
    assert (got["c"].n, got["c"].w, got["c"].p_value) == (5000, 1.0, 1.0) and "d" not in got
    with pytest.raises(ValueError, match="not in table"):
        normality.normality(df, ["key"], ["a"])
