"""The statistics agree with pandas formulas on made-up frames with gaps, ties and heavy values."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescope.operators import charts, findings, groups, order, profile, quantiles


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame(
        {
            "k": np.arange(n),
            "day": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D"),
            "a": rng.normal(10, 3, n),
            "b": rng.exponential(2, n),
            "c": rng.integers(0, 5, n).astype(float),
            "s": rng.choice(["x", "y", "z"], n, p=[0.7, 0.2, 0.1]),
        }
    )
    pdf.loc[pdf.k % 3 == 0, "day"] = pd.Timestamp("2024-01-15")  # a third of all rows on one date
    pdf.loc[pdf.k % 11 == 0, "b"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data).withColumn("b", F.nanvl("b", F.lit(None))).cache()


def test_summary(data, table):
    got = {r["column"]: r for r in profile.numeric_summary(table, ["a", "b", "c"]).collect()}
    for c in "abc":
        d = data[c].describe()
        pairs = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}
        for ours, theirs in pairs.items():
            assert got[c][ours] == pytest.approx(d[theirs], rel=1e-12), (c, ours)
        assert got[c]["skewness"] == round(data[c].skew(), 3)
        assert got[c]["kurtosis"] == round(data[c].kurt(), 3)


def test_sketch_quartiles_are_close(data, table):
    got = {r["column"]: r for r in profile.numeric_summary(table, ["a"], exact=False).collect()}
    assert got["a"]["q50"] == pytest.approx(data["a"].median(), abs=0.05)


def test_distinct_and_duplicates(data, table):
    got = {r["column"]: r["cardinality"] for r in profile.distinct_counts(table).collect()}
    assert got == data.nunique().to_dict()
    near = {r["column"]: r["cardinality"] for r in profile.distinct_counts(table, approx=True).collect()}
    assert near["a"] == pytest.approx(4000, rel=0.05)
    assert profile.duplicate_rows(table.select("c", "s")) == int(data[["c", "s"]].duplicated().sum())
    assert profile.duplicate_rows(table) == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.sampled_from([0.0, 1.0, 1.0, 2.5, -3.0, 1e9]), min_size=1, max_size=60),
    st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]),
)
def test_quantiles_with_ties(spark, values, prob):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.exact_quantiles(df, ["v"], [prob], bracket_rows=3)["v"][0]
    assert got == pytest.approx(float(np.quantile(values, prob)))


def test_quantiles_narrow_a_large_bracket(data, table, monkeypatch):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 10)  # a sketch this coarse misses and must be repaired
    got = quantiles.exact_quantiles(table, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.99, 1.0], bracket_rows=5)
    for c in "abc":
        assert got[c] == pytest.approx(list(data[c].quantile([0.0, 0.25, 0.5, 0.99, 1.0])))


def test_outliers(data, table):
    got = {r["column"]: r for r in findings.outliers(table, ["a", "b", "c"]).collect()}
    for c in "ab":
        z = ((data[c] - data[c].mean()) / data[c].std(ddof=0)).abs()
        assert (got[c]["counts"], got[c]["max_zscore"]) == (int((z > 3).sum()), round(z.max(), 3))
    assert "c" not in got


def test_trend(data, table):
    ordered = data.sort_values(["day", "k"])
    got = {r["column"]: r for r in findings.trend(table, ["a", "b", "c"], "day", ["k"], epsilon=0.0).collect()}
    for c in "abc":
        y = ordered[c].dropna().to_numpy()
        x = np.arange(len(y))
        slope = np.polyfit(x, y, 1)[0]
        assert got[c]["value"] == round(slope, 3)
        assert got[c]["r2"] == round(np.corrcoef(x, y)[0, 1] ** 2, 3)
        assert got[c]["trend"] == ("Negative" if slope < 0 else "Positive")


def test_trend_slope_is_exact_before_rounding(data, table):
    ordered = data.sort_values(["day", "k"]).assign(big=lambda d: d["k"] * 1000.0)
    big = table.withColumn("big", F.col("k") * 1000.0)
    got = findings.trend(big, ["big"], "day", ["k"]).first()["value"]
    y = ordered["big"].to_numpy()
    assert got == pytest.approx(round(np.polyfit(np.arange(len(y)), y, 1)[0], 3), abs=2e-3)


def test_correlations(data, table):
    pairs = {(r["col1"], r["col2"]): r["corr"] for r in findings.correlation_matrix(table, ["a", "b", "c"]).collect()}
    expected = data[["a", "b", "c"]].corr()
    assert all(pairs[(i, j)] == pytest.approx(expected.loc[i, j], abs=6e-5) for i in "abc" for j in "abc")


def test_sixty_columns_with_gaps_correlate_in_one_scan(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 60)) @ rng.normal(size=(60, 60)), columns=[f"c{i:02d}" for i in range(60)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    pdf["c07"] = 4.0
    got = {(r["col1"], r["col2"]): r["corr"] for r in findings.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr()
    for a in pdf.columns:
        for b in pdf.columns:
            if "c07" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want.loc[a, b], abs=6e-5)


def test_many_columns_correlate_in_several_jobs(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 14)), columns=[f"c{i:02d}" for i in range(14)])
    pdf["c13"] = pdf["c00"] * 2 + 0.01 * pdf["c01"]
    got = [tuple(r) for r in findings.correlations(spark.createDataFrame(pdf)).collect()]
    assert [g[:2] for g in got] == [("c00", "c13")] and got[0][3:] == ("strong", "both columns might mean the same")


def test_groups(data, table):
    stats = {(r["key"], r["metric"]): r for r in groups.group_stats(table, ["a", "b"], ["s"]).collect()}
    for m in "ab":
        g = data.groupby("s")[m].agg(["sum", "mean", "std", "count"])
        for key in "xyz":
            r = stats[(key, m)]
            assert [r["total"], r["mean"], r["sd"], r["n"]] == pytest.approx(list(g.loc[key]))


def test_row_index_and_running_total(data, table):
    got = order.row_index(table.select("k", "day"), [F.col("day"), F.col("k")]).orderBy("row_index").collect()
    expected = data.sort_values(["day", "k"])["k"].tolist()
    assert [r["k"] for r in got] == expected
    assert [r["row_index"] for r in got] == list(range(len(expected)))
    total = order.running_total(table.select("k", "a"), "a", [F.desc("a"), F.asc("k")]).orderBy(F.desc("a")).collect()
    assert [r["running_total"] for r in total] == pytest.approx(data["a"].sort_values(ascending=False).cumsum().tolist())


def test_first_half(data, table):
    early = order.first_half(table, ["k"], "day")
    got = {r["k"] for r in table.where(early).select("k").collect()}
    assert got == set(data.sort_values(["day", "k"])["k"][: len(data) // 2])


def test_hash_sample_is_bottom_k(spark, table):
    import hashlib

    df = spark.range(30000).withColumnRenamed("id", "k")
    got = {r["k"] for r in order.hash_sample(df, ["k"], 50).collect()}
    expected = sorted(range(30000), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:50]
    assert got == set(expected)


def test_pareto_and_box(data, table):
    rows = charts.pareto(table, "s", "a").collect()
    means = data.groupby("s")["a"].mean().sort_values(ascending=False)
    got = {r["x"]: r["cumulative_pct"] for r in rows}
    assert got == pytest.approx((means.cumsum() / means.sum() * 100).to_dict())
    box = charts.box(table, "b").first()
    q1, q3 = data["b"].quantile([0.25, 0.75])
    inside = data["b"][data["b"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert box["whisker_high"] == inside.max() and box["beyond"] == data["b"].count() - len(inside)


def test_line_fit_by_color(data, table):
    got = {r["color"]: r for r in charts.ols_line(table, "a", "c", "s").collect()}
    for s, part in data.groupby("s"):
        slope, intercept = np.polyfit(part["a"], part["c"], 1)
        assert (got[s]["slope"], got[s]["intercept"]) == pytest.approx((slope, intercept))
