"""Merged profile states against the profile of all rows."""

import random
import uuid

import pytest

from tablescope.operators.profile import column_profile
from tablescope.operators.sketches import merge_states, profile_of_states, profile_state
from tablescope.streaming.landing import landing_state, landing_total, profile_landing

SCHEMA = "k bigint, v double, name string, flag boolean, day string, gone int, same double, at timestamp"


def rows_of(n, seed):
    r = random.Random(seed)
    return [
        (k, None if r.random() < 0.1 else float("nan") if r.random() < 0.1 else 1e6 + r.gauss(0, 3) ** 3, r.choice("abcdef") * r.randint(1, 90), r.random() < 0.3,
         f"2024-01-{r.randint(10, 28)}" if r.random() < 0.9 else "x", None, 5.0, None)
        for k in range(n)
    ]


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1e-6 * max(1, abs(b)))


@pytest.mark.parametrize("sizes", [[1, 0, 700, 2], [1500], [2, 1]])
def test_merged_profile_is_that_of_all_rows(spark, sizes):
    batches = [spark.createDataFrame(rows_of(n, i), SCHEMA) for i, n in enumerate(sizes)]
    states, every = profile_state(batches[0]), batches[0]
    for b in batches[1:]:
        states, every = states.unionAll(profile_state(b)), every.unionAll(b)
    got = {r["column"]: r for r in profile_of_states(states).collect()}
    again = {r["column"]: r for r in profile_of_states(merge_states(states)).collect()}
    want = {r["column"]: r for r in column_profile(every).collect()}
    assert got.keys() == want.keys() == again.keys()
    for c, w in want.items():
        for r in (got[c], again[c]):
            assert (r.dtype, r.null_count, r.null_percent, r.role) == (w.dtype, w.null_count, w.null_percent, w.role), c
            for m in ("mean", "std", "min", "max", "skewness", "kurtosis"):
                assert close(r[m], w[m]), (c, m, r[m], w[m])
            assert abs(r.cardinality - w.cardinality) <= 0.03 * w.cardinality
    values = sorted(x.v for x in every.where("v is not null and not isnan(v)").collect())
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        if values:
            low, high = sum(x < got["v"][q] for x in values), sum(x <= got["v"][q] for x in values)
            assert low <= (p + 0.02) * len(values) + 1 and high >= (p - 0.02) * len(values) - 1


def test_landing_total_reads_no_row_again(spark, tmp_path):
    landing, out, name = tmp_path / "in", str(tmp_path / "out"), uuid.uuid4().hex
    landing.mkdir()
    lines = ['1,"a ""b"", c",1.5\n', "2,NA,nan\n3,x,\n", "4,x,8.5\n"]
    for i, text in enumerate(lines):
        (landing / f"{i}.csv").write_text("k,cat,v\n" + text)
        run = profile_landing(spark, str(landing), "k int, cat string, v double", out, name, each_batch=False)
        run.awaitTermination(120)
        assert run.exception() is None
    assert {r.cat for r in spark.read.parquet(f"{out}/rows").collect()} == {'a "b", c', None, "x"}
    total = landing_total(spark, out, name)
    assert all("/state/" in f for f in total.inputFiles())
    got = {r["column"]: r for r in total.collect()}
    assert (got["k"].rows, got["cat"].null_count, got["v"].null_count, got["v"]["mean"], got["v"]["max"]) == (4, 1, 2, 5.0, 8.5)
    assert landing_state(spark, out).count() == 3


def test_empty_table(spark):
    got = profile_of_states(profile_state(spark.createDataFrame([], SCHEMA))).collect()
    assert len(got) == 8 and all(r.rows == 0 and r.cardinality == 0 and r["mean"] is None and r.q50 is None for r in got)
