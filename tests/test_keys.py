"""Minimal keys against counting every group of columns."""

import random
from itertools import combinations

import pytest

from tablescope.operators import keys
from tablescope.operators.keys import unique_keys


def plain(names, rows, width):
    keys = []
    for size in range(1, width + 1):
        for group in combinations(range(len(names)), size):
            if not any(set(k) <= set(group) for k in keys) and len({tuple(r[i] for i in group) for r in rows}) == len(rows):
                keys.append(group)
    return sorted(tuple(names[i] for i in k) for k in keys)


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 900), (3, 1)])
def test_keys_of_random_tables(spark, seed, n):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    rows = [(k // 7, r.randrange(12), r.choice(["x" * 200, "y", None, "z"]), k % 7, r.choice([None, float(k)])) for k in range(n)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int, e double")
    got = unique_keys(df, 4)
    assert sorted(tuple(k.columns) for k in got.collect()) == plain(names, rows, 4)
    assert all(k.size == len(k.columns) for k in got.collect())


def test_no_key_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    assert unique_keys(df).count() == 0
    assert sorted(k.columns[0] for k in unique_keys(df.limit(0)).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="not in table"):
        unique_keys(df, columns=["zz"])


def test_only_columns_are_estimated_and_many_tasks_compare(spark, monkeypatch):
    r = random.Random(5)
    names = ["a", "b", "c", "d"]
    # Half of the rows agree in a, b and c; every row differs from the others in b and d, or in c and d.
    rows = [(r.randrange(3000), k // 2, k % 1000, k % 2 * 1000 + k // 1000) if k % 2 else (7, 7, 7, k) for k in range(4000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").repartition(3)
    estimated, estimates = [], keys._estimates
    monkeypatch.setattr(keys, "_estimates", lambda df, groups: estimated.extend(groups) or estimates(df, groups))
    monkeypatch.setattr(keys, "VARIED", 100)
    monkeypatch.setattr(keys, "ROWS_PER_TASK", 500)
    assert sorted(tuple(k.columns) for k in unique_keys(df).collect()) == plain(names, rows, 3)
    assert all(len(g) == 1 for g in estimated)


def test_whole_checks_compare_few_rows_in_full(spark, monkeypatch):
    # Only k and g, k and h and k and g and h agree nowhere; 3 pairs of rows agree in g and h, and 500 rows in h.
    rows = [(k, k % 3000, 0 if k < 500 else k // 2 if k < 5994 else 2993) for k in range(6000)]
    rows[10:13] = [(10 + i, *rows[3000 + i][1:]) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, g int, h int").repartition(5)
    monkeypatch.setattr(keys, "ROWS_PER_TASK", 700)
    groups = [("k", "g"), ("g", "h"), ("k", "h")]
    known = keys._suspects(df, groups, 6000)
    assert 3 <= known.sum() <= 10
    assert keys._repeating(df, groups, None, 6000) == {("g", "h")}
    assert keys._repeating(df, [("k",), ("h",)], None, 6000) == {("h",)} and keys._repeating(df, [], None, 6000) == set()


def test_few_groups_are_on_disk_at_once(spark, monkeypatch):
    names = ["a", "b", "c", "d"]
    rows = [(k, 3 * k, -k, k % 5) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    jobs = []
    monkeypatch.setattr(keys, "LARGE", 1)
    monkeypatch.setattr(keys, "release", lambda spark: jobs.append("done"))
    tagged, hashes = [], keys._hashes
    monkeypatch.setattr(keys, "_hashes", lambda df, names, seconds=True: (seconds or tagged.append(len(names))) and None or hashes(df, names, seconds))
    assert sorted(tuple(k.columns) for k in unique_keys(df, 2).collect()) == plain(names, rows, 2)
    # Three keys of one column are tagged two at a time, and every job is given back.
    assert tagged == [2, 1] and len(jobs) >= 3
