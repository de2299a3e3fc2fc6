"""Surviving values against a search of every value in every text."""

import random

import numpy as np

from tablescope.operators import leaks


def plain(texts, values, least):
    return sorted({(k, v) for k, t in texts if t is not None for v in values if v is not None and len(v) >= least and v in t})


def check(spark, texts, values, least=4):
    a = spark.createDataFrame(texts, "id long, body string")
    b = spark.createDataFrame([(v,) for v in values], "name string")
    got = leaks.text_leaks(a, "id", "body", b, "name", least)
    assert got.columns == ["id", "value"]
    assert sorted(tuple(r) for r in got.collect()) == plain(texts, values, least)


def test_rolling_hashes_follow_content_only():
    data = np.frombuffer(b"abcabcabcab", np.uint8)
    rolling = leaks.Rolling(data)
    assert len(set(rolling.windows(np.array([0, 3, 6]), 5).tolist())) == 1
    assert len(set(rolling.windows(np.array([0, 1, 2]), 5).tolist())) == 3
    assert rolling.windows(np.array([0]), np.array([4]))[0] == leaks.Rolling(data[6:]).windows(np.array([0]), 4)[0]


def test_random_texts(spark):
    r = random.Random(1)
    letters = "abä🙂 "
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [(k, word(r.choice([0, 3, 40, 400]))) for k in range(60)] + [(99, None), (100, "")]
    values = [word(r.randint(1, 9)) for _ in range(150)] + [None, "", "ab", "ab"]
    values += [t[5 : 5 + n] for _, t in texts if t and len(t) > 300 for n in (30, 64, 65, 200)]
    values += [t[5:205] + "x" for _, t in texts[:5] if t]
    check(spark, texts, values, 1)
    check(spark, texts, values, 4)


def test_hot_value_and_none(spark):
    texts = [(k, f"name Customer#{k:09d} of BUILDING " * 3) for k in range(300)]
    check(spark, texts, [f"Customer#{k:09d}" for k in range(0, 600, 2)] + ["BUILDING", "HOUSEHOLD"])
    check(spark, texts, [None, "abc"])
    check(spark, [(1, "x" * 3_000_000 + "needle")], ["needle", "x" * 500, "x" * 3_000_001])


def test_a_filter_that_passes_everything(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    check(spark, [(1, "to be or not to be"), (2, "be not"), (3, "none")], ["not to", "be not", "none", "or not", "nope"])
