"""Periodic runs against a search over all periods, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import runs
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of every period, unless a smaller one has it."""
    found, n = [], len(words)
    for period in range(1, n // times + 1):
        i = 0
        while i + period < n:
            if words[i] != words[i + period]:
                i += 1
                continue
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j + period - i
            if length >= max(least, times * period) and not any(
                all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, period)
            ):
                found.append((i, length, period))
            i = j
    return sorted(found, key=lambda x: (x[0], x[2]))


def texts_of(r, n):
    for _ in range(n):
        words = []
        for _ in range(r.randint(1, 4)):
            piece = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 14))]
            words += (piece * r.randint(1, 12))[: r.randint(1, 90)]
            if r.random() < 0.4:
                words[r.randrange(len(words))] = r.choice("abcd")
        yield words


def test_runs_of_random_sequences():
    r = random.Random(4)
    seen = 0
    for words in texts_of(r, 900):
        want = plain_runs(words)
        seen += len(want)
        assert runs.runs_of([ord(w) for w in words]) == want
    assert seen > 500


def test_every_repetition_of_two_periods():
    r = random.Random(5)
    for _ in range(300):
        words = [r.randrange(2) for _ in range(r.randint(1, 40))]
        assert sorted(runs.runs_of(words, least=1, times=2)) == sorted(plain_runs(words, least=1, times=2))


def test_stretches_hold_all_runs():
    r = random.Random(6)
    many = list(texts_of(r, 400))
    texts = pa.array([" ".join(w) for w in many])
    count, found, collapsed = runs._slice(texts, 24, 3)
    for words, n, own, text in zip(many, count.to_pylist(), found.to_pylist(), collapsed.to_pylist()):
        want = plain_runs(words)
        assert n == len(words) and [(x["start"], x["length"], x["period"]) for x in own] == want
        gone = {k for s, length, p in want for k in range(s + p, s + length)}
        assert text == " ".join(w for k, w in enumerate(words) if k not in gone)


def test_one_word_and_one_period_many_times():
    assert runs.runs_of([7] * 50_000) == [(0, 50_000, 1)]
    assert runs.runs_of(list(range(5000)) * 6) == [(0, 30_000, 5000)]
    assert runs.runs_of(list(range(30_000))) == []


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    rank = {w: k for k, w in enumerate(dict.fromkeys(words))}
    numbers = np.array([rank[w] for w in words])
    found = []
    for period in range(1, n // 3 + 1):
        same = np.concatenate([[0], (numbers[period:] == numbers[:-period]).astype(np.int8), [0]])
        change = np.flatnonzero(np.diff(same))
        for i, j in zip(change[::2].tolist(), change[1::2].tolist()):
            if j - i + period >= max(24, 3 * period) and not any(s <= i and i + (j - i + period) <= s + m and period % q == 0 for s, m, q in found):
                found.append((i, j - i + period, period))
    found.sort(key=lambda x: (x[0], x[2]))
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op11_periodic_runs"](spark, FOLDER)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r)[:8] for r in got.collect()) == sorted(plain_row(*d) for d in docs)
    assert got.where("n_runs > 0").count() >= 10


def test_edges(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t\n", None), (2, "a b " * 24, "x"), (2, "a b " * 24, "x"), (3, "w" * 500_000, "y"), (4, "a b " * 11, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = runs.find(df).collect()
    assert [(r.doc_id, r.start, r.n_words, len(r.runs)) for r in got] == [(1, "x", 0, 0), (1, "x", 0, 0), (None, None, 0, 0), (2, "x", 24, 1), (2, "x", 24, 1), (3, "y", 1, 0), (4, "z", 22, 0)]
    assert [r.collapsed for r in got] == ["", "", "", "a b", "a b", "w" * 500_000, ("a b " * 11).strip()]
    assert runs.find(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        runs.find(df.withColumnRenamed("start", "Runs"))
