"""Language ID: held-out accuracy, filters against plain sets, edges."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import language
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_grams(text):
    """n-grams of letters with a gap at both ends of each run."""
    out, words = [], "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    joined = " " + " ".join(words) + " "
    for n in language.ORDERS:
        out += [g for i in range(len(joined) - n + 1) if " " not in (g := joined[i : i + n])[1:-1]]
    return out if words else []


def test_grams_of_odd_texts():
    texts = ["", None, "a", "A b", "...", " Ünïcödé 12 été!", "日本 語", "x" * 5000, "ab1cd", "\n"]
    hashes, rows, spoken = language.grams(pa.array(texts, pa.string()))
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(plain_grams(t)) for t in texts]
    assert spoken.tolist() == [bool(plain_grams(t)) for t in texts]
    alone = [language.grams(pa.array([t], pa.string()))[0] for t in texts]
    assert sorted(hashes.tolist()) == sorted(x for a in alone for x in a.tolist())
    distinct = {g for t in texts for g in plain_grams(t)}
    assert len(set(hashes.tolist())) == len(distinct)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in rows)
    right = [x.lang_pred == docs[x.doc_id] for x in rows if x.held_out]
    assert len(right) > 200 and np.mean(right) >= 0.97


def test_filters_hold_what_the_shares_say(spark):
    rows = [("the cat the cat", "en"), ("le chat le chat", "fr"), ("der hund", "de"), (None, "xx"), ("...", "yy"), ("zz", None)]
    filters = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.languages == ["de", "en", "fr"]
    for text, lang in rows[:3]:
        hashes, _, _ = language.grams(pa.array([text]))
        assert (filters.containing(hashes)[0] >> filters.languages.index(lang) & 1).all()
    assert (filters.chance < 1e-6).all()


def test_edges(spark):
    train = spark.createDataFrame([("hello there", "en"), ("bonjour toi", "fr")], "text string, lang string")
    filters = language.train(train)
    df = spark.createDataFrame([(1, "HELLO", "fr"), (1, "HELLO", "fr"), (2, None, "fr"), (3, "12 !", "fr"), (None, "日本", "en"), (4, "bonjour " * 9000, "en")], "doc_id long, text string, lang string")
    got = {(x.doc_id, x.lang_pred, x.score) for x in language.predict(df, filters).collect()}
    assert got == {(1, "en", 1.0), (2, "und", 0.0), (3, "und", 0.0), (None, "en", 0.0), (4, "fr", 1.0)}
    assert language.predict(df.limit(0), filters).count() == 0
    empty = language.train(train.limit(0))
    assert {x.lang_pred for x in language.predict(df, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.predict(df.withColumnRenamed("lang", "Score"), filters)


def test_more_languages_than_one_word_of_bits(spark):
    rows = [(chr(0x4E00 + i) * 3 + " " + chr(0x5E00 + i) * 4, f"l{i:03d}") for i in range(130)]
    filters = language.train(spark.createDataFrame(rows, "text string, lang string"))
    found, scores = filters.decide(pa.array([t for t, _ in rows]))
    assert found == [x for _, x in rows] and filters.slots.shape[0] == 3


def test_only_different_grams_are_hashed(monkeypatch):
    hashed = []
    mixed = language.mixed
    monkeypatch.setattr(language, "mixed", lambda x: hashed.append(np.size(x)) or mixed(x))
    hashes, _, _ = language.grams(pa.array(["the cat sat on the mat " * 2000]))
    assert len(hashes) > 50_000 and sum(hashed) < 2000


def test_hits_side_by_side_are_those_counted_one_by_one():
    r = np.random.default_rng(3)
    slots = r.integers(0, 1 << 62, (2, language.SLOTS)) | r.integers(0, 1 << 62, (2, language.SLOTS))
    filters = language.Filters([f"l{i:02d}" for i in range(70)], slots, np.zeros(70), np.ones(70))
    texts = pa.array(["abc " * 3000, None, "".join(map(chr, r.integers(0x4E00, 0x9FFF, 3000))), "x", ""])
    found, _ = language.coded_grams(texts)
    for hashes, which, rows in found:
        counts = np.bincount(rows, minlength=len(texts))
        bits = filters.containing(hashes)[:, which]
        plain = [np.bincount(rows, weights=bits[k // language.WORD] >> (k % language.WORD) & 1, minlength=len(texts)) for k in range(70)]
        assert np.array_equal(filters.hits(hashes, which, counts), np.array(plain).T)
