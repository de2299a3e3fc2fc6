"""Rule statistics against plain counting, and the forest's verdicts against labels."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tablescope.llm import rules
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), len(lines) - len(set(lines)), len(hit)


def test_counts_of_odd_texts():
    r = random.Random(8)
    texts = ["", None, " \n\n ", "a\n a\na\na ", "x " * 30, "é ü #| \x00\n\x0b", "🙂🙂\n🙂🙂\n" * 9, "a b c d e f g h " * 3, "w" * 40_000]
    texts += ["".join(r.choice("ab \n\té#") for _ in range(r.randint(0, 120))) for _ in range(400)]
    got = rules.counts_of(pa.array(texts, pa.string()))
    assert list(zip(*(x.tolist() for x in got[:5]))) == [plain(t) for t in texts]


def test_query_counts_whole_texts_and_judges_labelled_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op4_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for x in rows:
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat = plain(docs[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)
        assert x.base_failed == (n_words < 20 or 100 * n_repeat > 30 * n_words)
        assert not (x.base_failed and x.kept)
    kept = {x.doc_id: x.kept for x in rows if not x.base_failed}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    bad = [kept[i] for i, q in labels.items() if q == 0 and i in kept]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.3


def test_edges(spark):
    df = spark.createDataFrame([(1, "a " * 40 + "b", "x"), (1, None, "x"), (None, " ".join(map(str, range(40))), "y")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = rules.judge(df, none).collect()
    assert sorted((x.doc_id or 0, x.kept) for x in rows) == [(0, True), (1, False), (1, False)]
    one_kind = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (9, None)], "doc_id long, quality int")
    assert rules.judge(df, one_kind).where("kept").count() == 1
    assert rules.judge(df.limit(0), one_kind).count() == 0


def test_threshold():
    assert rules.cut_of([(0.9, 0, 5), (0.8, 1, 0), (0.7, 0, 5), (0.2, 99, 0)], 0.01) < 0.7
    assert rules.cut_of([(0.9, 0, 5), (0.8, 2, 9), (0.2, 98, 0)], 0.01) > 0.8
    assert rules.cut_of([(0.9, 0, 5)], 0.01) == 1.0
