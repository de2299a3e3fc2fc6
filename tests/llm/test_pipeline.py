"""The corpus pipeline against plain Python, stage by stage."""

import re

import pytest
import sentencepiece
from test_jaccard import shingles

import corpus_pipeline
from tablescope.llm import secrets
from tablescope.llm.catalog import piece_model

FOLDER = "/root/testdata/sf0.001"


def plain_copies(rows, width=5, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {min(d for (d, _), x in zip(rows, label) if x == own) for own in set(label)}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def spoken_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_and_drop_the_right_rows(spark, stages):
    given, spoken, single, clean, safe, final = stages
    assert all(s.columns == given.columns for s in stages[:5])
    docs = texts(given)
    assert {i for i, t in docs.items() if re.search(r"[^\W\d_]{3}", t)} == set(texts(spoken))
    assert texts(single).keys() == plain_copies(sorted(texts(spoken).items()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    phrases = {" ".join(w[i : i + 13]) for w in (spoken_words(t) for _, t in items) for i in range(max(1, len(w) - 12))}
    kept = texts(clean)
    for doc, text in texts(single).items():
        w = spoken_words(text)
        hit = {k for i in range(len(w) - 12) if " ".join(w[i : i + 13]) in phrases for k in range(i, i + 13)}
        assert (doc in kept) == (not hit or 20 * len(hit) < len(w))
    shown = {i: re.sub(r"(?i)(token = \")[0-9a-f]{40}", r"\1" + secrets.REDACTED, t) for i, t in kept.items()}
    assert texts(safe) == shown and {r.doc_id: r.n_chars for r in safe.collect()} == {i: len(t) for i, t in shown.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rows = final.collect()
    assert {r.doc_id for r in rows} == set(shown)
    assert all(r.ids == library.encode(shown[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_repeated_rows_nulls_and_further_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", 5), (1, words, "en", 5), (1, "other " + " ".join(f"v{i}" for i in range(60)), None, 5), (None, words, "en", 5), (2, None, None, None), (3, "", "fr", 0), (3, "", "fr", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_shingles int")
    got = corpus_pipeline.copies(spark, df, FOLDER).collect()
    assert sum(r.text == words for r in got) == 1 and sum((r.text or "").startswith("other") for r in got) == 1
    assert sum(r.text is None for r in got) == 1 and sum(r.text == "" for r in got) == 2
    for stage in (corpus_pipeline.languages, corpus_pipeline.benchmarks, corpus_pipeline.leaks, corpus_pipeline.encoded):
        assert stage(spark, df.limit(0), FOLDER).count() == 0
        assert stage(spark, df, FOLDER).count() <= len(rows)


def test_columns_of_any_name_are_kept(spark):
    words = " ".join(f"w{i}" for i in range(60))
    names = ["n_hit", "n_words", "items", "spans", "contaminated", "n_tokens", "ids", "_key", "_found", "_between", "_verdicts", "_row", "_language", "n_secrets", "aside_0", "score"]
    rows = [(k, f'token = "{k}f3a9c27d8e1b4f6a7c5d2e9b8a1f4c6d3e7b2a9" {words} {k}', "en", k, *[f"{n}{k}" for n in names]) for k in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "n_chars", *names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, df, FOLDER)
        assert got.columns == df.columns
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    last = corpus_pipeline.encoded(spark, df, FOLDER)
    assert last.columns == [f"given_{c}" if c in ("ids", "n_tokens") else c for c in df.columns] + ["ids", "n_tokens"]
    assert all(r.given_ids == f"ids{r.doc_id}" and len(r.ids) == r.n_tokens for r in last.collect())
