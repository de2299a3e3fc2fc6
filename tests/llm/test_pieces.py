"""Encoding and decoding agree with the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tablescope.llm import pieces
from tablescope.llm.catalog import QUERIES, piece_model
from tablescope.llm.words import slices

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_texts_of_every_kind(library):
    r = random.Random(5)
    letters = "abc the ing  ▁ \n\t0é漢字日本語<0x41>\x00\U0001f600ñ벨"
    texts = ["", None, " ", "a" * 50, " " * 77, "<s></s><unk><0x0A>", "bananananana", "x" * 30_000, "日本" * 3000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    vocab = pieces.vocabulary(piece_model())
    ids, cuts = pieces.Encoder(vocab).encode(pa.array(texts, pa.string()))
    want = library.encode([x or "" for x in texts])
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want
    assert vocab.decode_parts(ids, cuts) == library.decode(want)


def test_any_ids_decode_alike(library):
    r = random.Random(6)
    rows = [[r.choice([r.randint(0, 300), r.randint(0, 31999)]) for _ in range(r.randint(0, 20))] for _ in range(1500)]
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    ids = np.array([y for x in rows for y in x])
    assert pieces.vocabulary(piece_model()).decode_parts(ids, cuts) == library.decode(rows)


def test_query_agrees_with_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op5_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_columns_encode_and_decode(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "word " * 400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    back = pieces.decode(pieces.encode(df, piece_model()), piece_model())
    got = back.collect()
    assert len(got) == 5 and back.columns == ["doc_id", "text", "note", "ids", "decoded"]
    for row in got:
        assert row.ids == library.encode(row.text or "") and row.decoded == (row.text or "")
    assert pieces.round_trip(df.limit(0), piece_model()).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(df.withColumn("IDS", df.doc_id), piece_model())


def test_memory_of_a_task_is_bounded():
    import tracemalloc

    texts = pa.array([" ".join(f"{7919 * (400 * k + i) % 1_000_003:x}" for i in range(400)) for k in range(1000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    encoder = pieces.Encoder(pieces.vocabulary(piece_model()))
    tracemalloc.start()
    for part in slices(batch, "text", pieces.SLICE_BYTES):
        encoder.encode(part.column("text"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.nbytes > 2_000_000 and most < 150 << 20
