"""Benchmark decontamination against a plain search."""

import random

import numpy as np
import pytest

from tablescope.llm import decontaminate
from tablescope.llm.fm_index import FMIndex, suffix_order


def test_suffix_order_is_the_sorted_order():
    r = random.Random(3)
    for alphabet in (1, 2, 5):
        values = [r.randint(0, alphabet) for _ in range(300)]
        assert suffix_order(np.array(values)).tolist() == sorted(range(300), key=lambda i: values[i:])


def test_index_finds_every_occurrence():
    r = random.Random(4)
    text = [r.choice([0, 1, 1, 2, 3]) for _ in range(3000)] + [0]
    index = FMIndex(np.array(text), 4)
    phrases = [tuple(r.randint(1, 3) for _ in range(r.randint(1, 6))) for _ in range(80)]
    lengths = np.array([len(p) for p in phrases])
    low, high = index.search(np.array([p + (0,) * (6 - len(p)) for p in phrases]), lengths)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text)) if tuple(text[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items, width=13):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + width]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for i in range(len(w)):
            for p, own in phrases.items():
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names |= own
        out.append((doc, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_hits_items_and_judgement(spark, block_bytes):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(8)] + ["Ünï", "x1"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(20)) for i in range(6)] + [(7, "w1 w2"), (8, ""), (9, None), (None, "x1 x1 x1 x1"), (3, say(15)), (10, items_text := say(40))]
    docs = [(i, say(60)) for i in range(25)] + [(30, items_text.upper() + " , " + items_text), (31, None), (32, ""), (33, "..."), (30, "zz " * 2000 + items_text), (None, "w1-W2")]
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes
    )
    rows = decontaminate.judged(found).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in rows]
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)
    assert all(a.stop <= b.start for x in rows for a, b in zip(x.spans, x.spans[1:]))


def test_text_without_its_hits_and_empty_inputs(spark):
    docs = spark.createDataFrame([(1, "keep alpha beta, keep"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha Beta")], "item_id long, text string")
    rows = decontaminate.find(docs, items, cleaned="clean").orderBy("doc_id").collect()
    assert [x.clean for x in rows] == ["keep , keep", ""]
    assert [tuple(s) for s in rows[0].spans] == [(1, 3)]
    assert decontaminate.judged(decontaminate.find(docs, items.limit(0))).where("n_hit > 0").count() == 0
    assert decontaminate.find(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        decontaminate.find(docs.withColumnRenamed("doc_id", "Spans"), items)


def test_cleaned_texts_with_any_number_of_blocks(spark):
    item = lambda k: " ".join(f"b{k}x{i}" for i in range(14))
    items = spark.createDataFrame([(k, item(k)) for k in range(12)], "item_id long, text string")
    texts = [f"Before, {item(k)}! {item((k + 5) % 12)} and é after {item(k)[:30]}." for k in range(12)] + [None, "", "nothing here", item(3)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, more int")
    for keep in (True, False):
        one = decontaminate.find(docs, items, cleaned="clean", keep_text=keep)
        many = decontaminate.find(docs, items, cleaned="clean", keep_text=keep, block_bytes=400)
        assert one.columns == many.columns
        got = [{r.doc_id: r for r in x.collect()} for x in (one, many)]
        assert got[0] == got[1] and len(got[0]) == 16
    assert got[0][0].clean == f"Before,  and é after {item(0)[:30]}." and got[0][15].clean == "" and got[0][12].clean == ""
