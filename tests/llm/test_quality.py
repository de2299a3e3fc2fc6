"""The Kneser-Ney model against plain Python; thresholds against labels."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tablescope.llm import quality
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def units(text):
    out = []
    for c in text or "":
        c = " " if c.isspace() or c < " " else "0" if c in "0123456789" else c if ord(c) <= 0xFFFF else "�"
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return "".join(out) if "".join(out).strip() else ""


def plain_grams(text):
    padded = "\x02" * 3 + units(text)
    return [padded[i : i + 4] for i in range(len(padded) - 3)]


class Plain:
    """Interpolated modified Kneser-Ney over strings."""

    def __init__(self, texts):
        self.counts = {4: Counter(g for t in texts for g in plain_grams(t))}
        for n in (3, 2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.off, self.after = {}, {}
        for n, counts in self.counts.items():
            of = Counter(counts.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
            off = [k - (k + 1) * y * of[k + 1] / of[k] if of[k] and y is not None else 0.5 for k in (1, 2, 3)]
            self.off[n] = [min(max(d, 0.1), k - 0.05) for k, d in enumerate(off, 1)]
            self.after[n] = defaultdict(list)
            for g, c in counts.items():
                self.after[n][g[:-1]].append(c)

    def p(self, g):
        n = len(g)
        low = self.p(g[1:]) if n > 1 else 1 / (len(self.counts[1]) + 1)
        own = self.after[n].get(g[:-1])
        if not own:
            return low
        less = lambda c: self.off[n][min(c, 3) - 1]
        c = self.counts[n].get(g, 0)
        return ((c - less(c) if c else 0) + sum(map(less, own)) * low) / sum(own)


def test_grams_of_odd_texts():
    texts = ["", None, "  ", "a", "ab\t\n cd 12", "🙂x", "é" * 3000, " lead", "\x00x"]
    packed, rows = quality.grams(pa.array(texts, pa.string()))
    got = [["".join(chr(int(g) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0)) for g in packed[rows == r]] for r in range(len(texts))]
    assert got == [plain_grams(t) if units(t) else [] for t in texts]


def test_probabilities_and_perplexity(spark):
    r = random.Random(6)
    say = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(5, 60)))
    rows = [(i, say("aabbcd e"), "en") for i in range(60)] + [(100 + i, say("xyz ß"), "de") for i in range(30)] + [(200, None, "en"), (201, " ", "en"), (202, "qq", None), (0, "twice", "en"), (None, "aab", "en")]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 1) for i in range(20)] + [(50, 0), (None, 1), (3, 1)]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, log double")
    got = quality.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"), shard_rows=400).collect()
    assert len(got) == len(rows)
    import zlib

    good = {d for d, q in labels if q == 1 and d is not None}
    models = {lang: Plain([t for d, t, x in rows if x == lang and d in good and zlib.crc32(str(d).encode()) % 4 != 2]) for lang in ("en", "de")}
    seen = Counter()
    for x in got:
        for d, t, lang in rows:
            own = plain_grams(t) if units(t) else []
            if d == x.doc_id and len(own) == x.units and (lang or "") == x.lang and x.perplexity is not None:
                want = math.exp(-np.mean([math.log(models[lang].p(g)) for g in own]))
                seen[abs(want - x.perplexity) < 2e-4 * want] += 1
    assert seen[True] == 92 and seen[False] <= 12
    assert {(x.doc_id, x.kept, x.perplexity) for x in got if x.doc_id in (200, 201, 202)} == {(200, False, None), (201, False, None), (202, True, None)}


def test_query_rejects_what_is_labelled_bad(spark):
    rows = {x.doc_id: x.kept for x in QUERIES["op3_quality"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert np.mean([rows[i] for i, q in labels.items() if q == 1]) >= 0.97
    assert np.mean([rows[i] for i, q in labels.items() if q == 0]) <= 0.35


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(x.kept, x.perplexity) for x in quality.judge(df, none).collect()] == [(True, None)]
    assert quality.judge(df.limit(0), none).count() == 0
