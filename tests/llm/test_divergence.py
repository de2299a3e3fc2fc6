"""Source divergence against plain counting over all terms, and the vocabulary against CountVectorizer."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from tablescope.llm import divergence
from tablescope.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def spoken(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, min_df=10, ranks=10):
    """Rows for (lang, source, text) documents, dense over the whole vocabulary."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        words = spoken(text)
        groups[lang or ""].add(source or "")
        seen[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    rows = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= min_df]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 2) // (sum(n[s].values()) + 2 * len(kept)) for t, c in n[s].items()} for s in n}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], p[None][t])) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                rows += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query(spark):
    docs = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_source_divergence"](spark, FOLDER)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert rows_of(got) == plain(docs)


@pytest.mark.parametrize("min_df", [1, 3])
def test_odd_groups(spark, min_df):
    r = random.Random(min_df)
    words = ["Ab", "ab", "é", "Éa", "x1y", "zß", "🙂", "e"]
    docs = [(r.choice(["en", "", None]), r.choice(["a", "b", "ä", None, "c"]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(80)]
    docs += [("de", "a", None), ("de", "b", "12 34"), ("fr", "a", "mot"), ("fr", "a", "mot"), ("it", None, None)] + [("en", "hot", "ab ab " * 400)] * 60
    df = spark.createDataFrame([(*d, 1) for d in docs], "lang string, source string, text string, term int")
    assert rows_of(divergence.divergence(df, min_df=min_df)) == plain(docs, min_df)


def test_empty_table_and_no_terms(spark):
    df = spark.createDataFrame([("en", "a", None), ("en", "b", ""), ("en", "c", "7")], "lang string, source string, text string")
    assert divergence.divergence(df.limit(0)).count() == 0
    assert rows_of(divergence.divergence(df)) == plain([("en", "a", None), ("en", "b", ""), ("en", "c", "7")])


def test_vocabulary_is_that_of_count_vectorizer(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    found = defaultdict(set)
    sums = divergence.group_sums(docs)
    for r in divergence.vocabulary(sums).collect():
        found[r.lang].add(r.term)
    counts = {(r.source, r.term): r.n for r in sums.where("lang = 'de' AND term IS NOT NULL").collect()}
    for lang in found:
        own = docs.where(F.col("lang") == lang).withColumn("words", words)
        model = CountVectorizer(inputCol="words", outputCol="vector", minDF=10, vocabSize=2**31 - 1).fit(own)
        assert set(model.vocabulary) == found[lang]
        if lang == "de":
            vectors = model.transform(own).select("source", F.unwrap_udt("vector").alias("v"))
            entries = vectors.select("source", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
            for r in entries.groupBy("source", "e.indices").agg(F.sum("e.values").alias("n")).collect():
                assert counts[r.source, model.vocabulary[r.indices]] == r.n


def test_shares_of_very_large_counts(spark):
    one = spark.createDataFrame([(4 * 10**18, 8 * 10**18, 10**6)], "n long, whole long, terms long")
    got = one.select(divergence.share("n", "whole", "terms").alias("p")).first().p
    assert got == 1 + 10**9 * (4 * 10**18 + 2) // (8 * 10**18 + 2 * 10**6)
