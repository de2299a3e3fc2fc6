"""Source divergence audit: how differently the sources of a language use its words.

Every text becomes an exact sparse vector of term counts. The vocabulary of a language is fitted as CountVectorizer does it,
with a least document frequency and no limit on its size; vectors are summed by (language, source), so each task hands on one
partial sum by group and term instead of its documents. Vocabulary and sums stay tables: neither passes the driver, and no task
needs a whole vocabulary. For each group p is the share of a term, in whole billionths with a constant count of two added, and
two groups are compared by the sum of (p - q)^2 / (p + q) over all terms, all in whole numbers.

The sum is evaluated sparsely. Were the other group without the term, its p would be the same for all such terms; so each
group's histogram of counts gives that part, and only terms that both groups have are looked at one by one, to put the true
value in place of the two assumed ones.

Null texts, languages and sources count as empty ones. Texts without terms and languages without vocabulary keep their groups,
with values of 0. Repeated rows count as often as they are there, ties are ordered by item. Empty tables give empty tables.
Other columns of `df` are not read. Hot groups are dealt out by term before they are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.words import LETTERED, coded, slices, split
from tablescope.plans.scratch import write_scratch

#: Documents of a language that hold a term of its vocabulary, at least.
MIN_DF = 10
#: Whole of the shares, and what is added to each count.
WHOLE, ADDED = 1_000_000_000, 2
#: Ranks of the terms that are reported for a group.
TERMS = 10
#: Parts that a group's terms are dealt out to.
PARTS = 32

#: Bytes inside a term: letters and every byte of a character beyond ASCII.
LETTERS = LETTERED.copy()
LETTERS[0x30:0x3A] = False


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sparse count vectors of the texts: row, column and count of each entry, and the term of each column."""
    words = split(texts, LETTERS, lower=True)
    codes, terms = coded(words.array)
    keys, counts = np.unique(words.rows() * max(len(terms), 1) + codes, return_counts=True)
    return keys // max(len(terms), 1), keys % max(len(terms), 1), counts, terms


def group_sums(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): sums of the count vectors by group, and documents with the term; a null term for each group."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
                row, column, count, terms = vectors(part.column("text"))
                keys = group[row] * max(len(terms), 1) + column
                order = np.argsort(keys, kind="stable")
                own, first = np.unique(keys[order], return_index=True)
                n = np.add.reduceat(count[order], first) if len(first) else first
                docs = np.diff(np.append(first, len(keys)))
                groups = np.unique(group)
                every = np.concatenate([own // max(len(terms), 1), groups])
                column = np.concatenate([own % max(len(terms), 1), np.zeros(len(groups), np.int64)])
                absent = np.concatenate([np.zeros(len(own), dtype=bool), np.ones(len(groups), dtype=bool)])
                none = np.zeros(len(groups), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(every // len(sources.dictionary))),
                        sources.dictionary.take(pa.array(every % len(sources.dictionary))),
                        terms.take(pa.array(column, pa.int64(), mask=absent)).cast(pa.string()),
                        pa.array(np.concatenate([n, none]), pa.int64()),
                        pa.array(np.concatenate([docs, none]), pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    empty = F.lit("")
    given = df.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).alias("text"))
    counted = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """(lang, term, total): the terms in at least `min_df` documents of their language, and how often they occur there."""
    terms = sums.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    return terms.where(F.col("docs") >= min_df).select("lang", "term", "total")


def share(n: str, whole: str, terms: str) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (whole + ADDED * terms)), exact for any count; 1 without terms."""
    exact = f"cast({n} + {ADDED} as decimal(20,0)) * {WHOLE}BD div cast({whole} + {ADDED} * {terms} as decimal(20,0))"
    return F.expr(f"CASE WHEN {terms} = 0 THEN 1L ELSE 1L + {exact} END")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)), within a long as both are at most WHOLE + 1."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_df: int = MIN_DF, ranks: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of language and source.

    Part `pair`: each other source of the language and the divergence from it, all ranks. Part `term`: the terms of which the
    group has more than its language and by how much they diverge, up to `ranks`.
    """
    sums = write_scratch(group_sums(df, lang, source, text), "sums")
    words = vocabulary(sums, min_df)
    kept = write_scratch(sums.where("term IS NOT NULL").drop("docs").join(words, ["lang", "term"]), "kept")
    langs = words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("spoken"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.count("*").alias("present"))
    groups = sums.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["whole", "present", "terms", "spoken"])
    groups = write_scratch(groups.withColumn("absent", share("0", "whole", "terms")), "groups")

    # A group's facts go to each of its parts, so that no task gets the group whole.
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    facts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    priced = kept.withColumn("part", part).join(facts, ["lang", "source", "part"])
    priced = write_scratch(priced.withColumn("p", share("n", "whole", "terms")).withColumn("q", share("total", "spoken", "terms")).select("lang", "source", "part", "term", "p", "q", "absent"), "priced")

    order = [F.desc("value"), F.asc("item")]
    above = priced.where("p > q").select("lang", "source", "part", F.col("term").alias("item"), apart("p", "q").alias("value"))
    some = above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("rank") <= ranks)
    terms = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= ranks)

    a = groups.select("lang", F.col("source").alias("a"), F.col("absent").alias("absent_a"), F.col("present").alias("present_a"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("absent").alias("absent_b"), F.col("present").alias("present_b"))
    pairs = a.join(b, "lang").where("a <> b")
    # Every term of one group as if the other one had none of them.
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).withColumnRenamed("source", "a")
    one = histogram.join(pairs, ["lang", "a"]).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * apart("p", "absent_b")).alias("value"))
    # The terms of neither, were there none of both.
    neither = pairs.where("a < b").select("lang", "a", "b", ((F.col("terms") - F.col("present_a") - F.col("present_b")) * apart("absent_a", "absent_b")).alias("value"))
    # Terms of both: the true value for the assumed ones.
    x = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("absent").alias("absent_a"))
    y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("absent").alias("absent_b"))
    both = x.join(y, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", (apart("p_a", "p_b") - apart("p_a", "absent_b") - apart("absent_a", "p_b") + apart("absent_a", "absent_b")).alias("value")
    )
    partial = lambda rows: rows.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    total = partial(partial(one).unionAll(neither).unionAll(partial(both)))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    each = total.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(columns).unionAll(terms.withColumn("part", F.lit("term")).select(columns))
