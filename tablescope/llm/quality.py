"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text, cut off per language.

Units are characters: runs of white space are one space, ASCII digits are one digit, characters beyond 16 bits are one
character. Each task counts the n-grams of ORDER characters of its slices once, with how often trusted training texts have them;
an aggregate gives the corpus counts per language. Lower orders count distinct left neighbours. Discounts follow from the counts of
counts of each order and language. Every n-gram that occurs in any document gets its probability by joins with the count tables of
all orders, each sharded by its key. The probabilities go back to the texts in shards of bounded size, and a text's perplexity is
the exponential of its mean negative log-probability; before it meets a threshold, some units of the language's mean are added to
the text, since the perplexity of a few characters says little.

Trusted are documents with quality 1 in the labels. A quarter of them (by the id's checksum) trains nothing: the quantile of
its perplexities is the language's threshold. Without a held-out trusted text all trusted ones of the language count; without any, or
without a model of the language, nothing is rejected. Null language is a language of its own. Null or blank texts have no
perplexity and are not kept. Repeated rows are judged alike, each; empty tables stay empty; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.language import held_out
from tablescope.llm.words import slices
from tablescope.plans.scratch import write_scratch

ORDER = 4
#: Share of held-out trusted texts that a language's threshold keeps.
QUANTILE = 0.99
#: Probabilities that a task gets at once, and ids that are broadcast at most.
SHARD_ROWS, BROADCAST_IDS = 2_000_000, 5_000_000
PART_BYTES = 2 << 20
#: So many units of the language's usual probability are added to a text before its perplexity meets the threshold.
USUAL_UNITS = 100
BEGIN, SPACE, DIGIT, OTHER = 0x02, 0x20, 0x30, 0xFFFD


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """The unit of each code point."""
    table = np.minimum(np.arange(0x110000), 0xFFFF).astype(np.uint16)
    table[0x10000:] = OTHER
    table[0x30:0x3A] = DIGIT
    table[[c for c in range(0x10000) if chr(c).isspace() or c < 0x20]] = SPACE
    return table


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of ORDER units, packed, with the row of each; one for every unit of a text that is not blank."""
    parts = [x or "" for x in texts.to_pylist()]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    units = alphabet()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    rows = np.repeat(np.arange(len(parts)), sizes)
    blank = units == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1] & (rows[1:] == rows[:-1])
    units, rows = units[keep], rows[keep]
    spoken = np.bincount(rows[units != SPACE], minlength=len(parts)) > 0
    units, rows = units[spoken[rows]], rows[spoken[rows]]
    counts = np.bincount(rows, minlength=len(parts))
    pad = ORDER - 1
    code = np.full(int((counts + pad * (counts > 0)).sum()), BEGIN, np.uint64)
    at = np.arange(len(units)) + pad * np.cumsum(counts > 0)[rows]
    code[at] = units
    packed = np.zeros(len(units), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | code[at - pad + k]
    return packed, rows


def counted(df: DataFrame) -> DataFrame:
    """(lang, gram, n) of every n-gram of `df` (text, lang, trains): n is how often training texts have it."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found, rows = grams(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                lang = coded.indices.to_numpy(zero_copy_only=False)[rows]
                trains = part.column("trains").to_numpy(zero_copy_only=False)[rows]
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    here = lang == k
                    every = np.unique(found[here])
                    trained, n = np.unique(found[here & trains], return_counts=True)
                    total = np.zeros(len(every), np.int64)
                    total[np.searchsorted(every, trained)] = n
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(every), pa.string()), pa.array(every.view(np.int64)), pa.array(total)], names=["lang", "gram", "n"])

    return df.select("text", "lang", "trains").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def tail(order: int):
    """The last `order` units of an n-gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < 4 else F.col("gram")


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, p) of every n-gram of `counts` (lang, gram, n); n of 0 asks for a probability only."""
    seen = {ORDER: counts.where("n > 0")}
    asked = {ORDER: counts.select("lang", "gram")}
    for order in range(ORDER - 1, 0, -1):
        # A shorter n-gram counts as often as it has different left neighbours.
        seen[order] = write_scratch(seen[order + 1].select("lang", tail(order).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "counts")
        asked[order] = asked[order + 1].select("lang", tail(order).alias("gram")).distinct()
    size = seen[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("low"))
    below = asked[1].join(F.broadcast(size), "lang").select("lang", F.lit(0).cast("long").alias("lower"), "low").distinct()
    for order in range(1, ORDER + 1):
        n = [F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)]
        y = F.try_divide(n[0], n[0] + 2 * n[1])
        one = [F.coalesce(k - (k + 1) * y * F.try_divide(n[k], n[k - 1]), F.lit(0.5)) for k in (1, 2, 3)]
        off = seen[order].groupBy("lang").agg(*[F.least(F.greatest(d, F.lit(0.1)), F.lit(k - 0.05)).alias(f"d{k}") for k, d in enumerate(one, 1)])
        given = seen[order].join(F.broadcast(off), "lang").withColumn("off", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        given = given.select("lang", "gram", F.expr("shiftrightunsigned(gram, 16)").alias("before"), "n", "off")
        totals = given.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.sum("off").alias("spread"))
        wanted = asked[order].select("lang", "gram", F.expr("shiftrightunsigned(gram, 16)").alias("before"), (tail(order - 1) if order > 1 else F.lit(0).cast("long")).alias("lower"))
        joined = wanted.join(below, ["lang", "lower"]).join(totals, ["lang", "before"], "left").join(given.select("lang", "gram", "n", "off"), ["lang", "gram"], "left")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.coalesce(F.col("n") - F.col("off"), F.lit(0.0)) + F.col("spread") * F.col("low")) / F.col("total"))
        found = write_scratch(joined.select("lang", "gram", p.alias("p")), "probabilities")
        below = found.select("lang", F.col("gram").alias("lower"), F.col("p").alias("low"))
    return found


def _shards(found: DataFrame, limit: int) -> Iterator[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The probabilities in parts of about `limit` rows: by language, sorted n-grams and their logarithms."""
    count = -(-found.count() // limit)
    if not count:
        yield {}
    for k in range(count):
        rows = found.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(count)) == k).toArrow()
        gram, log = rows.column("gram").to_numpy().view(np.uint64), np.log(rows.column("p").to_numpy())
        lang = pa.concat_arrays(rows.column("lang").chunks).dictionary_encode()
        out = {}
        for at, name in enumerate(lang.dictionary.to_pylist()):
            own = np.flatnonzero(lang.indices.to_numpy(zero_copy_only=False) == at)
            own = own[np.argsort(gram[own])]
            out[name] = gram[own], log[own]
        yield out


def _added(df: DataFrame, shared) -> DataFrame:
    """`df` (doc, text, lang, trusted, size, units, log) with the log-probabilities of one shard added up."""
    names = df.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                found, rows = grams(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                lang = coded.indices.to_numpy(zero_copy_only=False)[rows]
                total, units = part.column("log").to_numpy(zero_copy_only=False).copy(), np.zeros(part.num_rows)
                for k, name in enumerate(coded.dictionary.to_pylist()):
                    if name not in shared.value:
                        continue
                    keys, logs = shared.value[name]
                    here = lang == k
                    distinct, which = np.unique(found[here], return_inverse=True)
                    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                    hit = keys[at] == distinct
                    total += np.bincount(rows[here], weights=np.where(hit, logs[at], 0.0)[which], minlength=part.num_rows)
                    units += np.bincount(rows[here], weights=hit[which], minlength=part.num_rows)
                size = np.bincount(rows, minlength=part.num_rows)
                new = {"size": pa.array(size), "log": pa.array(total), "units": pa.array(part.column("units").to_numpy(zero_copy_only=False) + units.astype(np.int64))}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names=names)

    return df.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in df.dtypes))


def judge(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, units, perplexity (null without text or model), the same with usual units added, threshold and kept. Labels: doc_id, quality."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_doc")).distinct()
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    docs = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    docs = docs.join(good, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "lang", F.col("_doc").isNotNull().alias("trusted"))
    counts = write_scratch(counted(docs.withColumn("trains", F.col("trusted") & ~held_out("doc"))), "grams")
    none = F.lit(0).cast("long")
    rows = docs.withColumns({"size": none, "units": none, "log": F.lit(0.0)})
    for shard in _shards(probabilities(counts), shard_rows):
        rows = _added(rows, df.sparkSession.sparkContext.broadcast(shard))
    scored = write_scratch(rows.drop("text").withColumn("perplexity", F.when(F.col("units") > 0, F.round(F.exp(-F.col("log") / F.col("units")), 4))), "scored")
    known = scored.where("trusted AND perplexity IS NOT NULL").withColumn("held", held_out("doc"))
    usual = known.groupBy("lang").agg(F.round(-F.sum("log") / F.sum("units"), 6).alias("usual"))
    shrunk = F.round(F.exp((-F.col("log") + USUAL_UNITS * F.col("usual")) / (F.col("units") + USUAL_UNITS)), 4)
    at = lambda c: F.percentile_approx(c, quantile, 100_000)
    cuts = known.join(F.broadcast(usual), "lang").withColumn("shrunk", shrunk).groupBy(F.col("lang").alias("_lang")).agg(
        F.first("usual").alias("usual"), F.coalesce(at(F.when(F.col("held"), F.col("shrunk"))), at("shrunk")).alias("threshold")
    )
    judged = scored.join(F.broadcast(cuts), F.col("lang") == F.col("_lang"), "left").withColumn("shrunk", F.when(F.col("units") > 0, shrunk))  # one row per language
    kept = (F.col("size") > 0) & F.coalesce(F.col("shrunk") <= F.col("threshold"), F.lit(True))
    return judged.select(F.col("doc").alias("doc_id"), "lang", "units", "perplexity", "shrunk", "threshold", kept.alias("kept"))
