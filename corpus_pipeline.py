"""Corpus pipeline: five text operators in a row over `documents`.

Every stage takes (spark, docs, sf_dir) and works on all rows that it gets. All but the last return the columns of `docs`.
Rows may repeat, and any column may be null. Further columns are kept, whatever their names: they are set aside under other
names while a stage works. Where the last stage's own columns are there already, the given ones are called `given_...`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, jaccard, language, pieces, secrets
from tablescope.llm.catalog import piece_model, secret_forest, table
from tablescope.llm.frames import small_batches
from tablescope.plans.scratch import write_scratch

#: A text of which its language explains less than this share of the n-grams is rejected.
LEAST_SHARE = 0.2
#: Words of a shingle and percent of similarity at which documents count as copies.
WORDS, PERCENT = 5, 80


#: Columns that the stages read; no operator has an output of these names.
READ = ("doc_id", "text", "lang", "n_chars")


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with plain names for the columns that no stage reads, and the name of each column there."""
    names = {c: c if c in READ else f"aside_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The given columns under their names, and `more`."""
    given = [F.col(now).alias(f"given_{was}" if was in more else was) for was, now in names.items()]
    return docs.select(*given, *more)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; a null `lang` becomes the predicted one."""
    small_batches(spark)
    docs, names = set_aside(docs)
    filters = language.train(docs.where(~language.held_out()))
    judged = language.predict(docs, filters, predicted="_language", score="_share")
    kept = judged.where((F.col("_language") != language.UNKNOWN) & (F.col("_share") >= LEAST_SHARE))
    return restored(kept.withColumn("lang", F.coalesce("lang", "_language")), names)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, then text hash. Texts without words all stay."""
    docs, names = set_aside(docs)
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    linked = jaccard.link(docs.select(key.alias("_key"), "text"), doc="_key", width=WORDS, percent=PERCENT)
    linked = write_scratch(linked.withColumnsRenamed({"doc_id": "_key", "component_id": "_first"}), "copies")
    spoken = linked.where("n_shingles > 0")
    keys = spoken.groupBy("_key").agg(F.count("*").alias("_rows"), F.min("_first").alias("_first"))
    keyed = docs.withColumn("_key", key)
    same = lambda a, b: F.expr(f"{a} <=> {b}")
    gone = keys.where(~same("_key", "_first")).select(F.col("_key").alias("_gone"))
    repeated = keys.where(same("_key", "_first") & (F.col("_rows") > 1)).select(F.col("_key").alias("_gone"))
    left = keyed.join(gone, F.expr("_key <=> _gone"), "left_anti")
    once = left.join(repeated, F.expr("_key <=> _gone"), "left_anti")
    first = left.join(repeated, F.expr("_key <=> _gone"), "left_semi").dropDuplicates(["_key"])
    return restored(once.unionByName(first), names)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in passages of the benchmark."""
    small_batches(spark)
    docs, names = set_aside(docs)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return restored(decontaminate.judged(found).where(~F.col("contaminated")), names)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced and `n_chars` counted again where that changed a text."""
    docs, names = set_aside(docs)
    found = secrets.scan(docs, secret_forest(docs), redacted="_redacted")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        found = found.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("_redacted").cast(kind)).otherwise(F.col("n_chars")))
    return restored(found.withColumn("text", F.col("_redacted")), names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the ids of their texts and how many these are."""
    small_batches(spark)
    docs, names = set_aside(docs)
    found = pieces.encode(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("long"))
    return restored(found, names, "ids", "n_tokens")


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", copies),
    ("benchmark decontamination", benchmarks),
    ("secret scans", leaks),
    ("SentencePiece encoding and decoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over `documents`; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = write_scratch(docs, "stage")
    return docs
