"""Findings and chart tables on disk. Findings are kept by run, and a reader never sees half of a run.

Every save writes its tables into a folder of its own, which nobody changes afterwards, and then adds one small manifest file
that names them; that file is the commit. A save that dies before it leaves the earlier run as it was, and two writers of one run
don't touch each other's files: the later commit counts. Run ids are texts of any characters.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "run_id string, name string, commit string, moment bigint, schema string"


def save_findings(findings: dict[str, DataFrame], folder: str, run_id: str) -> str:
    """Store the tables of a run, all of them or none; a later save of the run replaces them. Returns the commit's name."""
    commit = f"c{uuid.uuid4().hex}"
    for name, table in findings.items():
        table.write.parquet(f"{folder}/commits/{commit}/{name}")
    rows = [(str(run_id), n, commit, time.time_ns(), t.schema.json()) for n, t in findings.items()]
    if rows:
        spark = next(iter(findings.values())).sparkSession
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return commit


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """`run_id, name, commit, moment, schema` of the tables that count: the last commit of each run and name."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    last = F.max_by(F.struct("commit", "moment", "schema"), F.struct("moment", "commit")).alias("last")
    return manifest.groupBy("run_id", "name").agg(last).select("run_id", "name", "last.*")


def _common(kinds: list[T.StructType]) -> dict[str, T.DataType]:
    """All columns; one that has different types is text."""
    out: dict[str, T.DataType] = {}
    for field in (f for kind in kinds for f in kind):
        out[field.name] = field.dataType if out.get(field.name, field.dataType) == field.dataType else T.StringType()
    return out


def load_findings(spark: SparkSession, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    """One findings table of all runs, or of one run, with its `run_id`; columns that a run doesn't have are null there."""
    found = runs(spark, folder).where(F.col("name") == name)
    if run_id is not None:
        found = found.where(F.col("run_id") == str(run_id))
    stored = sorted(found.collect(), key=lambda r: (r.moment, r.commit))  # one row per run
    if not stored:
        raise ValueError(f"no table {name} of {'any run' if run_id is None else run_id} in {folder}")
    groups: dict[str, list] = {}
    for r in stored:
        groups.setdefault(r.schema, []).append(r)
    columns = _common([T.StructType.fromJson(json.loads(s)) for s in groups])
    # The run of a file follows from the commit in its path.
    commits = spark.createDataFrame([(r.commit, r.run_id) for r in stored], "_commit string, run_id string")
    out = None
    for schema, own in groups.items():
        kind = T.StructType.fromJson(json.loads(schema))
        rows = spark.read.schema(kind).parquet(*[f"{folder}/commits/{r.commit}/{name}" for r in own])
        place = F.regexp_extract(F.col("_metadata.file_path"), "/commits/(c[0-9a-f]{32})/", 1)
        # A null keeps its place as text; other values are written as Spark casts them.
        part = rows.select(*[F.col(f"`{f.name}`").cast(columns[f.name]).alias(f.name) for f in kind], place.alias("_commit"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.join(commits, "_commit").select(*[F.col(f"`{c}`") for c in columns if c != "run_id"], "run_id")


def findings_difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, `change` (added, gone, changed) and `changed_columns` of the rows that two tables don't share.

    `keys` are unique in each table; nulls are equal. A column that only one table has counts as null in the other.
    """
    others = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c not in keys]
    null = F.lit(None)

    def side(df: DataFrame, mark: str) -> DataFrame:
        values = [(F.col(f"`{c}`") if c in df.columns else null).alias(f"{mark}{i}") for i, c in enumerate(others)]
        return df.select(*[F.col(f"`{k}`").alias(f"{mark}_{i}") for i, k in enumerate(keys)], F.lit(True).alias(mark), *values)

    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"b_{i}").eqNullSafe(F.col(f"a_{i}"))
    joined = side(before, "b").join(side(after, "a"), same, "full_outer")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    differing = [F.when(both & ~F.col(f"b{i}").eqNullSafe(F.col(f"a{i}")), F.lit(c)) for i, c in enumerate(others)]
    columns = F.array_compact(F.array(*differing)) if others else F.array().cast("array<string>")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "gone").when(F.size("changed_columns") > 0, "changed")
    rows = joined.withColumn("changed_columns", columns).withColumn("change", change).where("change IS NOT NULL")
    return rows.select(*[F.coalesce(f"b_{i}", f"a_{i}").alias(k) for i, k in enumerate(keys)], "change", "changed_columns")


def save_charts(charts: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One small table per chart, as Parquet or JSON."""
    for name, table in charts.items():
        table.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
