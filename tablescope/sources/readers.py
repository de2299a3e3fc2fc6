"""Readers: delimited files with unknown encoding, Parquet, stored search results."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx

#: Text columns whose types are looked for in one pass.
COLUMNS_PER_JOB = 12
SEARCH_SCHEMA = "query string, response struct<results: array<struct<content: string>>>"


def file_shapes(spark: SparkSession, path: str) -> DataFrame:
    """`file, utf8, broken_lines, header` per file: whether every line is valid UTF-8, whether a quoted field goes over a line
    end, and the first line's bytes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        # Lines of one part of a file come in order, and its first part starts at 0.
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("place"),
        (quotes % 2 == 1).alias("open"),
    )
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or("open").alias("broken_lines"),
        F.min_by("value", "place").cast("binary").alias("header"),
    )


def file_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, otherwise ISO-8859-1 (which any bytes satisfy)."""
    return "UTF-8" if file_shapes(spark, path).agg(F.bool_and("utf8")).first()[0] in (True, None) else "ISO-8859-1"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def missing_to_null(df: DataFrame, missing: tuple[str, ...] = fx.MISSING_WORDS) -> DataFrame:
    """Texts that are words of `missing`, with or without spaces around, are null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(*missing), F.col(f"`{c}`")) for c in texts}) if texts else df


@dataclass(frozen=True)
class Layout:
    """What files have in common that are read together."""

    encoding: str
    broken_lines: bool
    header: tuple[str, ...]


def layouts(spark: SparkSession, path: str, encoding: str | None = None, sep: str = ",", **_) -> dict[Layout, list[str]]:
    """The files below `path` by encoding, line ends inside quotes, and names in their own header, in order."""
    kinds: dict[Layout, list[str]] = {}
    for f in file_shapes(spark, path).collect():  # one row per file
        name = encoding or ("UTF-8" if f.utf8 else "ISO-8859-1")
        line = bytes(f.header).decode(name, "replace").lstrip("\ufeff").rstrip("\r\n")
        header = next(csv.reader([line], delimiter=sep), [])
        kinds.setdefault(Layout(name, bool(f.broken_lines), tuple(header)), []).append(unquote(f.file))
    return kinds


def _parts(spark: SparkSession, path: str, schema: str | T.StructType | None, encoding: str | None, options: dict, record: str | None = None) -> list[DataFrame]:
    """The files of each layout as a table. With `record`, a text column of that name holds lines that don't fit.

    A schema goes by name where a file's header has just its names, in any order, and by place otherwise.
    """
    fields = spark.createDataFrame([], schema).schema if schema else None
    kinds = layouts(spark, path, encoding, **options)
    found = []
    for layout, files in sorted(kinds.items(), key=lambda x: (x[0].encoding, x[0].broken_lines, x[0].header)):
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').options(**options)
        reader = reader.option("encoding", layout.encoding).option("multiLine", layout.broken_lines)
        own = fields
        if fields and sorted(fields.names) == sorted(layout.header):
            own = T.StructType([fields[n] for n in layout.header])
        if record:
            own = own or T.StructType([T.StructField(n, T.StringType()) for n in layout.header])
            own = T.StructType([*own.fields, T.StructField(record, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", record)
        if len(kinds) > 1:
            # Folders such as `day=1` stay columns although files are named one by one.
            reader = reader.option("basePath", re.split(r"[*?\[{]", path)[0].rpartition("/")[0] if re.search(r"[*?\[{]", path) else path)
        found.append((reader.schema(own) if own else reader).csv(files if len(kinds) > 1 else path))
    return found


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str | None = None,
    missing: tuple[str, ...] = fx.MISSING_WORDS, **options
) -> DataFrame:
    """Delimited text with a header, quotes doubled inside quotes; words of `missing` are null.

    Each file is read in its own encoding and by its own header: files with the same names in another order fit together, a
    name that only some files have is null in the others. Only files with line ends inside quotes are read as a whole (Spark
    can't split those). Give a schema for large files: without one all values are looked at once more to find the types.
    Records with more fields than the header lose the rest, and missing fields are null; `file_records` counts them.
    """
    parts = _parts(spark, path, schema, encoding, options)
    if not parts:
        reader = spark.read.option("header", True)
        parts = [(reader.schema(schema) if schema else reader).csv(path)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=schema is None), parts)
    if schema:
        # Folder names become columns behind those of the schema.
        names = spark.createDataFrame([], schema).schema.names
        out = out.select(*[F.col(f"`{c}`") for c in [*names, *[c for c in out.columns if c not in names]]])
    out = missing_to_null(out, missing)
    return nan_to_null(out if schema else typed(out))


def file_records(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str | None = None, **options) -> DataFrame:
    """`file, records, bad_records` per file: records that don't fit in the number of their fields, or with a schema in type."""
    found = []
    for part in _parts(spark, path, schema, encoding, options, record="_record"):
        # Spark parses only the columns that are asked for, so all of them are.
        whole = F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in part.columns])
        rows = part.select(F.col("_metadata.file_path").alias("file"), F.col("_record").isNotNull().alias("bad"), F.length(whole).alias("n"))
        found.append(rows.groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.col("bad") & (F.col("n") >= 0)).alias("bad_records")))
    if not found:
        return spark.createDataFrame([], "file string, records bigint, bad_records bigint")
    return reduce(DataFrame.unionAll, found)


def malformed_records(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> int:
    """How many records don't fit the schema, in number or type of their fields."""
    return file_records(spark, path, schema, **options).agg(F.coalesce(F.sum("bad_records"), F.lit(0))).first()[0]


def typed(df: DataFrame) -> DataFrame:
    """Text columns in the narrowest type that every value fits: int, bigint, double, boolean, date, timestamp, else text."""
    kinds = {
        "int": fx.INTEGER_SHAPE, "bigint": fx.INTEGER_SHAPE, "double": fx.NUMBER_SHAPE, "boolean": r"^(?i:true|false)$",
        "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]",
    }
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = {}
    for at in range(0, len(texts), COLUMNS_PER_JOB):
        names = texts[at : at + COLUMNS_PER_JOB]
        fits = [F.count(F.when(F.col(f"`{c}`").rlike(shape), F.trim(F.col(f"`{c}`")).try_cast(k))) for c in names for k, shape in kinds.items()]
        counts = list(df.agg(*[F.count(F.col(f"`{c}`")) for c in names], *fits).first())
        for i, c in enumerate(names):
            own = counts[len(names) + i * len(kinds) :][: len(kinds)]
            found[c] = next((k for k, n in zip(kinds, own) if n == counts[i] > 0), "string")
    return df.select(*[(F.trim(F.col(f"`{c}`")).cast(found[c]).alias(c) if found.get(c, "string") != "string" else F.col(f"`{c}`")) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    """`query, content array` of stored search results, one JSON record per line; broken lines are left out."""
    stored = _search_lines(spark, path).where("_line IS NULL")
    return stored.select("query", F.transform("response.results", lambda r: r["content"]).alias("content"))


def _search_lines(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(f"{SEARCH_SCHEMA}, _line string").option("columnNameOfCorruptRecord", "_line")
    return reader.json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, lines, broken` per file of stored search results: lines that are no such record aren't read."""
    lines = _search_lines(spark, path)
    # All columns are asked for, so all of a line is parsed.
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_line").isNotNull().alias("bad"), F.length(F.to_json(F.struct("query", "response"))).alias("n"))
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("bad") & (F.col("n") >= 0)).alias("broken"))
