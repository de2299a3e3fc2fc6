"""Text expressions and table jobs: clean-up, number mentions, headings, JSON payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import fixed_values as fx
from tablescope.plans.lookup import lookup_join


def clean_text(c: Column) -> Column:
    """Plain spaces and hyphens for their typographic forms."""
    plain = F.translate(c, fx.SPACE_LIKE + fx.HYPHEN_LIKE, "  --")
    return F.replace(plain, F.lit(fx.EM_DASH), F.lit("--"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def section_checks(c: Column) -> dict[str, Column]:
    """Named checks of one report text: headings, action headings, length."""
    missing = F.array_compact(
        F.array(*[F.when(~F.contains(c, F.lit(s)), F.lit(s)) for s in fx.REPORT_SECTIONS])
    )
    actions = F.regexp_count(c, F.lit(r"(?imd)^#{1,3} .*action"))
    return {
        "has_all_sections": F.size(missing) == 0,
        "missing_sections": missing,
        "action_count": actions,
        "actions_under_5": actions <= fx.MAX_ACTION_HEADINGS,
        "length_ok": F.length(c) >= fx.MIN_REPORT_CHARS,
    }


def percent_sum(c: Column) -> Column:
    """Sum of the first three whole numbers that stand before a percent sign."""
    found = F.slice(F.regexp_extract_all(c, F.lit(r"(\d+)%"), F.lit(1)), 1, 3)
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def _mention_arrays(c: Column) -> Column:
    """Per number in the text: its raw form and up to 30 characters on each side, as an array of structs.

    One expression with look-around takes the neighbours, so the text itself is never copied per mention.
    """
    side = fx.CONTEXT_CHARS
    pattern = F.lit(
        rf"(?s)(?=[0-9])(?<=(\A.{{0,{side - 1}}}|.{{{side}}}))({fx.NUMBER_PATTERN})(?=(.{{0,{side}}}))"
    )
    return F.arrays_zip(
        F.regexp_extract_all(c, pattern, F.lit(2)).alias("raw"),
        F.regexp_extract_all(c, pattern, F.lit(1)).alias("before"),
        F.regexp_extract_all(c, pattern, F.lit(3)).alias("after"),
    )


def _exploded_mentions(df: DataFrame, key: str, text: str, *extra: Column) -> DataFrame:
    rows = df.select(F.col(key), *extra, F.posexplode_outer(_mention_arrays(F.col(text))).alias("place", "m"))
    return rows.select(
        *[c for c in rows.columns if c != "m"],
        F.col("m.raw").alias("raw"),
        F.replace(F.col("m.raw"), F.lit(","), F.lit("")).alias("number"),
        F.col("m.before").alias("before"),
        F.lower(F.concat("m.before", "m.raw", "m.after")).alias("context"),
    )


def number_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """`<key>, number, pos, context` of every number; pos counts characters from 0. `key` must be unique.

    Each text is gone through once where it lies; nothing is shuffled, and only mentions come back from Python.
    """
    pattern, side, kind = re.compile(fx.NUMBER_PATTERN, re.ASCII), fx.CONTEXT_CHARS, df.schema[key].dataType

    def run(batches):
        for batch in batches:
            rows, raws, places, contexts = [], [], [], []
            for row, body in enumerate(batch.column("text")):
                body = body.as_py()
                for m in pattern.finditer(body) if body else ():
                    rows.append(row)
                    raws.append(m[0])
                    places.append(m.start())
                    contexts.append(body[max(0, m.start() - side) : m.end() + side])
            columns = [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(raws, pa.string()), pa.array(places, pa.int64()), pa.array(contexts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "raw", "pos", "context"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("raw", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("context", T.StringType())])
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), F.replace("raw", F.lit(","), F.lit("")).alias("number"), "pos", F.lower("context").alias("context"))


def _plain_decimal(c: Column, places: int) -> Column:
    """A number as text with at least one decimal place and no trailing zeros."""
    text = F.round(c, places).try_cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1")


def ground_truth_numbers(df: DataFrame, text: str) -> DataFrame:
    """`number`: the numbers of a text column with their x100 (below one) and /100 (above one) forms, as text."""
    raw = df.select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(fx.GROUND_TRUTH_PATTERN), F.lit(0))).alias("number")
    ).distinct()
    value = F.col("number").try_cast("double")
    forms = F.array(
        F.col("number"),
        F.when(value < 1, F.round(value * 100, 0).try_cast("decimal(38,0)").cast("string")),
        F.when(value < 1, _plain_decimal(value * 100, 2)),
        F.when(value > 1, _plain_decimal(value / 100, 4)),
    )
    return raw.select(F.explode(F.array_compact(forms)).alias("number")).distinct()


def is_skipped(number: Column, before: Column, context: Column) -> Column:
    """True where a number stands in a context that is not checked."""
    lead = F.lower(F.right(before, F.lit(fx.OPERATOR_CHARS)))
    after_operator = F.lit(False)
    for mark in fx.OPERATOR_MARKS:
        after_operator = after_operator | F.contains(lead, F.lit(mark))
    small_word = F.lit(False)
    for word in fx.SMALL_NUMBER_WORDS:
        small_word = small_word | F.contains(context, F.lit(word))
    value = number.try_cast("double")
    return (
        after_operator
        | context.rlike("|".join(fx.SKIP_PATTERNS))
        | ((value <= fx.SMALL_NUMBER) & small_word)
        | context.rlike("|".join(fx.STATISTIC_PATTERNS))
    )


def invented_mentions(
    df: DataFrame, key: str, text: str, truth: DataFrame
) -> DataFrame:
    """`<key>, number, context, invented` of all mentions; texts without numbers keep one row with a null number."""
    rows = _exploded_mentions(df, key, text)
    checked = rows.withColumn(
        "number", F.when(~is_skipped(F.col("number"), F.col("before"), F.col("context")), F.col("number"))
    )
    known = truth.select("number", F.lit(True).alias("_known"))
    joined = lookup_join(checked, known, "number")
    return joined.select(
        key,
        "number",
        F.trim(F.col("context")).alias("context"),
        (F.col("number").isNotNull() & F.col("_known").isNull()).alias("invented"),
    )


def invented_numbers(
    df: DataFrame, key: str, text: str, truth: DataFrame
) -> DataFrame:
    """`<key>, invention_count, pass` per text."""
    rows = invented_mentions(df, key, text, truth)
    counts = rows.groupBy(key).agg(F.count_if("invented").alias("invention_count"))
    return counts.withColumn("pass", F.col("invention_count") <= fx.MAX_INVENTED_NUMBERS)


#: Brackets in a row of which values are looked for.
DEEPEST = 1000


@F.pandas_udf(T.StringType())
def _first_json_value(texts: pd.Series) -> pd.Series:
    """The first decodable JSON object or array inside each text; null texts are passed over."""
    decoder = json.JSONDecoder()
    nested, bracket = re.compile(r"(?:[{\[]\s*)+"), re.compile(r"[{\[]")

    def find(text):
        if text is None:
            return None
        for run in nested.finditer(text):
            # A value that starts further from the end of its brackets is nested too deep for the decoder.
            for start in [m.start() for m in bracket.finditer(text, run.start(), run.end())][-DEEPEST:]:
                try:
                    return text[start : decoder.raw_decode(text, start)[1]]
                except (ValueError, RecursionError):
                    continue
        return None

    return texts.map(find, na_action="ignore")


def json_payload(c: Column) -> Column:
    """JSON text found in free text: code fences are dropped, then the whole text or the first value inside it.

    Texts that are clean JSON stay in the JVM; only the rest reaches the Python search. Escaped `\\n` and `\\t`
    inside strings become a line break and a tab. Null when there is no JSON.
    """
    bare = F.btrim(F.regexp_replace(c, r"```(?:json)?\s*", ""), F.lit(" \t\n\r\f\v"))
    whole = F.try_parse_json(bare)
    rest = _first_json_value(F.when(whole.isNull() & bare.rlike(r"[{\[]"), bare))
    text = F.when(whole.isNotNull(), bare).otherwise(rest)
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\\\([nt])", r"$1\\$2")


def result_contents(query: Column, response: Column) -> Column:
    """`query` with the array of `response.results[].content`."""
    return F.struct(
        query.alias("query"), F.transform(response["results"], lambda r: r["content"]).alias("content")
    )


def text_keys(c: Column, kind: T.DataType) -> Column:
    """A value of the given type with the keys of all maps in it as text, however deep they lie."""
    if isinstance(kind, T.MapType):
        values = F.transform_values(c, lambda k, v: text_keys(v, kind.valueType)) if _has_map(kind.valueType) else c
        return F.transform_keys(values, lambda k, v: k.cast("string"))
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(c, lambda v: text_keys(v, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(c.isNotNull(), F.struct(*[text_keys(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def payload_schema(df: DataFrame, column: str) -> T.StructType:
    """The merged schema of all JSON objects in a text column; what isn't a JSON object is left out."""
    parsed = F.try_parse_json(F.col(column))
    found = df.select(parsed.alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'").agg(F.schema_of_variant_agg("v")).first()[0]
    if found is None or not found.startswith("OBJECT<"):
        return T.StructType([])
    # An object is a struct; a field of nothing but nulls or of mixed types is kept as text.
    ddl = found.replace("OBJECT<", "struct<")
    return T.DataType.fromDDL(ddl)


def payload_fields(df: DataFrame, column: str, schema: T.StructType | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and one typed column per field of the JSON objects in a text column.

    The fields and their types are those of all rows together unless a schema is given; a value that doesn't fit is null, and so
    are the fields of a row that is no JSON object. Fields of mixed types are JSON text.
    """
    schema = payload_schema(df, column) if schema is None else schema
    keep = [c for c in df.columns if c != column] if keep is None else keep
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.try_parse_json(F.col(column)).alias("_payload"))

    def field(f: T.StructField) -> Column:
        path = "$." + f.name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f.name) else "$[" + json.dumps(f.name) + "]"
        if isinstance(f.dataType, (T.VariantType, T.NullType)):
            return F.to_json(F.try_variant_get("_payload", path, "variant")).alias(f.name)
        return F.try_variant_get("_payload", path, f.dataType.simpleString()).alias(f.name)

    return rows.select(*[F.col(f"`{c}`") for c in keep], *[field(f) for f in schema.fields])
