"""Personal data: finding sensitive columns, tokens, reversible token map, leak check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.columns import require_columns, string_columns
from tablescope.functions import fixed_values as fx
from tablescope.functions.scalars import short_key
from tablescope.plans.lookup import lookup_join

TOKEN_MARK = "ID-"
TOKEN_DIGITS = 16
TOKEN_PATTERN = r"ID-[0-9a-f]{16}"
COLUMNS_PER_JOB = 8


def sensitive_columns(df: DataFrame, share: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """`column, name_match, email_share, phone_share, id_share, is_sensitive` of every string column.

    Shares are over the non-null values, whole texts are searched; a column is sensitive by its name or when one
    share reaches `share`.
    """
    columns = columns or string_columns(df)
    parts = []
    for at in range(0, len(columns), COLUMNS_PER_JOB):
        names = columns[at : at + COLUMNS_PER_JOB]
        shapes = {"email": fx.EMAIL_SHAPE, "phone": fx.PHONE_SHAPE, "id": fx.ID_SHAPE}
        totals = df.agg(
            *[
                F.avg(_shaped(F.col(f"`{c}`"), kind, shape).cast("double")).alias(f"{kind}{i}")
                for i, c in enumerate(names)
                for kind, shape in shapes.items()
            ]
        )
        parts.append(
            totals.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(c).alias("column"),
                                F.lit(c).rlike(f"(?i){fx.SENSITIVE_NAME}").alias("name_match"),
                                *[F.round(F.col(f"{kind}{i}"), 6).alias(f"{kind}_share") for kind in shapes],
                            )
                            for i, c in enumerate(names)
                        ]
                    )
                )
            )
        )
    found = reduce(DataFrame.unionByName, parts)
    highest = F.greatest("email_share", "phone_share", "id_share")
    return found.withColumn("is_sensitive", F.coalesce(F.col("name_match") | (highest >= share), F.col("name_match")))


def _shaped(value: Column, kind: str, shape: str) -> Column:
    return value.rlike(shape) & ~value.rlike(fx.PRODUCT_ID) if kind == "id" else value.rlike(shape)


def token(value: Column, secret: str, namespace: str) -> Column:
    """Keyed token of a value. Equal values get equal tokens wherever the same namespace is used."""
    digest = F.sha2(F.concat_ws("~", F.lit(secret), F.lit(namespace), value.cast("string")), 256)
    return F.when(value.isNotNull(), F.concat(F.lit(TOKEN_MARK), F.substring(digest, 1, TOKEN_DIGITS)))


def tokenise(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """The table with the listed columns replaced by tokens; unchanged when the list is empty."""
    require_columns(df, columns)
    return df.withColumns({c: token(F.col(f"`{c}`"), secret, c) for c in columns}) if columns else df


def _key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


def token_map(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """`column, token, ciphertext` of every distinct value; the plain value is not kept.

    The 12-byte IV is a keyed hash of the value, so a retried task writes the same bytes.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, token string, ciphertext binary")
    require_columns(df, columns)
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    values = long.where("value is not null").distinct()
    iv = F.unhex(F.substring(F.sha2(F.concat_ws("~", F.lit(secret), F.lit("iv"), "column", "value"), 256), 1, 24))
    digest = F.sha2(F.concat_ws("~", F.lit(secret), "column", "value"), 256)
    return values.select(
        "column",
        F.concat(F.lit(TOKEN_MARK), F.substring(digest, 1, TOKEN_DIGITS)).alias("token"),
        F.aes_encrypt(F.col("value").cast("binary"), _key(secret), F.lit("GCM"), F.lit("DEFAULT"), iv).alias(
            "ciphertext"
        ),
    )


def open_token_map(tokens: DataFrame, secret: str) -> DataFrame:
    """`column, token, value`; the value is null where the secret does not fit."""
    plain = F.try_aes_decrypt(F.col("ciphertext"), _key(secret), F.lit("GCM")).cast("string")
    return tokens.select("column", "token", plain.alias("value"))


def detokenise(
    df: DataFrame, column: str, tokens: DataFrame, secret: str
) -> DataFrame:
    """Put the real values back into one column; unknown tokens stay."""
    opened = open_token_map(tokens.where(F.col("column") == column), secret).select(
        F.col("token").alias(column), F.col("value").alias("_value")
    )
    joined = lookup_join(df, opened, column)
    restored = joined.withColumn(column, F.coalesce("_value", F.col(f"`{column}`")))
    return restored.select(*[F.col(f"`{c}`") for c in df.columns])


def detokenise_text(
    df: DataFrame, key: str, text: str, tokens: DataFrame, secret: str
) -> DataFrame:
    """`<key>, <text>` with every token in the text replaced by its real value. `key` must be unique.

    Texts are cut at their tokens, the pieces are joined with the opened map and put together again in order.
    Texts without a token skip the shuffle.
    """
    opened = open_token_map(tokens, secret).select("token", F.col("value").alias("_value")).dropDuplicates(["token"])
    has_token = F.coalesce(F.col(text).rlike(TOKEN_PATTERN), F.lit(False))
    found = F.regexp_extract_all(F.col(text), F.lit(TOKEN_PATTERN), F.lit(0))
    pieces = F.arrays_zip(F.split(F.col(text), TOKEN_PATTERN, -1).alias("part"), found.alias("token"))
    cut = (
        df.where(has_token)
        .select(key, F.posexplode(pieces).alias("place", "z"))
        .select(key, "place", "z.part", "z.token")
    )
    joined = lookup_join(cut, opened, "token")
    piece = F.concat("part", F.coalesce("_value", "token", F.lit("")))
    whole = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("p"))
    rebuilt = whole.select(key, F.array_join(F.col("p.piece"), "").alias(text))
    return df.where(~has_token).select(key, text).unionByName(rebuilt)


def leak_check(original: DataFrame, tokenised: DataFrame, columns: list[str]) -> DataFrame:
    """`column, missing, leaked_values, untokenised_values, collisions, pass` per tokenised column."""
    require_columns(original, columns)
    parts = []
    for c in columns:
        if c not in tokenised.columns:
            parts.append(
                original.sparkSession.range(1).select(
                    F.lit(c).alias("column"),
                    F.lit(True).alias("missing"),
                    *[F.lit(0).cast("bigint").alias(n) for n in ("leaked_values", "untokenised_values", "collisions")],
                )
            )
            continue
        # one row per distinct value with marks for the side it was seen on: one shuffle for all three counts
        value = F.col(f"`{c}`").cast("string")
        plain = ~F.startswith(value, F.lit(TOKEN_MARK))
        no, yes = F.lit(False), F.lit(True)
        before = original.select(short_key(value).alias("v"), yes.alias("b"), no.alias("a"), no.alias("plain"))
        after = tokenised.select(short_key(value).alias("v"), no.alias("b"), yes.alias("a"), plain.alias("plain"))
        seen = (
            before.unionAll(after)
            .where("v is not null")
            .groupBy("v")
            .agg(*[F.bool_or(m).alias(m) for m in ("b", "a", "plain")])
        )
        parts.append(
            seen.agg(
                F.count_if(F.col("b") & F.col("a")).alias("leaked_values"),
                F.count_if("plain").alias("untokenised_values"),
                (F.count_if("b") - F.count_if("a")).alias("collisions"),
            ).select(
                F.lit(c).alias("column"),
                F.lit(False).alias("missing"),
                "leaked_values",
                "untokenised_values",
                "collisions",
            )
        )
    checked = reduce(DataFrame.unionByName, parts)
    clean = ~F.col("missing") & (F.col("leaked_values") == 0) & (F.col("untokenised_values") == 0)
    return checked.withColumn("pass", clean & (F.col("collisions") == 0))


def anonymisation_check(leaks: DataFrame, run: str = "run_id") -> DataFrame:
    """`run, issue_count, pass` from leak checks of any runs: an issue per failing test of a column."""
    issues = (
        F.col("missing").cast("int")
        + (F.col("leaked_values") > 0).cast("int")
        + (F.col("untokenised_values") > 0).cast("int")
        + (F.col("collisions") > 0).cast("int")
    )
    total = leaks.groupBy(run).agg(F.sum(issues).alias("issue_count"))
    return total.select(run, "issue_count", (F.col("issue_count") == 0).alias("pass"))
