"""Chat formatting: conversations as training text with loss flags, from a declarative template.

A template names its control strings, the roles that are trained on, and a finite-state machine: (state, role) -> state,
starting in `start`. Every conversation is formatted; `valid` says whether the machine accepts its roles and `stopped_at` is
the first turn that it refuses. Text never holds a control string: between `<` and `|` one backslash more is put than stands there.
Segments carry a loss flag each; only the texts of trained roles have it.

DataFrame functions only. Rows of a conversation are ordered by turn, then role, then text, nulls first, so ties and repeated
rows have one defined order; null texts and roles are empty; rows without conversation id form one conversation. A
conversation is one training example and has to fit in one row. Empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    #: Stands for a line break inside a role's name.
    role_break: str = "<|role_break|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    #: (state, role, next state); the state `start` comes first.
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"),
        ("start", "user", "asked"),
        ("told", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
        ("answered", "tool", "asked"),
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("answered",)


CHAT = Template()


def escaped(text: Column) -> Column:
    """Reversible: `<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(
    df: DataFrame, template: Template = CHAT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: id, valid, stopped_at, segments (text, loss) and their concatenation `formatted`."""
    if not (template.opening.startswith("<|") and template.closing.startswith("<|") and template.role_break.startswith("<|")):
        raise ValueError("control strings have to start with <|")
    rows = df.select(
        F.col(conversation).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("row"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, name, after in template.moves for x in (f"{state}\n{name}", after)])

    def step(done: Column, row: Column) -> Column:
        after = F.element_at(moves, F.concat(done["state"], F.lit("\n"), row["role"]))
        return F.struct(
            F.when(done["ok"], F.coalesce(after, done["state"])).otherwise(done["state"]).alias("state"),
            (done["ok"] & after.isNotNull()).alias("ok"),
            F.when(done["ok"] & after.isNotNull(), done["turns"] + 1).otherwise(done["turns"]).alias("turns"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(True).alias("ok"), F.lit(0).alias("turns"))
    ran = turns.withColumn("run", F.aggregate("turns", start, step))

    def parts(row: Column) -> Column:
        name = F.regexp_replace(escaped(row["role"]), "\n", template.role_break)
        return F.array(
            F.struct(F.concat(F.lit(template.opening), name, F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(row["text"]).alias("text"), row["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.closing + template.after_turn).alias("text"), F.lit(False).alias("loss")),
        )

    return ran.select(
        "conv_id",
        (F.col("run.ok") & F.col("run.state").isin(*template.final)).alias("valid"),
        F.when(~F.col("run.ok"), F.get(F.col("turns"), F.col("run.turns"))["turn"]).alias("stopped_at"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """The rows of `format_conversations` with `turns` (role, text) and `loss_text`, read from the formatted text and segments alone."""
    tail = template.closing + template.after_turn

    def turn(part: Column) -> Column:
        name = F.substring_index(part, template.after_role, 1)
        body = F.substring(part, F.length(name) + 1 + len(template.after_role), F.length(part) - F.length(name) - len(template.after_role) - len(tail))
        return F.struct(unescaped(F.regexp_replace(name, re.escape(template.role_break), "\n")).alias("role"), unescaped(body).alias("text"))

    parts = F.split("formatted", re.escape(template.opening))
    return formatted.withColumns({
        "turns": F.transform(F.slice(parts, 2, F.size(parts)), turn),
        "loss_text": F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), ""),
    })


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what `read_back` found."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
