r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable. Turns after the
last assistant turn, or a conversation without one, give one further example without a trainable part, so the output holds every turn.

Template: ``<|turn|>ROLE<|sep|>TEXT<|end|>`` for each turn. Inside roles and texts, a backslash is doubled and each control string gets
a backslash after its first character; dropping every backslash and keeping what follows it restores the input. So no text can forge a
marker, and the output can be parsed back.

The work is DataFrame functions only. A conversation is one group, as its longest example is one row that holds all of it; only its
turns meet in a task, never several conversations of one role, text or source.

Defined results: null role or text is empty; null turn numbers sort first; rows that tie on turn go by role, then text; repeated rows
are turns of their own; a null conv_id is one conversation. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
#: Strings that common chat templates treat as control. Those of this template all begin with the first one.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_FORGED = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_FORGED})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, target (turn's place from 0), n_context, trainable, formatted, loss_start, loss_end (code points, end exclusive)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == trained_role).alias("train"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body")))
    pieces = F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    targets = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda k: F.get("parts", k)["train"] | (k == F.size("parts") - 1))
    rows = grouped.select("conv_id", parts.alias("parts")).withColumn("pieces", pieces).select("conv_id", "parts", "pieces", F.explode(targets).alias("target"))
    last = F.get("parts", F.col("target"))
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("target")), "")
    rows = rows.select("conv_id", "target", last.alias("last"), context.alias("context"))
    start = F.length("context") + F.length("last.head")
    width = F.when(F.col("last.train"), F.length("last.body")).otherwise(0)
    return rows.select(
        "conv_id",
        F.col("target").cast("long").alias("target"),
        F.col("target").cast("long").alias("n_context"),
        F.col("last.train").alias("trainable"),
        F.concat("context", "last.head", "last.body", F.lit(END)).alias("formatted"),
        start.cast("long").alias("loss_start"),
        (start + width).cast("long").alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of role and text, unescaped."""
    marked = F.split(formatted, re.escape(TURN))
    bodies = F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0)))
    sep, end = len(SEP), len(END)

    def turn(part: Column) -> Column:
        at = F.instr(part, SEP)
        return F.struct(unescape(F.substring(part, 1, at - 1)).alias("role"), unescape(part.substr(at + sep, F.length(part) - at - sep - end + 1)).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(formatted.substr((start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from formatted examples alone: turn count and digest, loss length and digest, characters in all examples."""
    rows = examples.select("conv_id", "target", "formatted", F.when(F.col("trainable"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).alias("loss"))
    turn_text = F.transform(parse_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    per = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("longest"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    return per.select("conv_id", turn_text.alias("texts"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join("texts", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
