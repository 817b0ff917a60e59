"""Chat formatting with Spark expressions only.

The template: a conversation is a run of blocks ``<|turn|>role<|text|>text<|end|>``. Adjacent turns of a role share a block;
their texts are set apart by ``<|more|>``, so that the turns can be read back. A ``<`` followed by backslashes and a bar gets
one backslash more inside roles and texts, so that no control string can occur there and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _pattern(control: str) -> str:
    return control.replace("|", r"\|")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, segments)`` of ``turns(conv_id, turn, role, text)``.

    ``segments`` is an array of ``(text, loss)`` that concatenates to ``formatted``; the loss mask covers the escaped texts of
    the trained role. Turns are sorted by turn, then role, then text. Defined cases: a null text or role is empty; null turns
    come first; repeated rows are turns of their own; rows with a null id are one conversation; an empty table gives an
    empty result. A conversation is one string by definition, so that it must fit a task; only its size bounds that.
    """
    clean = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("__t"))
    sorted_ = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("__t")).alias("__turns"))
    # The sorted array is used several times, so that Spark keeps it as a column.
    role = lambda i: F.get("__turns", i)["role"]
    first = F.lit(0)
    parts = F.transform(
        "__turns",
        lambda t, i: F.array(
            F.struct(
                F.when((i > first) & (role(i - 1) == t["role"]), F.lit(MORE)).otherwise(F.concat(F.when(i > first, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("text"),
                F.lit(False).alias("loss"),
            ),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("loss")),
        ),
    )
    closed = F.concat(F.flatten(parts), F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    out = sorted_.select("conv_id", "__turns", F.size("__turns").alias("__n")).select("conv_id", closed.alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of ``(role, text)`` in order."""
    blocks = F.filter(F.split(formatted, _pattern(TURN)), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, _pattern(END) + "$", ""), _pattern(TEXT)))
    turns = F.transform(parsed, lambda p: F.transform(F.split(F.get(p, F.lit(1)), _pattern(MORE)), lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text"))))
    return F.flatten(turns)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
