"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns up to it are the context, and only its own text is trainable.
Turns after the last assistant turn (or a conversation without one) give a last example without trainable text, so
that the output holds every turn. Control strings inside roles and texts are broken by a backslash after their
first character, and backslashes are doubled, so that formatted text can be parsed back exactly.

Cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text; repeated rows
are repeated turns; a row with a null conv_id is a conversation of its own, since nothing ties it to another; an
empty table gives no examples; other columns are ignored. A conversation is one value: its turns have to fit a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``before_role`` role ``before_text`` text ``after_text``; ``controls`` never appear inside a text."""

    before_role: str = "<s>[INST]"
    before_text: str = "[/INST]"
    after_text: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained_role: str = "assistant"


def escape(text: Column, template: Template) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, conversation (tells null ids apart), example (from 0), n_turns, text, loss_start, loss_end, trained, whole.

    The loss mask is the range of code points [loss_start, loss_end); ``whole`` marks the example with all turns.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("conversation"),
        F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
    grouped = rows.groupBy("conv_id", "conversation").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    shown = grouped.select(
        "conv_id", "conversation", F.size("turns").alias("size"),
        F.transform("turns", lambda t: F.struct(
            (t["role"] == template.trained_role).alias("trained"), F.length(escape(t["text"], template)).alias("chars"),
            F.concat(F.lit(template.before_role), escape(t["role"], template), F.lit(template.before_text),
                     escape(t["text"], template), F.lit(template.after_text)).alias("shown"))).alias("turns"))
    ends = F.filter(
        F.transform("turns", lambda t, i: F.when(t["trained"] | (i + 1 == F.col("size")), i + 1)), lambda i: i.isNotNull())
    expanded = shown.select("*", F.posexplode(ends).alias("example", "n_turns"))
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("n_turns")), lambda t: t["shown"]), "")
    target = F.element_at("turns", F.col("n_turns"))
    end = F.length("text") - F.when(target["trained"], F.lit(len(template.after_text))).otherwise(0)
    return (
        expanded.withColumn("text", text)
        .select("conv_id", "conversation", "example", "n_turns", "text",
                (end - F.when(target["trained"], target["chars"]).otherwise(0)).alias("loss_start"), end.alias("loss_end"),
                target["trained"].alias("trained"), (F.col("n_turns") == F.col("size")).alias("whole"))
    )


def parse(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    shown = F.split(text, _quoted(template.after_text), -1)
    parts = F.transform(
        F.slice(shown, 1, F.size(shown) - 1),
        lambda s: F.split(F.substr(s, F.lit(len(template.before_role) + 1)), _quoted(template.before_text), 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, read back from its examples: the turns, the text under the loss mask, and the size."""
    masked = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = F.when(F.col("whole"), parse(F.col("text"), template))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.select(
        "conv_id", "conversation", F.struct("example", masked.alias("loss")).alias("masked"), F.length("text").alias("chars"),
        F.struct(F.size(turns).cast("long").alias("n"), F.sha2(said, 256).alias("sha")).alias("turns"), "whole")
    grouped = back.groupBy("conv_id", "conversation").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("masked")), lambda m: m["loss"]), "").alias("loss"),
        F.first(F.when(F.col("whole"), F.col("turns")), ignorenulls=True).alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"))
    return grouped.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
