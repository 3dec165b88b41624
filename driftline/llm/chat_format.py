"""Chat formatting by prefix-target expansion, in DataFrame operations only.

A turn becomes `<s>role`, a line feed, the escaped text and `</s>` with a line feed. Every assistant turn gives one
training example: all turns before it as context, the turn itself at the end, and only its text trainable. Turns after
the last assistant turn (all turns, where there is none) are kept in a last example with nothing trainable, so that a
conversation can be read back in whole from its last example.

Control strings inside texts, those of this template and of the usual others, get a backslash after their first
character; one that already has backslashes there gets one more. So the template's marks are never found in a text and
the way back is exact. Roles are URL-encoded for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole

#: What stands after the first character in control strings of public chat templates.
CONTROL_RESTS = (
    "s>", "/s>", "INST\\]", "/INST\\]", "<SYS>>", "</SYS>>", "\\|im_start\\|>", "\\|im_end\\|>", "\\|endoftext\\|>", "\\|user\\|>",
    "\\|assistant\\|>", "\\|system\\|>",
)
_RESTS = "|".join(CONTROL_RESTS)
ESCAPE, UNESCAPE = rf"([<\[])(\\*(?:{_RESTS}))", rf"([<\[])\\(\\*(?:{_RESTS}))"
OPEN, CLOSE = "<s>", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2"))


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example, text, loss_start, loss_length): the examples of every conversation; places in code points.

    A null text counts as empty and a null role as the empty role. Turns are ordered by turn number, then by role and
    text, so ties and repeated rows have one order; a null turn number comes first. Rows with a null conversation form
    one conversation. A conversation is one row here, as each of its examples is one text.
    """
    spoken = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), whole(text).alias("said")
    )
    parts = spoken.select(
        "conv",
        F.struct(
            "at", "role", "said", (F.col("role") == "assistant").alias("target"), F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")).alias("head"),
            escape(F.col("said")).alias("body"),
        ).alias("part"),
    )
    talks = parts.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    # Where each turn ends in the conversation's formatted text: a running sum of lengths.
    ends = F.aggregate(
        "parts",
        F.array().cast("array<int>"),
        lambda ends, p: F.concat(
            ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))
        ),
    )
    talks = talks.select(
        "conv", "parts", ends.alias("ends"),
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE)))).alias("whole"),
        F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("parts", i)["target"] | (i == F.size("parts") - 1)).alias("stops"),
    )
    one = talks.select("conv", "whole", "ends", "parts", F.posexplode_outer("stops").alias("example", "i")).select(
        "conv", "example", "whole", F.get("ends", "i").alias("end"), F.get("parts", "i").alias("part")
    )
    size = F.when(F.col("part.target"), F.length("part.body")).otherwise(0)
    return one.select(
        F.col("conv").alias(conv), "example", F.substring("whole", F.lit(1), F.col("end")).alias("text"),
        (F.col("end") - len(CLOSE) - size).alias("loss_start"), size.alias("loss_length"),
    )


def trained_text(text: Column, start: Column, length: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substring(text, start + 1, length))


def turns_of(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring(F.substring_index(p, "\n", 1), F.lit(len(OPEN) + 1), F.length(p))).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What an examples table says about each conversation: its turns, its trained text and the characters written.

    formatted_chars counts the characters of all examples of a conversation, contexts included.
    """
    reply = trained_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    gathered = examples.groupBy(conv).agg(
        F.max_by("text", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", reply.alias("reply")))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    return gathered.select(
        conv, turns_of(F.col("last")).alias("turns"),
        F.concat_ws("", F.transform("replies", lambda r: r["reply"])).alias("trained"), "formatted_chars",
    )
