"""Prompt rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..plans.templates import SYSTEM_LINE, Template


def placeholder(index: int, pattern: str = "{INPUT_#}") -> str:
    return pattern.replace("#", str(index))


def fill(prompt: Column, inputs: list[Column], pattern: str = "{INPUT_#}") -> Column:
    """Fill the slots in order; a null is an empty text. A later slot inside an inserted text is filled too."""
    for index, value in enumerate(inputs):
        prompt = F.replace(prompt, F.lit(placeholder(index, pattern)), F.coalesce(value, F.lit("")))
    return prompt


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(template: Template, inputs: list[Column]) -> Column:
    """The chat: a system line, a question and answer per example, and the question itself."""
    chat = [_message("system", F.lit(SYSTEM_LINE))]
    for example_inputs, answer in template.examples:
        chat.append(_message("user", fill(F.lit(template.prompt), [F.lit(v) for v in example_inputs])))
        chat.append(_message("assistant", F.lit(answer)))
    chat.append(_message("user", fill(F.lit(template.prompt), inputs)))
    return F.array(*chat)
