"""Verifiers: text -> true (go on), false or null (reject the row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_text, is_subset, sentences, string_to_float


def equals(text: Column, value: str) -> Column:
    return clean_text(text) == clean_text(F.lit(value))


def differs(text: Column, value: str) -> Column:
    return clean_text(text) != clean_text(F.lit(value))


def differs_at(variants: Column, value: str, index: int) -> Column:
    """Look at one input of the first variant."""
    return differs(F.get(F.get(variants, F.lit(0)), F.lit(index)), value)


def is_in(text: Column, values: list[str]) -> Column:
    """For a short list of parameters; a long set belongs in a table and a left semi join."""
    return clean_text(text).isin(*[clean_text(F.lit(v)) for v in values])


def in_set_of(text: Column, value: str) -> Column:
    return equals(text, value) | is_subset(text, F.lit(value))


def not_in_set_of(text: Column, value: str) -> Column:
    return ~in_set_of(text, value)


def equals_number(text: Column, value: float, error: float = 0.0) -> Column:
    return F.abs(string_to_float(text) - F.lit(float(value))) <= F.lit(float(error))


def differs_from_number(text: Column, value: float, error: float = 0.0) -> Column:
    return ~equals_number(text, value, error)


def in_range(text: Column, start: float, end: float) -> Column:
    return string_to_float(text).between(F.lit(float(start)), F.lit(float(end)))


def out_of_range(text: Column, start: float, end: float) -> Column:
    return ~in_range(text, start, end)


def has_sentences(text: Column, minimum: int = 2) -> Column:
    return F.size(sentences(text)) >= F.lit(minimum)


def always(_: Column) -> Column:
    return F.lit(True)
