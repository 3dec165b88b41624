"""Output relations: (source output, follow-up output) -> true, false or null (cannot be judged)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import both_numeric, clean_text, is_subset, string_to_float


def equivalent(source: Column, followup: Column) -> Column:
    return clean_text(source) == clean_text(followup)


def different(source: Column, followup: Column) -> Column:
    return clean_text(source) != clean_text(followup)


def inverse(source: Column, followup: Column, first: str, second: str) -> Column:
    a, b = clean_text(source), clean_text(followup)
    return ((a == first) & (b == second)) | ((a == second) & (b == first))


def not_inverse(source: Column, followup: Column, first: str, second: str) -> Column:
    return ~inverse(source, followup, first, second)


def equivalent_numeric(source: Column, followup: Column, error: float = 0.0) -> Column:
    return F.abs(string_to_float(source) - string_to_float(followup)) <= F.lit(float(error))


def different_numeric(source: Column, followup: Column, error: float = 0.0) -> Column:
    """Outputs without a number count as different: the negation of "cannot be judged" is true."""
    return F.coalesce(~equivalent_numeric(source, followup, error), F.lit(True))


def stronger(source: Column, followup: Column, start: float = 0.0, end: float = 1.0) -> Column:
    """The follow-up is at least as far out as the source, on the source's side of the middle."""
    a, b = string_to_float(source), string_to_float(followup)
    low, high = F.lit(float(start)), F.lit(float(end))
    middle = F.lit((float(start) + float(end)) / 2)
    judged = (
        F.when((a == b) & ((a == low) | (a == high)), True)
        .when(a < middle, b <= a)
        .when(a > middle, b >= a)
        .otherwise(True)
    )
    return F.when(both_numeric(source, followup), judged)


def same_or_stronger(source: Column, followup: Column, error: float = 0.0, start: float = 0.0, end: float = 1.0) -> Column:
    judged = equivalent_numeric(source, followup, error) | stronger(source, followup, start, end)
    return F.when(both_numeric(source, followup), judged)


def similar(source: Column, followup: Column, similarity: Column, threshold: float = 0.6) -> Column:
    """Close in the encoder's space, or one inside the other. A missing similarity counts as not close."""
    near = F.coalesce(similarity >= F.lit(float(threshold)), F.lit(False))
    return near | is_subset(source, followup)


def not_similar(source: Column, followup: Column, similarity: Column, threshold: float = 0.6) -> Column:
    return ~similar(source, followup, similarity, threshold)


def says_true(answer: Column) -> Column:
    """A helper's yes: exactly "true" once cleaned; anything else is no. Without an answer nothing is known (null)."""
    return clean_text(answer) == "true"
