"""Questions about answers: is it an answer at all, and to which question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.relations import says_true
from ..functions.text import clean_text, is_subset
from ..plans.templates import template
from .model_calls import AnswerStore, Model, ask


def known_or_unknown(
    df: DataFrame, column: str, helper: Model, store: AnswerStore | None = None, when: Column | None = None
) -> DataFrame:
    """An answer that says it does not know, in whatever words, becomes "unknown".

    Answers with "unknown" in them are told without a question; the helper is asked about the others. Where that call
    fails nothing can be said of the answer, and it becomes null.
    """
    text = F.col(column)
    plain = is_subset(text, F.lit("unknown"))
    asked = ~plain if when is None else when & ~plain
    df = ask(df, helper, template("helper:answers_question"), [text], "_said", "helper", asked, store)
    failed = F.coalesce(asked, F.lit(False)) & F.col("_said").isNull()
    told = F.when(plain | ~says_true(F.col("_said")), "unknown").when(~failed, text)
    return df.withColumn(column, told).drop("_said")


def question_of_answer(df: DataFrame, column: str, out: str, helper: Model, store: AnswerStore | None = None) -> DataFrame:
    return ask(df, helper, template("helper:question_of_answer"), [F.col(column)], out, "helper", None, store)


def sentiment_word(df: DataFrame, column: str, out: str, helper: Model, store: AnswerStore | None = None) -> DataFrame:
    df = ask(df, helper, template("helper:sentiment_word"), [F.col(column)], out, "helper", None, store)
    return df.withColumn(out, clean_text(F.col(out)))
