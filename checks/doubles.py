"""Test doubles: rules that stand in for models. They check the wiring of a run, not the quality of a model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftline.functions.draws import let
from driftline.functions.text import clean_text, sentences
from driftline.operators.encoders import ColumnEncoder
from driftline.operators.model_calls import ColumnModel
from driftline.plans.templates import Template

BUCKETS = 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(clean_text(text), " "), lambda t: t != "")


def _shared(text: Column, asked: Column) -> Column:
    """How many of the given tokens a text has. The empty token of an empty text is none of them, so it need not be left out."""
    return F.size(F.array_intersect(F.split(clean_text(text), " "), asked))


def _answer_question(context: Column, question: Column) -> Column:
    """The sentence of the context that shares most distinct tokens with the question."""

    def best(asked: Column) -> Column:
        scored = F.transform(
            sentences(context),
            lambda s, i: F.struct(_shared(s, asked).alias("n"), (-i).alias("i"), s.alias("s")),
        )
        return F.array_max(scored)

    return let(let(tokens(question), best), lambda b: F.when(b["n"] > 0, b["s"]).otherwise("unknown"))


def _infer(premise: Column, hypothesis: Column) -> Column:
    """By the share of the hypothesis' tokens that the premise has."""

    def count(h: Column) -> Column:
        # Bound before it is compared, or the premise is read once per comparison.
        shared = F.when(F.size(h) > 0, _shared(premise, h))
        return F.struct(shared.alias("shared"), F.size(h).alias("all"))

    def decide(n: Column) -> Column:
        return (
            F.when(n["all"] == 0, "neutral")
            .when(n["shared"] * 2 >= n["all"], "entailment")
            .when(n["shared"] * 10 < n["all"], "neutral")
            .otherwise("contradiction")
        )

    return let(let(F.array_distinct(tokens(hypothesis)), count), decide)


def _rate(text: Column) -> Column:
    """The share of the letters a-m among a-z, as 0.NN."""

    def count(az: Column) -> Column:
        first_half = F.length(F.regexp_replace(az, "[n-z]+", "")).cast("bigint")
        return F.struct(first_half.alias("first_half"), F.length(az).cast("bigint").alias("letters"))

    def rate(n: Column) -> Column:
        number = F.least(F.lit(99).cast("bigint"), F.floor(n["first_half"] * 100 / n["letters"]))
        return F.when(n["letters"] == 0, "n/a").otherwise(F.concat(F.lit("0."), F.lpad(number.cast("string"), 2, "0")))

    # Bound, so that a text is read once, and by compiled code: a loop over its characters in the generated method of a
    # whole run, which is too long for the JVM to compile, is interpreted.
    return let(let(F.regexp_replace(F.lower(text), "[^a-z]+", ""), count), rate)


def _relate(text: Column, head: Column, tail: Column) -> Column:
    def places(cleaned: Column) -> Column:
        h, t = F.instr(cleaned, clean_text(head)), F.instr(cleaned, clean_text(tail))
        return F.struct(h.alias("h"), t.alias("t"), F.length(cleaned).alias("half"))

    def decide(at: Column) -> Column:
        h, t, half = at["h"], at["t"], at["half"]
        return (
            F.when((h == 0) | (t == 0), "no relation")
            .when((h * 2 <= half) == (t * 2 <= half), "sibling")
            .otherwise("works for")
        )

    return let(let(clean_text(text), places), decide)


def _longest_tokens(text: Column) -> Column:
    def measure(all_tokens: Column) -> Column:
        longest = F.array_max(F.transform(all_tokens, F.length))
        return F.struct(all_tokens.alias("tokens"), longest.alias("longest"))

    def pick(b: Column) -> Column:
        return F.array_join(F.array_distinct(F.filter(b["tokens"], lambda t: F.length(t) == b["longest"])), "\n")

    return let(let(tokens(text), measure), pick)


def model_rule(template: Template, inputs: list[Column]) -> Column:
    if template.key == "sut_prompt:question_answering":
        return _answer_question(*inputs[:2])
    if template.key == "sut_prompt:inference":
        return _infer(*inputs[:2])
    if template.key == "sut_prompt:sentiment_analysis_continuous":
        return _rate(inputs[0])
    if template.key == "sut_prompt:relation_extraction":
        return _relate(*inputs[:3])
    return helper_rule(template, inputs)


def helper_rule(template: Template, inputs: list[Column]) -> Column:
    if template.name in ("keywords", "entity_keywords"):
        return _longest_tokens(inputs[0])
    if template.name in ("category_word", "synonym_word", "antonym_word"):
        return F.reverse(inputs[-1])
    if template.category in ("or_prompt", "verify_prompt") or template.name == "answers_question":
        together = F.concat_ws(" ", *inputs)
        return F.when(F.length(clean_text(together)) % 2 == 0, "true").otherwise("false")
    if template.name == "sentiment_word":
        return F.get(F.array(F.lit("positive"), F.lit("Negative."), F.lit("neutral")), F.length(inputs[0]) % 3)
    return F.concat(F.lit(f"{template.name}: "), F.concat_ws(" | ", *inputs))


def token_counts(text: Column) -> Column:
    """Counts of tokens in sixteen buckets: whole numbers, so that dot products are exact."""

    def count(codes: Column) -> Column:
        return F.transform(
            # The codes that go with a bucket are counted without a condition evaluated for each.
            F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: (F.size(codes) - F.size(F.array_remove(codes, b))).cast("float")
        )

    return let(F.transform(tokens(text), lambda t: (F.ascii(t) * 7 + F.length(t)) % BUCKETS), count)


MODEL = ColumnModel("double-a", model_rule)
HELPER = ColumnModel("double-helper", helper_rule)
ENCODER = ColumnEncoder(token_counts)


def second_rule(template: Template, inputs: list[Column]) -> Column:
    """Another model under test: as the first, but it answers in capitals."""
    return F.upper(model_rule(template, inputs))


SECOND_MODEL = ColumnModel("double-b", second_rule)
