"""From raw data sets to task inputs: ``(row_id, inputs, label)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw, draw_keys, let, seed_for
from .sampling import seeded_sample

DATA_SEED = 42


def as_inputs(value: Column) -> Column:
    """A bare text is a row of one input."""
    return F.array(value)


def check_arity(df: DataFrame, arity: int) -> DataFrame:
    """Fail on a row with the wrong number of inputs instead of reading past its end later."""
    message = F.concat(F.lit(f"expected {arity} inputs, row has "), F.size("inputs").cast("string"))
    checked = F.when(F.size("inputs") == arity, F.col("inputs")).otherwise(F.raise_error(message).cast("array<string>"))
    return df.withColumn("inputs", checked)


# Question answering: (row_id, context, question, answers.text)


def question_answering(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    return seeded_sample(raw, "row_id", size, seed).select("row_id", F.array("context", "question").alias("inputs"))


def question_answering_labelled(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    """The first answer is the label; a question without answers is "unknown"."""
    label = F.coalesce(F.get("answers.text", F.lit(0)), F.lit("unknown"))
    return seeded_sample(raw, "row_id", size, seed).select(
        "row_id", F.array("context", "question").alias("inputs"), label.alias("label")
    )


# Inference: (row_id, premise, hypothesis, label)


def inference(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    return inference_labelled(raw, size, seed).drop("label")


def inference_labelled(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    return seeded_sample(raw, "row_id", size, seed).select(
        "row_id", F.array("premise", "hypothesis").alias("inputs"), F.col("label").cast("string").alias("label")
    )


# Sentiment: (row_id, sentence, label)


def sentiment(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    return sentiment_labelled(raw, size, seed).drop("label")


def sentiment_labelled(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    return seeded_sample(raw, "row_id", size, seed).select(
        "row_id", as_inputs(F.col("sentence")).alias("inputs"), F.col("label").cast("string").alias("label")
    )


# Relation extraction: (row_id, sents, vertexSet, labels)


def join_tokens(sents: Column) -> Column:
    return F.array_join(F.flatten(sents), " ")


def join_tokens_cleaned(sents: Column) -> Column:
    """Tokens by spaces, without white space before , . ! ? ; and :"""
    return F.regexp_replace(join_tokens(sents), r"\s+([,.!?;:])", "$1")


def all_names(vertex_set: Column) -> Column:
    return F.flatten(F.transform(vertex_set, lambda v: F.transform(v, lambda m: m["name"])))


def first_names(vertex_set: Column) -> Column:
    return F.transform(vertex_set, lambda v: F.get(v, F.lit(0))["name"])


def _random_mention(mentions: Column, place: Column, row: Column, seed: int) -> Column:
    """The name of a mention of the entity at a place."""
    return F.get(mentions, (draw(row, place + 1, seed) % F.greatest(F.size(mentions), F.lit(1))).cast("int"))["name"]


def random_names(vertex_set: Column, row: Column, seed: int) -> Column:
    """One mention per entity; the entity's place takes part in the draw."""
    return F.transform(vertex_set, lambda v, i: _random_mention(v, i, row, seed))


def random_name(vertex_set: Column, place: Column, row: Column, seed: int) -> Column:
    """The name that ``random_names`` has at a place, without those of the other entities."""
    return _random_mention(F.get(vertex_set, place), place, row, seed)


def random_pair(names: Column, row: Column, seed: int) -> Column:
    """Two different places of the list, in random order; null for a list of fewer than two.

    The two smallest of one draw per place: no list of all pairs is made.
    """

    def pairs(bound: Column) -> Column:
        return F.zip_with(draw_keys(bound, row, seed), bound, lambda k, x: F.struct(k.alias("k"), x.alias("x")))

    def with_first(drawn: Column) -> Column:
        return F.struct(drawn.alias("drawn"), F.array_min(drawn).alias("first"))

    def choose(b: Column) -> Column:
        second = F.array_min(F.filter(b["drawn"], lambda p: p["k"] > b["first"]["k"]))
        return F.when(F.size(b["drawn"]) >= 2, F.array(b["first"]["x"], second["x"]))

    return let(let(let(names, pairs), with_first), choose)


def random_relation(labels: Column, row: Column, seed: int) -> Column:
    # Optimised plans may evaluate this before the filter on empty lists: never divide by zero.
    return let(labels, lambda b: F.get(b, (draw(row, F.lit(1), seed) % F.greatest(F.size(b), F.lit(1))).cast("int")))


def entity_pairs(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    """Text with a random pair of entities, by their first names."""
    pair = random_pair(first_names(F.col("vertexSet")), F.col("row_id"), seed_for(seed, salt=1))
    return (
        seeded_sample(raw, "row_id", size, seed)
        .select("row_id", join_tokens_cleaned(F.col("sents")).alias("_text"), pair.alias("_pair"))
        .select("row_id", F.array("_text", F.get("_pair", F.lit(0)), F.get("_pair", F.lit(1))).alias("inputs"))
    )


def _labelled_relation(viable: DataFrame, seed: int) -> DataFrame:
    relation = random_relation(F.col("labels"), F.col("row_id"), seed_for(seed, salt=3))
    chosen = viable.select("row_id", join_tokens_cleaned(F.col("sents")).alias("_text"), "vertexSet", relation.alias("_r"))
    name = lambda place: random_name(F.col("vertexSet"), F.col(f"_r.{place}"), F.col("row_id"), seed_for(seed, salt=2))
    return chosen.select("row_id", F.array("_text", name("h"), name("t")).alias("inputs"), F.col("_r.r").alias("code"))


def viable_relations(raw: DataFrame) -> DataFrame:
    """Rows without any labelled relation cannot be used."""
    return raw.where(F.size("labels") > 0)


def relation_extraction(raw: DataFrame, size: int | None = None, seed: int = DATA_SEED) -> DataFrame:
    """Text, head and tail of a random labelled relation."""
    return _labelled_relation(seeded_sample(viable_relations(raw), "row_id", size, seed), seed).select("row_id", "inputs")


def relation_extraction_labelled(
    raw: DataFrame, names: DataFrame, size: int | None = None, seed: int = DATA_SEED
) -> DataFrame:
    """As above with the relation's name from a table (code, name); an unknown code gives a null label."""
    rows = _labelled_relation(seeded_sample(viable_relations(raw), "row_id", size, seed), seed)
    # No broadcast hint: Catalyst broadcasts the table of names where its size allows.
    return rows.join(names, "code", "left").select("row_id", "inputs", F.col("name").alias("label"))
