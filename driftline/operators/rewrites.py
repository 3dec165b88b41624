"""Input transformations that ask a helper model.

Every function takes rows with ``row_id`` and ``inputs`` and adds one column, an array of variants, each an
array of inputs. Helper questions go through ``ask``; with a ``ColumnModel`` helper they are
expressions, with a ``BatchModel`` they are distributed calls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw, let, seed_for
from ..functions.text import clean_text, join_inputs, parse_keywords, rows_of, strip
from ..functions.text import sentences as by_rule
from ..plans.templates import Template, template
from .model_calls import AnswerStore, ColumnModel, Model, ask
from .pools import Pool, next_prime


@dataclass(frozen=True)
class Edit:
    """What a transformation needs to know about its place in a run."""

    helper: Model | None = None
    words: Pool | None = None
    sentences: Pool | None = None
    store: AnswerStore | None = None
    relation: int = 0
    seed: int = 42
    indices: tuple[tuple[int, ...], ...] = ((0,),)
    arity: int = 1
    out: str = "variants"
    #: How texts are cut into sentences: by rule, or by a trained model's ``sentences``.
    split: Callable[[Column], Column] = by_rule
    extra: dict = field(default_factory=dict)

    def seed_at(self, index: int, salt: int = 0) -> int:
        return seed_for(self.seed, self.relation, index, salt)


ROW = "row_id"
#: What is added to a row's number for each further round of draws.
ROUND_STEP = 7_368_787


def input_at(index: int) -> Column:
    return F.get("inputs", F.lit(index))


def splice(new_values: dict[int, Column], index_sets: tuple[tuple[int, ...], ...]) -> Column:
    """One variant per index set; an input changed in several variants is computed once and shared."""

    def variant(chosen: tuple[int, ...]) -> Column:
        def place(value: Column, position: Column) -> Column:
            return reduce(lambda acc, i: F.when(position == i, new_values[i]).otherwise(acc), chosen, value)

        return F.transform("inputs", place)

    return F.array(*[variant(s) for s in index_sets])


def changed_indices(edit: Edit) -> list[int]:
    return sorted({i for s in edit.indices for i in s})


def _finish(df: DataFrame, new_columns: dict[int, str], edit: Edit) -> DataFrame:
    df = df.withColumn(edit.out, splice({i: F.col(c) for i, c in new_columns.items()}, edit.indices))
    return df.drop(*new_columns.values())


def _ask(df: DataFrame, edit: Edit, key: str, inputs: list[Column], out: str, when: Column | None = None) -> DataFrame:
    return ask(df, edit.helper, template(key), inputs, out, "helper", when, edit.store)


def _prompt_inputs(prompt: Template, index: int, edit: Edit) -> list[Column]:
    """The whole row for a multi-input prompt, otherwise only the input that is being changed."""
    return [input_at(i) for i in range(edit.arity)] if prompt.multi_input else [input_at(index)]


# Rewriting a text, a sentence at a time, or adding to it


def join_whole(parts: Column, separator: str) -> Column:
    """Joined parts; null if one of them is missing, as a text that lacks a part is another text."""
    return let(parts, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.array_join(p, separator)))


def rewrite(df: DataFrame, edit: Edit, key: str) -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = _ask(df, edit, key, _prompt_inputs(template(key), index, edit), new[index])
    return _finish(df, new, edit)


def _per_sentence(df: DataFrame, edit: Edit, key: str, text: Column, more: list[Column], out: str) -> DataFrame:
    """Ask about every sentence of a text and join the answers by spaces.

    A rule is mapped over the array. Otherwise the sentences become rows, are asked once each, and come
    back in order; a row's group is its own sentences only.
    """
    if isinstance(edit.helper, ColumnModel):
        bound = F.struct(edit.split(text).alias("s"), *[m.alias(f"m{i}") for i, m in enumerate(more)])
        answers = let(
            bound,
            lambda b: F.transform(
                b["s"], lambda s: edit.helper.rule(template(key), [s, *[b[f"m{i}"] for i in range(len(more))]])
            ),
        )
        return df.withColumn(out, join_whole(answers, " "))
    df = df.withColumn("_more", F.array(*more).cast("array<string>"))
    rows = df.select(ROW, "_more", rows_of(edit.split(text)).alias("_pos", "_sentence")).where("_pos IS NOT NULL")
    question = [F.col("_sentence"), *[F.get("_more", F.lit(i)) for i in range(len(more))]]
    answered = _ask(rows, edit, key, question, "_answer")
    joined = (
        answered.groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_answer"))).alias("_a"))
        .select(ROW, F.transform("_a", lambda a: a["_answer"]).alias("_parts"))
    )
    known = F.when(text.isNotNull() & F.forall(F.array(*more), lambda m: m.isNotNull()), F.coalesce("_parts", F.array())) if more else F.when(text.isNotNull(), F.coalesce("_parts", F.array()))
    return df.join(joined, ROW, "left").withColumn(out, join_whole(known, " ")).drop("_more", "_parts")


def rewrite_sentences(df: DataFrame, edit: Edit, key: str) -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = _per_sentence(df, edit, key, input_at(index), [], new[index])
    return _finish(df, new, edit)


def append_generated(df: DataFrame, edit: Edit, key: str) -> DataFrame:
    """Generated text behind the first listed input; one variant."""
    index = edit.indices[0][0]
    df = _ask(df, edit, key, _prompt_inputs(template(key), index, edit), "_generated")
    longer = F.concat(input_at(index), F.lit(" "), F.col("_generated"))
    return df.withColumn(edit.out, splice({index: longer}, ((index,),))).drop("_generated")


def back_translate(df: DataFrame, edit: Edit, to: str = "helper:to_german") -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = _ask(df, edit, to, [input_at(index)], "_foreign")
        df = _ask(df, edit, "helper:to_english", [F.col("_foreign")], new[index]).drop("_foreign")
    return _finish(df, new, edit)


def _open_end(dotted: Column, closed: Column) -> Column:
    """The last sentence loses its full stop again where the text does not end with one."""
    count = F.size(dotted)
    last = F.rtrim(F.get(dotted, count - 1), F.lit("."))
    return F.when(closed | (count == 0), dotted).otherwise(F.concat(F.slice(dotted, F.lit(1), count - 1), F.array(last)))


MOODS = ("positive", "negative", "neutral")


def _sentences_of_mood(mood: str) -> Column:
    return F.array_join(F.transform(F.filter("_pairs", lambda p: p["mood"] == mood), lambda p: p["s"]), " ")


def group_by_sentiment(df: DataFrame, edit: Edit) -> DataFrame:
    """Sentences (cut at full stops) in the order positive, negative, neutral; repeated ones stay once.

    With a sentence of no known mood (another word, or a call that failed) the text can't be grouped and is null.
    """
    new = {}
    for index in changed_indices(edit):
        text = input_at(index)
        raw = F.filter(F.split(text, r"\."), lambda s: s != "")
        dotted = F.transform(raw, lambda s: F.concat(strip(s), F.lit(".")))
        distinct = F.array_distinct(let(dotted, lambda d: _open_end(d, F.endswith(text, F.lit(".")))))
        new[index] = f"_{edit.out}_{index}"
        if isinstance(edit.helper, ColumnModel):
            rule = template("helper:sentiment_word")
            pairs = F.transform(
                distinct, lambda s: F.struct(clean_text(edit.helper.rule(rule, [s])).alias("mood"), s.alias("s"))
            )
            df = df.withColumn("_pairs", pairs)
        else:
            rows = df.select(ROW, rows_of(distinct).alias("_pos", "_s")).where("_pos IS NOT NULL")
            rows = _ask(rows, edit, "helper:sentiment_word", [F.col("_s")], "_mood")
            mood = clean_text(F.col("_mood"))
            pairs = (
                rows.groupBy(ROW)
                .agg(F.sort_array(F.collect_list(F.struct("_pos", mood.alias("mood"), F.col("_s").alias("s")))).alias("_p"))
                .select(ROW, F.transform("_p", lambda p: F.struct(p["mood"].alias("mood"), p["s"].alias("s"))).alias("_pairs"))
            )
            df = df.join(pairs, ROW, "left")
        groups = [_sentences_of_mood(m) for m in MOODS]
        parts = F.filter(F.array(*groups), lambda g: g != "")
        told = F.forall("_pairs", lambda p: F.coalesce(p["mood"].isin(*MOODS), F.lit(False)))
        grouped = F.when(F.col("_pairs").isNull(), "").when(told, F.array_join(parts, " "))
        df = df.withColumn(new[index], F.when(text.isNotNull(), grouped)).drop("_pairs")
    return _finish(df, new, edit)


# Keywords


def shared_keywords(index: int) -> str:
    return f"_keywords_{index}"


ENTITY_KEYWORDS = "_entity_keywords"


def keywords(df: DataFrame, edit: Edit, text: Column, out: str, index: int | None = None) -> DataFrame:
    """Keywords of a text. Several relations ask for those of the same input (``index``): a column that
    ``with_shared_keywords`` has added is used instead of asking again."""
    if index is not None and shared_keywords(index) in df.columns:
        return df.withColumn(out, F.col(shared_keywords(index)))
    df = _ask(df, edit, "helper:keywords", [text], "_found")
    return df.withColumn(out, parse_keywords(F.col("_found"))).drop("_found")


def entity_keywords(df: DataFrame, edit: Edit, out: str) -> DataFrame:
    """Keywords tied to the two entities of a row, without the entities themselves. Repeats stay."""
    if ENTITY_KEYWORDS in df.columns:
        return df.withColumn(out, F.col(ENTITY_KEYWORDS))
    df = _ask(df, edit, "helper:entity_keywords", [input_at(0), input_at(1), input_at(2)], "_found")
    entities = F.array(clean_text(input_at(1)), clean_text(input_at(2)))
    kept = let(entities, lambda e: F.filter(parse_keywords(F.col("_found")), lambda k: ~F.array_contains(e, k)))
    return df.withColumn(out, kept).drop("_found")


def with_shared_keywords(df: DataFrame, edit: Edit, uses: list[tuple[str, list[int]]]) -> DataFrame:
    """Add the keyword columns that two or more of the given (transformation, changed inputs) ask for."""
    counts: dict[int, int] = {}
    for name, indices in uses:
        for i in [1] if name in QUESTION_KEYWORDS else indices if name in INPUT_KEYWORDS else []:
            counts[i] = counts.get(i, 0) + 1
    for i, n in counts.items():
        if n > 1:
            df = keywords(df, edit, input_at(i), shared_keywords(i))
    if sum(name in RELATED_KEYWORDS for name, _ in uses) > 1:
        df = entity_keywords(df, edit, ENTITY_KEYWORDS)
    return df


# Which transformations ask for keywords of the changed inputs, of the question, of text and entities.
INPUT_KEYWORDS = {"replace_synonym", "replace_antonym", "replace_random", "remove_keywords"}
QUESTION_KEYWORDS = {"replace_category_qa", "replace_antonym_qa", "replace_random_qa", "remove_keywords_qa"}
RELATED_KEYWORDS = {"replace_antonym_re", "replace_random_re", "remove_keywords_re"}


def _word_for_word(df: DataFrame, edit: Edit, key: str, kws: str, context: Column | None, out: str) -> DataFrame:
    """Ask for a partner of every keyword; cleaned, in the order of the keywords."""
    if isinstance(edit.helper, ColumnModel):
        prompt = template(key)
        return df.withColumn(
            out,
            F.transform(kws, lambda k: clean_text(edit.helper.rule(prompt, [k] if context is None else [context, k]))),
        )
    shown = F.lit(None).cast("string") if context is None else context
    rows = df.select(ROW, shown.alias("_context"), rows_of(kws).alias("_pos", "_kw")).where("_pos IS NOT NULL")
    question = [F.col("_kw")] if context is None else [F.col("_context"), F.col("_kw")]
    answered = _ask(rows, edit, key, question, "_word")
    gathered = (
        answered.groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", clean_text(F.col("_word")).alias("w")))).alias("_w"))
        .select(ROW, F.transform("_w", lambda w: w["w"]).alias(out))
    )
    # Without keywords there is nothing to ask; without an answer about the keywords nothing is known.
    none = F.when(F.col(kws).isNotNull(), F.array().cast("array<string>"))
    return df.join(gathered, ROW, "left").withColumn(out, F.coalesce(out, none))


def rules_text(words_from: Column, words_to: Column) -> Column:
    """One rule per line; null if a keyword lacks its partner, as a rule must not go unnoticed."""
    return join_whole(F.zip_with(words_from, words_to, lambda a, b: F.concat(a, F.lit(" -> "), b)), "\n")


def _replace(df: DataFrame, edit: Edit, text: Column, words_from: str, words_to: str, out: str) -> DataFrame:
    return _ask(df, edit, "helper:apply_rules", [text, rules_text(F.col(words_from), F.col(words_to))], out)


def replace_category(df: DataFrame, edit: Edit) -> DataFrame:
    """Keywords of all inputs together, replaced in every input; one variant."""
    only = 0 if edit.arity == 1 else None
    return _category(keywords(df, edit, join_inputs(F.col("inputs"), "\n\n"), "_kw", only), edit)


def replace_category_qa(df: DataFrame, edit: Edit) -> DataFrame:
    """Keywords of the question, replaced in both inputs."""
    return _category(keywords(df, edit, input_at(1), "_kw", 1), edit)


def _category(df: DataFrame, edit: Edit) -> DataFrame:
    df = _word_for_word(df, edit, "helper:category_word", "_kw", None, "_to")
    new = [f"_{edit.out}_{i}" for i in range(edit.arity)]
    for index, column in enumerate(new):
        df = _replace(df, edit, input_at(index), "_kw", "_to", column)
    return df.withColumn(edit.out, F.array(F.array(*new))).drop("_kw", "_to", *new)


def replace_category_re(df: DataFrame, edit: Edit) -> DataFrame:
    """The two entities are the keywords; text and entities all change."""
    df = df.withColumn("_kw", F.array(clean_text(input_at(1)), clean_text(input_at(2))))
    df = _word_for_word(df, edit, "helper:category_word", "_kw", None, "_to")
    df = _replace(df, edit, input_at(0), "_kw", "_to", "_text")
    variant = F.array(F.col("_text"), F.get("_to", F.lit(0)), F.get("_to", F.lit(1)))
    return df.withColumn(edit.out, F.array(variant)).drop("_kw", "_to", "_text")


def _replace_in_context(df: DataFrame, edit: Edit, key: str) -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = keywords(df, edit, input_at(index), "_kw", index)
        df = _word_for_word(df, edit, key, "_kw", input_at(index), "_to")
        df = _replace(df, edit, input_at(index), "_kw", "_to", new[index]).drop("_kw", "_to")
    return _finish(df, new, edit)


def replace_synonym(df: DataFrame, edit: Edit) -> DataFrame:
    return _replace_in_context(df, edit, "helper:synonym_word")


def replace_antonym(df: DataFrame, edit: Edit) -> DataFrame:
    return _replace_in_context(df, edit, "helper:antonym_word")


def replace_antonym_qa(df: DataFrame, edit: Edit) -> DataFrame:
    """Question keywords; context or question changes, not both."""
    df = keywords(df, edit, input_at(1), "_kw", 1)
    df = _word_for_word(df, edit, "helper:antonym_word", "_kw", input_at(1), "_to")
    df = _replace(df, edit, input_at(0), "_kw", "_to", "_c")
    df = _replace(df, edit, input_at(1), "_kw", "_to", "_q")
    variants = F.array(F.array(F.col("_c"), input_at(1)), F.array(input_at(0), F.col("_q")))
    return df.withColumn(edit.out, variants).drop("_kw", "_to", "_c", "_q")


def replace_antonym_re(df: DataFrame, edit: Edit) -> DataFrame:
    df = entity_keywords(df, edit, "_kw")
    df = _word_for_word(df, edit, "helper:antonym_word", "_kw", input_at(0), "_to")
    df = _replace(df, edit, input_at(0), "_kw", "_to", "_text")
    variant = F.array(F.col("_text"), input_at(1), input_at(2))
    return df.withColumn(edit.out, F.array(variant)).drop("_kw", "_to", "_text")


def distinct_indices(row: Column, count: Column, size: int, seed: int) -> Column:
    """``count`` different numbers below ``size`` (all of them when it is smaller).

    A start and a step walk round a prime that is at least ``size``; numbers from ``size`` on are left
    out. No number of one walk comes twice.
    """
    prime = next_prime(size)

    def walk(pair: Column) -> Column:
        steps = F.sequence(F.lit(0), count + F.lit(prime - size))
        numbers = F.transform(
            steps, lambda j: (pair["start"] + j.cast("bigint") * pair["step"]) % F.lit(prime)
        )
        return F.slice(F.filter(numbers, lambda x: x < size), F.lit(1), count)

    start = (draw(row, F.lit(1), seed) % prime).alias("start")
    step = (draw(row, F.lit(2), seed) % max(prime - 1, 1) + 1).alias("step")
    return let(F.struct(start, step), walk)


def _random_partners(df: DataFrame, edit: Edit, kws: str, index: int, salt: int, out: str) -> DataFrame:
    """A word for each keyword. No word comes twice before all have come; then the next round begins, in another order."""
    size, seed = edit.words.size, edit.seed_at(index, salt)

    def round_(n: Column) -> Column:
        return distinct_indices(F.col(ROW).cast("bigint") + n * ROUND_STEP, F.least(F.size(kws) - n * size, F.lit(size)).cast("int"), size, seed)

    rounds = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(kws) - 1) / size).cast("int")), round_))
    picked = F.when(F.size(kws) > size, rounds).otherwise(distinct_indices(F.col(ROW), F.size(kws), size, seed))
    return edit.words.pick_many(df, picked, out, ROW)


def replace_random(df: DataFrame, edit: Edit) -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = keywords(df, edit, input_at(index), "_kw", index)
        df = _random_partners(df, edit, "_kw", index, 1, "_to")
        df = _replace(df, edit, input_at(index), "_kw", "_to", new[index]).drop("_kw", "_to")
    return _finish(df, new, edit)


def _three_ways(context: str, question: str) -> Column:
    c, q = F.col(context), F.col(question)
    return F.array(F.array(c, input_at(1)), F.array(input_at(0), q), F.array(c, q))


def replace_random_qa(df: DataFrame, edit: Edit) -> DataFrame:
    """Question keywords, separate words for context and question; context, question, both."""
    df = keywords(df, edit, input_at(1), "_kw", 1)
    df = _random_partners(df, edit, "_kw", 0, 1, "_to_c")
    df = _random_partners(df, edit, "_kw", 1, 2, "_to_q")
    df = _replace(df, edit, input_at(0), "_kw", "_to_c", "_c")
    df = _replace(df, edit, input_at(1), "_kw", "_to_q", "_q")
    return df.withColumn(edit.out, _three_ways("_c", "_q")).drop("_kw", "_to_c", "_to_q", "_c", "_q")


def replace_random_re(df: DataFrame, edit: Edit) -> DataFrame:
    df = entity_keywords(df, edit, "_kw")
    df = _random_partners(df, edit, "_kw", 0, 1, "_to")
    df = _replace(df, edit, input_at(0), "_kw", "_to", "_text")
    variant = F.array(F.col("_text"), input_at(1), input_at(2))
    return df.withColumn(edit.out, F.array(variant)).drop("_kw", "_to", "_text")


# Removing keywords: from the whole text or sentence by sentence


def _remove(df: DataFrame, edit: Edit, text: Column, kws: str, out: str, by_sentence: bool) -> DataFrame:
    listed = F.array_join(kws, "\n")
    if by_sentence:
        return _per_sentence(df, edit, "helper:remove_words", text, [listed], out)
    return _ask(df, edit, "helper:remove_words", [text, listed], out)


def remove_keywords(df: DataFrame, edit: Edit, by_sentence: bool = True) -> DataFrame:
    new = {}
    for index in changed_indices(edit):
        new[index] = f"_{edit.out}_{index}"
        df = keywords(df, edit, input_at(index), "_kw", index)
        df = _remove(df, edit, input_at(index), "_kw", new[index], by_sentence).drop("_kw")
    return _finish(df, new, edit)


def remove_keywords_qa(df: DataFrame, edit: Edit, by_sentence: bool = True) -> DataFrame:
    df = keywords(df, edit, input_at(1), "_kw", 1)
    df = _remove(df, edit, input_at(0), "_kw", "_c", by_sentence)
    df = _remove(df, edit, input_at(1), "_kw", "_q", by_sentence)
    return df.withColumn(edit.out, _three_ways("_c", "_q")).drop("_kw", "_c", "_q")


def remove_keywords_re(df: DataFrame, edit: Edit, by_sentence: bool = True) -> DataFrame:
    df = entity_keywords(df, edit, "_kw")
    df = _remove(df, edit, input_at(0), "_kw", "_text", by_sentence)
    variant = F.array(F.col("_text"), input_at(1), input_at(2))
    return df.withColumn(edit.out, F.array(variant)).drop("_kw", "_text")


# Negation


def negate(df: DataFrame, edit: Edit) -> DataFrame:
    return rewrite(df, edit, "helper:negate_text")


def negate_qa(df: DataFrame, edit: Edit) -> DataFrame:
    """The context is negated with regard to the question, the question by itself; not both."""
    df = _ask(df, edit, "helper:negate_context", [input_at(0), input_at(1)], "_c")
    df = _ask(df, edit, "helper:negate_text", [input_at(1)], "_q")
    variants = F.array(F.array(F.col("_c"), input_at(1)), F.array(input_at(0), F.col("_q")))
    return df.withColumn(edit.out, variants).drop("_c", "_q")


def negate_re(df: DataFrame, edit: Edit, entity_aware: bool = False) -> DataFrame:
    """Plain negation of the text by default; the prompt that knows the entities is an option."""
    if not entity_aware:
        return negate(df, edit)
    df = _ask(df, edit, "helper:negate_relation", [input_at(0), input_at(1), input_at(2)], "_text")
    variant = F.array(F.col("_text"), input_at(1), input_at(2))
    return df.withColumn(edit.out, F.array(variant)).drop("_text")
