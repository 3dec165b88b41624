"""The names that catalog rows use, and what they stand for. Users add their own with ``register_*``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import relations as R, verifiers as V
from ..functions.text import clean_text
from . import local_edits as L, rewrites as W
from .char_edits import edit_characters
from .rewrites import Edit, input_at

Transform = Callable[[DataFrame, Edit, dict], DataFrame]
ROW = W.ROW

TRANSFORMS: dict[str, Transform] = {}
RELATIONS: dict[str, Callable[..., Column]] = {}
VERIFIERS: dict[str, Callable[..., Column]] = {}

# Transformations that edit characters, with their kind: a run makes those of all its relations in one worker.
CHARACTER_EDITS = {
    "replace_characters": "replace", "delete_characters": "delete", "add_characters": "add", "leet": "leet", "add_spaces": "space",
    "swap_characters": "swap",
}

# Relations that need the encoder's similarity, and functions that need a helper's answer.
NEEDS_KNOWN = {"similar_or_unknown", "not_similar_or_unknown"}
NEEDS_SIMILARITY = {"similar", "not_similar"} | NEEDS_KNOWN
NEEDS_HELPER_JUDGE = {"helper_says_true"}
NEEDS_HELPER_CHECK = {"helper_true", "helper_not_true", "symmetric", "asymmetric"}


def register_transform(name: str, transform: Transform) -> None:
    TRANSFORMS[name] = transform
    CHARACTER_EDITS.pop(name, None)


def register_relation(name: str, relation: Callable[..., Column]) -> None:
    RELATIONS[name] = relation


def register_verifier(name: str, verifier: Callable[..., Column]) -> None:
    VERIFIERS[name] = verifier


def _per_text(edit_text: Callable[[Column, Edit, int, dict], Column]) -> Transform:
    """A transformation of one text, applied to every listed input."""

    def run(df: DataFrame, edit: Edit, params: dict) -> DataFrame:
        new = {i: f"_{edit.out}_{i}" for i in W.changed_indices(edit)}
        df = df.withColumns({c: edit_text(input_at(i), edit, i, params) for i, c in new.items()})
        return W._finish(df, new, edit)

    return run


def _per_text_joined(add: Callable[[DataFrame, Column, Edit, int, str], DataFrame]) -> Transform:
    """As ``_per_text`` for edits that draw from a table."""

    def run(df: DataFrame, edit: Edit, params: dict) -> DataFrame:
        new = {i: f"_{edit.out}_{i}" for i in W.changed_indices(edit)}
        for i, column in new.items():
            df = add(df, input_at(i), edit, i, column)
        return W._finish(df, new, edit)

    return run


def _characters(kind: str) -> Transform:
    return _per_text(lambda t, e, i, p: edit_characters(t, F.col(ROW), kind, e.seed_at(i), e.seed_at(i, 1)))


TRANSFORMS.update(
    {
        "no_change": lambda df, e, p: df.withColumn(e.out, F.array("inputs")),
        "permute": lambda df, e, p: df.withColumn(e.out, F.array(L.permute(F.col("inputs"), json.loads(p["permute_to"])))),
        "upper": _per_text(lambda t, e, i, p: L.upper(t)),
        "exclaim": _per_text(lambda t, e, i, p: L.exclaim(t)),
        "append_constant": _per_text(lambda t, e, i, p: L.append_constant(t, p["addition"])),
        "append_random_sentence": _per_text_joined(
            lambda df, t, e, i, out: L.append_random_sentence(df, t, F.col(ROW), e.seed_at(i), e.sentences, out)
        ),
        "shuffle_sentences": _per_text(lambda t, e, i, p: L.shuffle_sentences(t, F.col(ROW), e.seed_at(i), e.split)),
        "shuffle_words": _per_text(lambda t, e, i, p: L.shuffle_words(t, F.col(ROW), e.seed_at(i))),
        "shuffle_words_in_sentences": _per_text(
            lambda t, e, i, p: L.shuffle_words_in_sentences(t, F.col(ROW), e.seed_at(i), e.split)
        ),
        **{name: _characters(kind) for name, kind in CHARACTER_EDITS.items()},
        "scramble_words": _per_text(lambda t, e, i, p: L.scramble_words(t, F.col(ROW), e.seed_at(i), e.seed_at(i, 1))),
        "scramble_inside_words": _per_text(
            lambda t, e, i, p: L.scramble_inside_words(t, F.col(ROW), e.seed_at(i), e.seed_at(i, 1))
        ),
        "insert_random_words": _per_text_joined(
            lambda df, t, e, i, out: L.insert_random_words(
                df, t, F.col(ROW), e.seed_at(i), e.seed_at(i, 1), e.words, out, ROW
            )
        ),
        "delete_sentences": _per_text(lambda t, e, i, p: L.delete_sentences(t, F.col(ROW), e.seed_at(i), split=e.split)),
        "replace_sentences": _per_text_joined(
            lambda df, t, e, i, out: L.replace_sentences(df, t, F.col(ROW), e.seed_at(i), e.seed_at(i, 1), e.sentences, out, split=e.split)
        ),
        "typos": _per_text(lambda t, e, i, p: L.typos(t, F.col(ROW), p["kind"], e.seed_at(i), e.seed_at(i, 1))),
        "misspell": _per_text_joined(
            lambda df, t, e, i, out: L.misspell(df, t, F.col(ROW), e.seed_at(i), e.extra["dictionary"], out, ROW)
        ),
        "rewrite": lambda df, e, p: W.rewrite(df, e, p["template"]),
        "rewrite_sentences": lambda df, e, p: W.rewrite_sentences(df, e, p["template"]),
        "append_generated": lambda df, e, p: W.append_generated(df, e, p["template"]),
        "back_translate": lambda df, e, p: W.back_translate(df, e, p.get("to", "helper:to_german")),
        "group_by_sentiment": lambda df, e, p: W.group_by_sentiment(df, e),
        "replace_category": lambda df, e, p: W.replace_category(df, e),
        "replace_category_qa": lambda df, e, p: W.replace_category_qa(df, e),
        "replace_category_re": lambda df, e, p: W.replace_category_re(df, e),
        "replace_synonym": lambda df, e, p: W.replace_synonym(df, e),
        "replace_antonym": lambda df, e, p: W.replace_antonym(df, e),
        "replace_antonym_qa": lambda df, e, p: W.replace_antonym_qa(df, e),
        "replace_antonym_re": lambda df, e, p: W.replace_antonym_re(df, e),
        "replace_random": lambda df, e, p: W.replace_random(df, e),
        "replace_random_qa": lambda df, e, p: W.replace_random_qa(df, e),
        "replace_random_re": lambda df, e, p: W.replace_random_re(df, e),
        "remove_keywords": lambda df, e, p: W.remove_keywords(df, e),
        "remove_keywords_qa": lambda df, e, p: W.remove_keywords_qa(df, e),
        "remove_keywords_re": lambda df, e, p: W.remove_keywords_re(df, e),
        "negate": lambda df, e, p: W.negate(df, e),
        "negate_qa": lambda df, e, p: W.negate_qa(df, e),
        "negate_re": lambda df, e, p: W.negate_re(df, e, p.get("entity_aware") == "true"),
    }
)


def _f(params: dict, name: str, default: float) -> float:
    return float(params.get(name, default))


# (source output, follow-up output, similarity, helper's answer, parameters) -> verdict
RELATIONS.update(
    {
        "equivalent": lambda a, b, s, h, p: R.equivalent(a, b),
        "different": lambda a, b, s, h, p: R.different(a, b),
        "inverse": lambda a, b, s, h, p: R.inverse(a, b, p["first"], p["second"]),
        "not_inverse": lambda a, b, s, h, p: R.not_inverse(a, b, p["first"], p["second"]),
        "equivalent_numeric": lambda a, b, s, h, p: R.equivalent_numeric(a, b, _f(p, "error", 0)),
        "different_numeric": lambda a, b, s, h, p: R.different_numeric(a, b, _f(p, "error", 0)),
        "stronger": lambda a, b, s, h, p: R.stronger(a, b, _f(p, "start", 0), _f(p, "end", 1)),
        "same_or_stronger": lambda a, b, s, h, p: R.same_or_stronger(
            a, b, _f(p, "error", 0), _f(p, "start", 0), _f(p, "end", 1)
        ),
        "similar": lambda a, b, s, h, p: R.similar(a, b, s, _f(p, "threshold", 0.6)),
        "not_similar": lambda a, b, s, h, p: R.not_similar(a, b, s, _f(p, "threshold", 0.6)),
        "similar_or_unknown": lambda a, b, s, h, p: R.similar(a, b, s, _f(p, "threshold", 0.6)),
        "not_similar_or_unknown": lambda a, b, s, h, p: R.not_similar(a, b, s, _f(p, "threshold", 0.6)),
        "helper_says_true": lambda a, b, s, h, p: R.says_true(h),
    }
)


def _symmetric(text: Column, answer: Column) -> Column:
    """ "no relation" holds both ways without a question."""
    return (clean_text(text) == "no relation") | R.says_true(answer)


# (text, helper's answer, parameters) -> gate
VERIFIERS.update(
    {
        "equals": lambda t, h, p: V.equals(t, p["value"]),
        "differs": lambda t, h, p: V.differs(t, p["value"]),
        "is_in": lambda t, h, p: V.is_in(t, json.loads(p["values"])),
        "in_set_of": lambda t, h, p: V.in_set_of(t, p["value"]),
        "not_in_set_of": lambda t, h, p: V.not_in_set_of(t, p["value"]),
        "equals_number": lambda t, h, p: V.equals_number(t, float(p["value"]), _f(p, "error", 0)),
        "differs_from_number": lambda t, h, p: V.differs_from_number(t, float(p["value"]), _f(p, "error", 0)),
        "in_range": lambda t, h, p: V.in_range(t, float(p["start"]), float(p["end"])),
        "out_of_range": lambda t, h, p: V.out_of_range(t, float(p["start"]), float(p["end"])),
        "has_sentences": lambda t, h, p: V.has_sentences(t, int(p.get("minimum", 2))),
        "always": lambda t, h, p: V.always(t),
        "helper_true": lambda t, h, p: R.says_true(h),
        "helper_not_true": lambda t, h, p: ~R.says_true(h),
        "symmetric": lambda t, h, p: _symmetric(t, h),
        "asymmetric": lambda t, h, p: ~_symmetric(t, h),
    }
)


def differs_at_gate(variants: Column, params: dict) -> Column:
    return V.differs_at(variants, params["value"], int(params["index"]))


def helper_check_needed(fn: str, text: Column) -> Column:
    """Which rows a helper check is asked about: "no relation" decides symmetry by itself."""
    if fn in ("symmetric", "asymmetric"):
        return F.coalesce(clean_text(text) != "no relation", F.lit(False))
    return text.isNotNull()
