"""Sentence boundaries learnt from a corpus without labels, after Kiss and Strunk (Computational Linguistics 32:4, 2006).

Counting. Which words are so much more often followed by a full stop than others that the stop must belong to them
(abbreviations); which words follow stops more often than chance would have it (starters); which pairs stay together across
the stop of an abbreviation (collocations); which words are capitalised behind stops only (openers). All of it is counted
with partial aggregation; what decides are log-likelihood ratios of the counts.

Splitting. A second pass looks at every stop of a text with its two neighbours. It needs words that make up at least
``least_share`` of all stops, so a model has at most 1 / least_share words of each kind, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WHITE
from ..session import work_folder

#: Fixed values of the paper: chance of a stop behind an abbreviation; least scores of abbreviations, starters and collocations.
STOP_CHANCE, ABBREVIATION, STARTER, COLLOCATION = 0.99, 0.3, 30.0, 7.88
LEADING, TRAILING = r"\A[^\p{L}\p{N}]+", r"[^\p{L}\p{N}.!?]+\z"
_LEADING, _TRAILING, _TOKEN = regex.compile(LEADING), regex.compile(TRAILING.replace(r"\z", r"\Z")), regex.compile(r"\S+")


def _bare(token: Column) -> Column:
    """A token without quotes, brackets and commas around it; stops at its end stay."""
    return F.regexp_replace(F.regexp_replace(token, LEADING, ""), TRAILING, "")


def _word(bare: Column) -> Column:
    """The word of a bare token: lower case, and without its last stop."""
    return F.lower(F.regexp_replace(bare, r"[.!?]\z", ""))


def _log_likelihood(p: Column, k: Column, n: Column) -> Column:
    """Of k successes in n tries; 0 * log 0 is 0."""
    part = lambda times, chance: F.when(times == 0, F.lit(0.0)).otherwise(times * F.ln(chance))
    return part(k, p) + part(n - k, 1 - p)


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events that occur a and b times among n, and together as often as ``both`` says."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return 2 * (_log_likelihood(p1, both, a) + _log_likelihood(p2, b - both, n - a) - _log_likelihood(p, both, a) - _log_likelihood(p, b - both, n - a))


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset[str]
    starters: frozenset[str]
    openers: frozenset[str]
    collocations: frozenset[tuple[str, str]]

    def fingerprint(self) -> str:
        return hashlib.sha256(repr([sorted(x) for x in (self.abbreviations, self.starters, self.openers, self.collocations)]).encode()).hexdigest()

    def ends(self, bare: str, following: str) -> bool:
        """Whether a sentence ends with a bare token that ends in a stop, given the token behind it."""
        if bare[-1] != ".":
            return True
        word, next_ = bare[:-1].lower(), _TRAILING.sub("", _LEADING.sub("", following))
        second = (next_[:-1] if next_[-1:] in (".", "!", "?") else next_).lower()
        capital = next_[:1].isupper()
        if word.endswith(".") and not any(c.isalnum() for c in word) or len(word) == 1 and word.isalpha() or word in self.abbreviations:
            return capital and (word, second) not in self.collocations and (second in self.openers or second in self.starters)
        if word.isdigit():
            return not next_[:1].islower() and (word, second) not in self.collocations
        return True

    def split(self, text: str) -> list[str]:
        """The sentences of a text, without the white space around them."""
        found, start, last = [], None, None
        for m in _TOKEN.finditer(text):
            if last is not None:
                bare = _TRAILING.sub("", text[last[0] : last[1]])
                if bare[-1:] in (".", "!", "?") and bare and self.ends(_LEADING.sub("", bare) or bare, m.group()):
                    found.append(text[start : last[1]])
                    start = m.start()
            start = m.start() if start is None else start
            last = m.span()
        return [*found, text[start : last[1]]] if last else found

    def sentences(self, text: Column) -> Column:
        """As ``functions.text.sentences``, for use in its place; a null text gives null."""
        model = self

        @F.arrow_udf("array<string>")
        def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield pa.array([None if t is None else model.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))

        return split(text)


def _kept(df: DataFrame, name: str) -> DataFrame:
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def sentence_statistics(texts: DataFrame, column: str = "text", least_share: float = 1e-5) -> DataFrame:
    """(kind, word, next, n, score): what a model is made of. ``next`` is null except for collocations."""
    tokens = F.filter(F.split(F.col(column), f"{WHITE}+"), lambda t: t != "")
    rows = texts.select(F.posexplode_outer(F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))).alias("b"))).alias("pos", "t"))
    rows = rows.where("pos IS NOT NULL").select((F.col("pos") == 0).alias("first"), "t.a", "t.b")
    # Tokens as they stand and their neighbours behind stops; whatever is worked out per token is worked out on these.
    ends = F.col("a").rlike(r"[.!?][^\p{L}\p{N}.!?]*\z")
    raw = _kept(rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("n_first")), "tokens")
    pairs = _kept(rows.where(ends & F.col("b").isNotNull()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "stops")

    bare = raw.withColumn("bare", _bare(F.col("a"))).withColumn("word", _word(F.col("bare"))).where("word RLIKE '[\\\\p{L}\\\\p{N}]'")
    upper = F.col("bare").rlike(r"\A\p{Lu}")
    types = _kept(
        bare.groupBy("word").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.endswith("bare", F.lit(".")), F.col("n")).otherwise(0)).alias("n_stop"),
            F.sum(F.when(upper, F.col("n") - F.col("n_first")).otherwise(0)).alias("n_upper"),
            F.sum(F.when(F.col("bare").rlike(r"\A\p{Ll}"), F.col("n")).otherwise(0)).alias("n_lower"),
        ),
        "types",
    )
    n, stops = types.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_stop"), F.lit(0))).first()
    least = max(2, math.ceil(stops * least_share))
    total = F.lit(float(n))

    size, dots = F.length(F.replace("word", F.lit("."), F.lit(""))), F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    without = (F.col("n") - F.col("n_stop")).cast("double")
    ratio = 2 * (_log_likelihood(F.lit(STOP_CHANCE), F.col("n_stop"), F.col("n")) - _log_likelihood(F.lit(stops / max(n, 1)), F.col("n_stop"), F.col("n")))
    score = ratio * F.exp(-size.cast("double")) * (dots + 1) * F.exp(-without * F.ln(size.cast("double")))
    abbreviations = types.where((F.col("n_stop") >= least) & F.col("word").rlike(r"\p{L}")).select("word", "n", score.alias("score")).where(F.col("score") >= ABBREVIATION)

    after = pairs.withColumns({"bare_a": _bare(F.col("a")), "bare_b": _bare(F.col("b"))})
    after = after.select(
        _word(F.col("bare_a")).alias("word"), _word(F.col("bare_b")).alias("next"), F.endswith("bare_a", F.lit(".")).alias("stop"),
        F.col("bare_b").rlike(r"\A\p{Lu}").alias("upper"), "n",
    ).where("next RLIKE '[\\\\p{L}\\\\p{N}]'")
    marked = after.join(abbreviations.select("word", F.lit(True).alias("short")), "word", "left")
    short = F.col("stop") & (F.coalesce("short", F.lit(False)) | (F.length("word") == 1))
    marked = _kept(marked.withColumn("short", short), "after-stops")

    sure = marked.where("NOT short")
    n_ends = F.lit(float(sure.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    known = types.select(F.col("word").alias("next"), F.col("n").alias("b"), "n_upper", "n_lower")
    started = sure.groupBy("next").agg(F.sum("n").alias("n")).where(F.col("n") >= least).join(known, "next")
    over = lambda a: F.col("n") * total > a * F.col("b")
    starters = started.where(over(n_ends) & (F.col("b") < total)).select(F.col("next").alias("word"), "n", association(n_ends, F.col("b"), F.col("n"), total).alias("score"))
    starters = starters.where(F.col("score") >= STARTER)

    held = marked.where("short OR (stop AND word RLIKE '^[0-9]+$')").groupBy("word", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    held = held.join(known, "next").join(types.select("word", F.col("n_stop").alias("a")), "word").join(starters.select(F.col("word").alias("next")), "next", "left_anti")
    together = held.where(over(F.col("a")) & (F.col("b") < total)).select("word", "next", "n", association(F.col("a"), F.col("b"), F.col("n"), total).alias("score"))
    collocations = together.where(F.col("score") >= COLLOCATION)

    opened = marked.where("upper").groupBy("next").agg(F.sum("n").alias("n")).where(F.col("n") >= least).join(known, "next")
    openers = opened.where((F.col("n_lower") > 0) & (F.col("n_upper") == F.col("n"))).select(F.col("next").alias("word"), "n", F.col("n_lower").cast("double").alias("score"))

    nothing = F.lit(None).cast("string").alias("next")
    named = lambda df, kind, next_=nothing: df.select(F.lit(kind).alias("kind"), "word", next_, "n", "score")
    return (
        named(abbreviations, "abbreviation").union(named(starters, "starter"))
        .union(named(collocations, "collocation", F.col("next"))).union(named(openers, "opener"))
    )


def train_sentences(texts: DataFrame, column: str = "text", least_share: float = 1e-5) -> SentenceModel:
    """Learn from all texts. The driver gets the words of the model, at most 1 / least_share of each kind."""
    words: dict[str, set] = {"abbreviation": set(), "starter": set(), "collocation": set(), "opener": set()}
    for r in sentence_statistics(texts, column, least_share).collect():
        words[r["kind"]].add((r["word"], r["next"]) if r["kind"] == "collocation" else r["word"])
    return SentenceModel(*(frozenset(words[k]) for k in ("abbreviation", "starter", "opener", "collocation")))
