"""Secret scans, in DataFrame operations only: fixed patterns, and two character Markov models for what they miss.

One model is trained on random strings, one on ordinary identifiers, both from labelled samples; a candidate string is a
secret where the log-likelihood ratio of the two says so. The models are tables of 67 x 67 character pairs, whatever the
size of the corpus, so they travel as a constant of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions.draws import let

from .common import whole

#: The base patterns and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # of the runs AKIA[A-Z0-9]+ those of 20 characters or more
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = "[A-Za-z0-9+/_=-]{4,}"


def running_sums(numbers: Column) -> Column:
    """The sums of an array's first 1, 2, 3, ... numbers.

    An array grows by being copied, so it is done in as many blocks as each block has numbers.
    """

    def within(block: Column) -> Column:
        last = lambda so_far: F.coalesce(F.get(so_far, F.size(so_far) - 1), F.lit(0))
        return F.aggregate(block, F.array().cast("array<int>"), lambda so_far, x: let(so_far, lambda s: F.concat(s, F.array(last(s) + x))))

    def put_together(given: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(given))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(given) - 1, size), lambda at: within(F.slice(given, at + 1, size)))

        def shifted(sums: Column) -> Column:
            ends = within(F.transform(sums, lambda s: F.get(s, F.size(s) - 1)))
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            return F.flatten(F.zip_with(sums, before, lambda s, more: F.transform(s, lambda x: x + more)))

        return F.when(F.size(given) > 0, let(blocks, shifted)).otherwise(F.array().cast("array<int>"))

    return let(numbers, put_together)


def found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """All matches from left to right as (start, kind, end, value); places in code points, the end exclusive.

    What lies between matches tells where they are: the text is split at the pattern and the lengths are added up.
    """
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rank = KINDS.index(kind)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    sizes = F.transform(hits, F.length)
    ends = running_sums(F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(hits)), sizes, lambda gap, size: gap + size))
    lasts = F.zip_with(ends, sizes, lambda end, size: F.struct((end - size).alias("start"), F.lit(rank).alias("kind"), end.alias("end")))
    spans = F.zip_with(lasts, values, lambda s, value: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), value.alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns, by start and then kind. Matches with a value that is too short are dropped."""
    assigned = F.filter(found(text, ASSIGN, "assign", group=2), lambda m: F.length(m["value"]) >= LEAST_ASSIGNED)
    return F.sort_array(F.concat(assigned, found(text, ACCESS, "access"), found(text, HEX, "hex")))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio, in thousandths, of each pair of characters: random against ordinary."""

    ratios: tuple[int, ...]
    #: A random string among so many candidates is expected at least: ln(10,000) in the same unit.
    threshold: int = round(math.log(1e4) * 1000)

    def ratio(self, value: Column) -> Column:
        """The ratio of a whole string. Characters outside the alphabet say nothing."""
        known, n = F.split(F.lit(",".join(map(str, self.ratios))), ",").cast("array<int>"), len(ALPHABET)
        places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

        def score(at: Column) -> Column:
            pairs = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.when((a >= 0) & (b >= 0), F.get(known, a * n + b)))
            return F.aggregate(pairs, F.lit(0), lambda so_far, r: so_far + F.coalesce(r, F.lit(0)))

        return F.when(F.length(value) > 1, let(places, score)).otherwise(0)


def train_markov(samples: DataFrame, smoothing: float = 1.0) -> MarkovModel:
    """Fit both models to samples of (value, is_random). Rows with a null in either are left out.

    An empty class has the uniform model, as smoothing alone is left. What comes to the driver are pair counts:
    2 x 67 x 67 rows at most.
    """
    known = samples.filter(F.col("value").isNotNull() & F.col("is_random").isNotNull() & (F.length("value") > 1))
    pairs = known.select(
        "is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair")
    )
    counts = {(r["is_random"], r["pair"]): r["n"] for r in pairs.groupBy("is_random", "pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
    ratios = []
    for a in ALPHABET:
        totals = {c: sum(counts.get((c, a + b), 0) for b in ALPHABET) for c in (True, False)}
        for b in ALPHABET:
            chance = {c: (counts.get((c, a + b), 0) + smoothing) / (totals[c] + smoothing * len(ALPHABET)) for c in (True, False)}
            ratios.append(round(1000 * math.log(chance[True] / chance[False])))
    return MarkovModel(tuple(ratios))


def labelled_by_patterns(docs: DataFrame, text_col: str = "text", sample_docs: int = 4000) -> DataFrame:
    """Labelled strings from the corpus itself: what the fixed patterns find is random, identifiers beside it are ordinary.

    The sample holds about `sample_docs` documents, chosen by a hash of the text.
    """
    total = max(1, docs.count())
    share = min(1.0, sample_docs / total)
    text = whole(text_col)
    few = docs.select(text.alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    split = few.select(
        F.transform(base_spans(F.col("text")), lambda m: m["value"]).alias("secrets"),
        F.regexp_extract_all(
            F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " "), F.lit(IDENTIFIER), F.lit(0)
        ).alias("names"),
    )
    found = split.select(F.explode_outer("secrets").alias("value"), F.lit(True).alias("is_random")).union(
        split.select(F.explode_outer("names").alias("value"), F.lit(False).alias("is_random"))
    )
    return found.filter("value IS NOT NULL")


def scan_secrets(docs: DataFrame, model: MarkovModel, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Add two columns, arrays of (start, kind, end): the base spans, and all spans with those of the models.

    Sorted by start, then kind (its place in KINDS). A null text counts as empty and has none. The models add a candidate
    only where it touches no base span. Columns of the input stay; those named like the two new ones are replaced.
    """
    text = whole(text_col)
    bare = lambda spans: F.transform(spans, lambda m: F.struct(m["start"], m["kind"], m["end"]))
    with_base = docs.withColumn(base, base_spans(text))
    more = F.filter(found(text, CANDIDATE, "random"), lambda m: model.ratio(m["value"]) > model.threshold)
    free = lambda m: ~F.exists(F.col(base), lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
    return with_base.withColumn(spans, F.sort_array(bare(F.concat(F.col(base), F.filter(more, free))))).withColumn(base, bare(F.col(base)))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, m: F.when(
        m["start"] >= s["at"],
        F.struct(m["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(mask)).alias("out")),
    ).otherwise(F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out")))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda m: F.concat_ws(":", F.get(kinds, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))))
