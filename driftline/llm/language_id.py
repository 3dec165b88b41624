"""Language of documents: multinomial naive Bayes over hashed character n-grams of their words.

Letters count in lower case; whatever is no letter separates words. The n-grams of a word, with the blanks around it, are
hashed to a fixed number of buckets. Training counts buckets for each language, over all given documents, in dense vectors
that are summed in a tree; the matrix of log-probabilities is small and goes to all workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import slices, whole
from .dense import count_parts, tree_sum

#: N-grams of 1 to so many characters.
LONGEST = 4
BITS = 16
BUCKETS = 1 << BITS
#: What is said of texts without a letter.
UNKNOWN = "und"
#: Characters that are hashed at a time, so that long texts need little room besides their own.
WINDOW = 1 << 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point, its letter in lower case, or a blank. Made once in a worker."""
    if not _FOLDED:
        lower = ((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in map(chr, range(0x110000)))
        _FOLDED.append(np.fromiter(map(ord, lower), np.uint32, 0x110000))
    return _FOLDED[0]


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, bucket) of every n-gram of every text, in parts. A text without letters has none."""
    counts = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    letters = np.full(len(raw) + len(texts) + 1 + LONGEST, 32, np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    place = np.arange(len(raw)) + owner + 1
    letters[place] = _folded()[raw]
    text = np.zeros(len(letters), np.int32)
    text[place] = owner
    keep = np.ones(len(letters), bool)
    keep[1:-LONGEST] = (letters[1:-LONGEST] != 32) | (letters[: -LONGEST - 1] != 32)
    letters, text = letters[keep], text[keep]
    n = len(letters) - LONGEST
    blank = letters == 32
    for start in range(0, n, WINDOW):
        stop = min(n, start + WINDOW)
        of = text[start:stop].copy()
        first_blank = blank[start:stop]
        of[first_blank] = text[start + 1 : stop + 1][first_blank]
        code = np.zeros(stop - start, np.uint64)
        inside = np.ones(stop - start, bool)  # no blank between the first and the last character
        for size in range(1, LONGEST + 1):
            last = slice(start + size - 1, stop + size - 1)
            code = (code + letters[last] + np.uint64(size)) * _STEP
            code ^= code >> np.uint64(31)
            use = inside if size > 2 else ~(first_blank & blank[last])
            yield of[use], ((code[use] * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)
            if size > 1:
                inside = inside & ~blank[last]


@dataclass(frozen=True)
class LanguageModel:
    """log_probs[l, bucket] and log_prior[l] of the languages, which are in order."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_probs: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], smoothing: float = 0.1) -> "LanguageModel":
        """From each language's counts of the buckets, with its number of documents behind them."""
        known = tuple(sorted(counts))
        found = np.array([counts[l] for l in known], np.float64).reshape(len(known), BUCKETS + 1)
        buckets, docs = found[:, :-1] + smoothing, found[:, -1] + 1
        return cls(known, np.log(docs / docs.sum()), np.log(buckets / buckets.sum(axis=1, keepdims=True)).astype(np.float32))

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each language for each text, and whether the text has a letter."""
        scores = np.repeat(self.log_prior[None, :], len(texts), axis=0)
        seen = np.zeros(len(texts), bool)
        for text, bucket in grams(texts):
            if len(text):
                # Texts lie behind each other, so their n-grams do too: one sum per text and language.
                starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                of = text[starts]
                seen[of] = True
                for i, row in enumerate(self.log_probs):
                    scores[of, i] += np.add.reduceat(row[bucket], starts, dtype=np.float64)
        scores -= scores.max(axis=1, keepdims=True, initial=-np.inf) if self.languages else 0
        odds = np.exp(scores)
        return odds / odds.sum(axis=1, keepdims=True) if self.languages else odds, seen


def train_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_languages: int = 200) -> LanguageModel:
    """Count all given documents that have a text and a language.

    A document's letters all count, so long documents say more than short ones. Documents without letters only count for
    how frequent their language is. The driver gets one vector of 65,537 counts for each language; more than
    `most_languages` are an error, as then the column is no list of languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        counts: dict[str, np.ndarray] = {}
        for texts, langs in slices((b.column(0), b.column(1)) for b in batches):
            coded = pc.dictionary_encode(langs)
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for name, docs_ in zip(names, np.bincount(of, minlength=len(names))):
                counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[-1] += docs_
            if len(counts) > most_languages:
                raise ValueError(f"over {most_languages} languages")
            for text, bucket in grams(texts):
                found = np.bincount(of[text].astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, found):
                    counts[name][:-1] += row
        return counts

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rows = tree_sum(count_parts(known, count), known.rdd.getNumPartitions()).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    return LanguageModel.of({r["key"]: np.frombuffer(r["counts"], "<i8") for r in rows})


def language(spark: SparkSession, model: LanguageModel, text: str | Column = "text") -> Column:
    """(lang, score) of each whole text: the likeliest language, the first by name in a tie, and its chance.

    A null text, one without a letter, and every text where no language was learnt are `und` with score 0.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for texts in slices(batches):
            chances, seen = known.posteriors(texts)
            sure = seen & bool(known.languages)
            best = np.where(sure, chances.argmax(axis=1) if known.languages else 0, len(known.languages))
            score = np.where(sure, chances.max(axis=1, initial=0), 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["lang", "score"])

    return predict(whole(text))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: one in four, by a checksum of its identifier; never where that is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
