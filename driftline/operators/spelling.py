"""Misspellings found in a corpus: rare words within one edit of frequent ones.

Two words are one insertion, deletion or substitution apart only if they, or they without one of their characters, have a
string in common. So every word goes to its deletions, and words that meet there are compared; no word meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import pieces


def deletions(word: Column) -> Column:
    """The word, and the word without each of its characters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), without))


def spelling_index(
    texts: DataFrame, column: str = "text", least_frequent: int = 50, most_rare: int = 2, least_length: int = 4, most_length: int = 40
) -> DataFrame:
    """(word, misspelling, n_word, n_misspelling): for each frequent word its most frequent rare neighbour, the first by name in a tie.

    Words are runs of letters and digits in lower case. Short ones have real words for neighbours; very long ones are no words.
    A string is a deletion of so many words at most as there are characters to put in at each of its places, so no group of
    the join grows with the corpus beyond its alphabet.
    """
    sized = F.length("word").between(least_length, most_length)
    counted = texts.select(F.explode_outer(pieces(F.lower(F.col(column)))).alias("word")).where(sized & F.col("word").rlike(r"\A[\p{L}\p{N}]+\z"))
    counted = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least_frequent) | (F.col("n") <= most_rare))
    met = counted.select("word", "n", F.explode(deletions(F.col("word"))).alias("deletion"))
    frequent = met.where(F.col("n") >= least_frequent).select("deletion", "word", F.col("n").alias("n_word"))
    rare = met.where(F.col("n") <= most_rare).select("deletion", F.col("word").alias("misspelling"), F.col("n").alias("n_misspelling"))
    near = frequent.join(rare, "deletion").where((F.col("word") != F.col("misspelling")) & (F.levenshtein("word", "misspelling") <= 1))
    best = F.min_by(F.struct("misspelling", "n_misspelling"), F.struct(-F.col("n_misspelling"), F.col("misspelling"))).alias("best")
    return near.groupBy("word").agg(F.first("n_word").alias("n_word"), best).select("word", "best.misspelling", "n_word", "best.n_misspelling")
