"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, other columns with odd names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "amber basil cedar delta ember fjord grove heron inlet jetty kelp lemon maple north otter pearl quartz river stone tulip".split()
#: Columns that operators use inside, with values that would spoil them.
CLASHING = "id long, run string, node string, digest string, n string, keys string, class string, spans string, base string, sections int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randint(0, 99)) for _ in range(n))


def edited(text: str, place: int = 0) -> str:
    words = text.split(" ")
    words[place] = "changed"
    return " ".join(words)


def rows() -> list[tuple]:
    base = [prose(i, 60) for i in range(6)]
    return [
        (1, base[0]), (2, base[0]), (2, base[0]), (3, edited(base[0])), (4, base[1]), (5, edited(base[1], 30)), (6, edited(base[1], -1)),
        (7, None), (8, ""), (9, " \n\t \n"), (10, "one two"), (11, "one two"), (None, base[2]), (12, base[2]), (None, None),
        (13, prose(99, 30_000)), (14, "x" * 50_000), (15, base[3] + "\n" + base[4]), (16, base[5] + "\n" + edited(base[4], 3) + "\nshort\nshort"),
        (17, "Ünïcödé — 漢字 🙂 <|endoftext|>   x"), (18, base[3].upper()),
    ]


def documents(spark: SparkSession, given: list[tuple] | None = None) -> DataFrame:
    given = rows() if given is None else given
    df = spark.createDataFrame([(*r, *[7, "a", "b", "c", "d", "e", "f", "g", "h", 1]) for r in given], "doc_id long, text string, " + CLASHING)
    return df.repartition(3, "doc_id")


def collected(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
