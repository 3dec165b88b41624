"""The test doubles read a text once per answer, and remember no more of the questions than they need."""

import pytest
from pyspark.sql import functions as F

from checks.batch_doubles import AnswerSecondTime
from checks.doubles import _infer, _rate, _relate
from driftline.functions import text as X

TEXTS = ["", "123", "abc xyz", "ÀB.c! n", "m" * 300, "zzz a", "İstanbul ẞ", "😀 Ab"]


def python_rate(t):
    letters = [c for c in t.lower() if "a" <= c <= "z"]
    return f"0.{min(99, 100 * sum(c <= 'm' for c in letters) // len(letters)):02d}" if letters else "n/a"


@pytest.mark.parametrize(
    "rule, name, times", [(lambda c: _rate(c), "lower(", 1), (lambda c: _infer(c, F.lit("h")), "array_intersect(", 1), (lambda c: _relate(c, F.lit("h"), F.lit("t")), "instr(", 2)]
)
def test_a_rule_reads_its_text_once(spark, rule, name, times):
    assert str(rule(F.col("t"))).lower().count(name) == times


def test_rates_are_the_share_of_letters(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", _rate(F.col("t")).alias("r"))
    assert [r["r"] for r in df.orderBy("i").collect()] == [python_rate(t) for t in TEXTS]


def test_cleaning_uses_one_pattern_and_agrees_with_two_on_every_character(spark):
    assert str(X.clean_text(F.col("t"))).count("regexp_replace") == 1
    points = spark.range(0x110000).where("id < 55296 OR id > 57343")
    point = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32")
    texts = points.select(F.concat_ws("", F.lit("a"), point, F.lit("B "), point, F.lit(" "), point, point, F.lit("\td"), point).alias("t"))
    bare = F.regexp_replace(F.lower("t"), X.PUNCTUATION_PATTERN, "")
    two = F.trim(F.regexp_replace(bare, f"{X.WHITE}+", " "))
    assert texts.count() == 0x110000 - 2048
    assert texts.where(~X.clean_text(F.col("t")).eqNullSafe(two)).count() == 0


def test_only_questions_that_wait_are_remembered():
    model, chats = AnswerSecondTime(), [[{"content": "x" * n}] for n in range(1, 8)]
    for _ in range(2):
        for _ in range(3):
            answers = model(chats)
            chats = [c for c, a in zip(chats, answers) if not isinstance(a, str)]
        assert [len(c[0]["content"]) for c in chats] == [5] and not model.seen
        chats = [[{"content": "y" * n}] for n in range(1, 8)]
