"""Text primitives, draws, relations and verifiers on edge cases."""

import math
import string

import pytest
from pyspark.sql import functions as F

from driftline.functions import relations as R, text as X, verifiers as V
from driftline.functions.draws import draw, edit_chosen, seed_for, shuffle

EDGE = [None, "", "   ", ".,!?", "Élan Vital", "a😀b", "line\nbreak. next", "12345", "x", "A B. C! D? e", "a b \x1c c"]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def python_clean(t):
    if t is None:
        return None
    return " ".join("".join(c for c in t.lower() if c not in string.punctuation).split())


def test_clean_text(spark):
    assert column(spark, EDGE, X.clean_text) == [python_clean(t) for t in EDGE]


@pytest.mark.parametrize(
    "text,number",
    [("0.7", 0.7), ("-0.5", 0.5), (".5", 5.0), ("about 3. or so", 3.0), ("none", None), ("", None), ("1e5", 1.0), ("007", 7.0)],
)
def test_string_to_float(spark, text, number):
    assert column(spark, [text], X.string_to_float) == [number]


def test_sentences_and_words(spark):
    assert column(spark, ["One. Two!  Three?\nFour", "", "  "], X.sentences) == [["One.", "Two!", "Three?", "Four"], [], []]
    assert column(spark, ["Hello, wörld 3."], X.words) == [["Hello", ",", "wörld", "3", "."]]
    assert column(spark, ["a b,\n\nc"], X.parse_keywords) == [["a b", "c"]]
    for t in EDGE[1:]:
        assert column(spark, [t], lambda c: F.array_join(X.pieces(c), "")) == [t]


def test_subset_and_cosine(spark):
    df = spark.createDataFrame([("Yes, Sir.", "yes"), ("", "x"), ("ab", "cd")], "a string, b string")
    assert [r[0] for r in df.select(X.is_subset(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in vectors.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None]


PAIRS = [("0.7", "0.81"), ("0", "0"), ("1", "1"), ("0.5", "x"), ("-0.5", ".5"), ("Yes.", "yes"), ("", "unknown"),
         ("entailment", "contradiction"), ("0.5", "0.9"), ("0.3", "0.4"), ("0.8", "0.7")]


def judged(spark, relation):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "i int, a string, b string")
    return [r["v"] for r in df.select("i", relation(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]


def test_numeric_relations(spark):
    assert judged(spark, lambda a, b: R.equivalent_numeric(a, b, 0.2))[:6] == [True, True, True, None, False, None]
    assert judged(spark, lambda a, b: R.different_numeric(a, b, 0.2))[:6] == [False, False, False, True, True, True]
    stronger = judged(spark, R.stronger)
    assert stronger[1:3] == [True, True] and stronger[3] is None and stronger[8:] == [True, False, False]
    assert judged(spark, R.same_or_stronger)[9] is False


def test_text_relations(spark):
    assert judged(spark, R.equivalent)[5] is True and judged(spark, R.different)[5] is False
    assert judged(spark, lambda a, b: R.inverse(a, b, "entailment", "contradiction"))[7] is True
    assert judged(spark, lambda a, b: R.not_inverse(a, b, "entailment", "contradiction"))[7] is False
    none = F.lit(None).cast("double")
    assert judged(spark, lambda a, b: R.similar(a, b, none))[5:8] == [True, True, False]
    assert judged(spark, lambda a, b: R.not_similar(a, b, none))[5:8] == [False, False, True]


def test_verifiers_keep_null(spark):
    values = ["0.5", "0.61", "x", None]
    assert column(spark, values, lambda t: V.differs_from_number(t, 0.5)) == [False, True, None, None]
    assert column(spark, values, lambda t: V.out_of_range(t, 0.4, 0.6)) == [False, True, None, None]
    assert column(spark, ["", "Unknown.", "yes"], lambda t: V.not_in_set_of(t, "unknown")) == [False, False, True]
    assert column(spark, ["One. Two.", "One."], V.has_sentences) == [True, False]


def test_draws_do_not_depend_on_partitions(spark):
    base = spark.range(1000).withColumn("items", F.sequence(F.lit(1), (F.col("id") % 20 + 1).cast("int")))
    results = []
    for n in (1, 4, 64):
        df = base.repartition(n).select("id", shuffle(F.col("items"), F.col("id"), 5).alias("s"), draw(F.col("id"), F.lit(1), 7).alias("d"))
        results.append(df.orderBy("id").collect())
    assert results[0] == results[1] == results[2]
    assert all(sorted(r["s"]) == list(range(1, r["id"] % 20 + 2)) for r in results[0])


def test_selection_takes_exactly_the_asked_number(spark):
    df = spark.range(200).withColumn("items", F.transform(F.sequence(F.lit(1), (F.col("id") % 37 + 1).cast("int")), lambda x: F.lit("a")))
    out = edit_chosen(F.col("items"), F.col("id"), seed_for(1), lambda n: F.ceil(n * F.lit(0.1)), lambda x, k: F.lit("b"))
    for r in df.select("id", out.alias("o")).collect():
        assert sum(c == "b" for c in r["o"]) == math.ceil((r["id"] % 37 + 1) * 0.1)


def test_huge_row_ids_do_not_overflow(spark):
    df = spark.createDataFrame([(9_223_372_036_854_775_807,), (-5,)], "id bigint")
    assert all(0 <= r[0] < 2147483647 for r in df.select(draw(F.col("id"), F.lit(1), 1)).collect())


def test_contractions_and_their_inverse(spark):
    from driftline.functions.text import contraction_pieces, contraction_words

    cases = {
        "I don't, can't": ["I", "do", "n't", ",", "ca", "n't"], "We'll CANNOT they’re": ["We", "'ll", "CAN", "NOT", "they", "’re"],
        "gonna gonnas wanna cannots": ["gon", "na", "gonnas", "wan", "na", "cannots"], "n't 's 'tis o'clock": ["n", "'", "t", "'", "s", "'", "tis", "o", "'", "clock"],
        "it's'd 90's rock'n'roll": ["it", "'s", "'d", "90", "'s", "rock", "'", "n", "'", "roll"], "": [], " \n ": [], "don't've": ["do", "n't", "'ve"], "Ünïcö'm 漢字'll": ["Ünïcö", "'m", "漢字", "'ll"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", contraction_words(F.col("t")).alias("w"), contraction_pieces(F.col("t")).alias("p")).collect():
        assert r["w"] == cases[r["t"]], r["t"]
        assert "".join(r["p"]) == r["t"] and [p for p in r["p"] if p.strip()] == r["w"]


def test_strip_takes_all_white_space_from_both_ends(spark):
    """As the pattern did, but a text of white space costs no look for its end at each place."""
    texts = ["", " ", "\u3000\u00a0a \u2003b\x85\x1c\n", "\u200bx\u200b", "\t\x0b\x0c\r\x1f\u1680\u2000\u200a\u2028\u2029\u202f\u205f", "é\U0001d518 ", "." + " \n" * 30_000 + "x", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    by_pattern = F.regexp_replace("t", rf"\A{X.WHITE}+|{X.WHITE}+\z", "")
    got = rows.select("i", X.strip(F.col("t")).alias("new"), F.when(F.col("i") != 6, by_pattern).alias("old")).orderBy("i").collect()
    assert [r["new"] for r in got[:6]] == [r["old"] for r in got[:6]] and got[6]["new"] == texts[6] and got[7]["new"] is None
    assert "RegExpReplace" not in rows.select(X.strip(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    every = spark.range(0x10000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert every.where(F.col("c").rlike(rf"\A{X.WHITE}\z") != (X.strip(F.col("c")) == "")).isEmpty()
