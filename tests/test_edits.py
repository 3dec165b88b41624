"""Laws of the local transformations, on edge texts."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.doubles import ENCODER, HELPER
from driftline.operators.batches import slices
from driftline.operators.char_edits import KINDS, edit_characters
from driftline.operators.pools import Pool, next_prime
from driftline.operators.registry import TRANSFORMS
from driftline.operators.rewrites import Edit, distinct_indices
from driftline.plans import run as R
from driftline.plans.catalog import NLI, Property, Test

TEXTS = ["", "x", "12 34", "hello world", "Élan vital, naïve café. Second sentence! Third one?", "a😀bc 𝔘nicode letters", "one two " * 300]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [t]) for i, t in enumerate(TEXTS)], "row_id bigint, inputs array<string>").cache()


def run(rows, name, params=None, **more):
    df = TRANSFORMS[name](rows, Edit(**more), params or {})
    return [r["t"] for r in df.select("row_id", F.get(F.get("variants", F.lit(0)), F.lit(0)).alias("t")).orderBy("row_id").collect()]


def letters(t):
    return sum(c.isalpha() for c in t)


@pytest.mark.parametrize("kind", KINDS)
def test_character_counts(rows, kind):
    out = rows.select("row_id", edit_characters(F.get("inputs", F.lit(0)), F.col("row_id"), kind, 3, 4).alias("t")).orderBy("row_id")
    for before, r in zip(TEXTS, out.collect()):
        n, after = math.ceil(letters(before) * 0.1), r["t"]
        grown = {"delete": -n, "add": n, "space": n}.get(kind, 0)
        assert len(after) == len(before) + grown
        if kind == "swap":
            assert sorted(after) == sorted(before)


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(1, None)], "row_id bigint, t string")
    assert df.select(edit_characters(F.col("t"), F.col("row_id"), "delete", 1, 2)).first()[0] is None


def test_swap_is_left_to_right():
    from driftline.operators.char_edits import _draws, _edit_one

    text = "abcdefghij klmnopqrstuvwxyz abcdefghijk"
    for row in range(200):
        import numpy as np

        spots = np.array([i for i, c in enumerate(text) if c.isalpha()])
        keys = _draws(row, spots + 1, 9) * 2147483648 + spots
        chosen = sorted(spots[np.argsort(keys)[: math.ceil(len(spots) * 0.3)]])
        expected = list(text)
        for i in chosen:
            if i < len(expected) - 1:
                expected[i], expected[i + 1] = expected[i + 1], expected[i]
        assert _edit_one(text, row, "swap", 9, 0, 0.3) == "".join(expected)


def test_order_is_kept_as_a_multiset(rows):
    assert [sorted(t.split()) for t in run(rows, "shuffle_sentences")] == [sorted(t.split()) for t in TEXTS]
    for before, after in zip(TEXTS, run(rows, "scramble_words")):
        assert sorted(before.replace(" ", "")) == sorted(after.replace(" ", ""))


def test_permutation_twice_is_identity(spark):
    df = spark.createDataFrame([(1, ["t", "h", "e"])], "row_id bigint, inputs array<string>")
    params = {"permute_to": "[0,2,1]"}
    once = TRANSFORMS["permute"](df, Edit(arity=3), params).select("row_id", F.get("variants", F.lit(0)).alias("inputs"))
    assert once.first()["inputs"] == ["t", "e", "h"]
    assert TRANSFORMS["permute"](once, Edit(arity=3), params).first()["variants"] == [["t", "h", "e"]]


def test_exclaim_and_upper(rows):
    assert run(rows, "exclaim")[4].endswith("Third one?!")
    assert run(rows, "upper")[4].startswith("ÉLAN VITAL, NAÏVE CAFÉ.")


def test_pool_forms_agree(spark, rows):
    values = spark.createDataFrame([(f"word{i}",) for i in range(50)] + [("word1",)], "w string")
    small, large = Pool.of(values, "w"), Pool.of(values, "w", literal_entries=10)
    assert small.size == large.size == 50 and large.constant is None
    assert sorted(r["idx"] for r in large.table.collect()) == list(range(50))
    for name in ("insert_random_words",):
        assert run(rows, name, words=small) == run(rows, name, words=large)
    for name in ("append_random_sentence", "replace_sentences"):
        assert run(rows, name, sentences=small) == run(rows, name, sentences=large)


def test_distinct_indices(spark):
    assert [next_prime(n) for n in (1, 2, 8, 50, 1000)] == [2, 2, 11, 53, 1009]
    df = spark.range(300).select("id", distinct_indices(F.col("id"), F.lit(40), 50, 1).alias("i"))
    for r in df.collect():
        assert len(set(r["i"])) == 40 and all(0 <= x < 50 for x in r["i"])


@pytest.mark.parametrize("n", [1, 4, 64])
def test_same_result_at_any_partitioning(rows, n):
    for name in ("replace_characters", "scramble_inside_words", "shuffle_words", "delete_sentences"):
        assert run(rows.repartition(n), name) == run(rows, name)


def test_character_edits_of_all_relations_share_one_worker(spark):
    """Before, each edit of each input had a worker of its own, which held a batch of all texts."""
    names = {1: "replace_characters", 2: "delete_characters", 3: "leet", 4: "add_characters", 5: "add_spaces", 6: "swap_characters"}
    params = {"transform_indices": "[[0],[1],[0,1]]"}
    tests = [Test(NLI, mr, {"transform": Property(name, params), "relation": Property("equivalent", {})}) for mr, name in names.items()]
    tests[0].props["vsi"] = Property("has_sentences", {"minimum": "2"})
    made = [[t, TEXTS[-1 - i]] for i, t in enumerate(TEXTS)] + [[None, "b"], ["a"], None]
    src = spark.createDataFrame(list(enumerate(made)), "row_id bigint, inputs array<string>")
    res = R.Resources(HELPER, ENCODER)
    df = R.followup_inputs(src, tests, res)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r["row_id"], r["mr"]): (r["vsi"], r["variants"]) for r in df.collect()}
    assert len(got) == len(made) * len(tests)
    for t in tests:
        for r in R.transform_rows(src, t, res, "variants").collect():
            vsi = t.mr != 1 or bool(r["inputs"] and r["inputs"][0] in (TEXTS[4], TEXTS[6])) and ". " in r["inputs"][0]
            assert got[r["row_id"], t.mr] == (vsi, r["variants"] if vsi else None)


def test_slices_of_lists_of_texts():
    texts = pa.array([["abcd", None], None, ["ab", "cd", "e"], [], ["x"] * 9])
    parts = list(slices([(texts, pa.array(range(5)))], most_bytes=5))
    assert [p[1].to_pylist() for p in parts] == [[0, 1], [2, 3], [4]] and [x for p in parts for x in p[0].to_pylist()] == texts.to_pylist()
    assert [p[1].to_pylist() for p in slices([(texts.slice(2), pa.array(range(3)))], most_bytes=5)] == [[0, 1], [2]]
