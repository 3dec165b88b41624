"""Rows that are asked about stay where they are: only keys and answers are moved."""

import re

from pyspark.sql import functions as F

from checks.batch_doubles import batch_model, length_of_last_quote
from checks.doubles import ENCODER, HELPER, MODEL
from driftline.functions.draws import seed_for
from driftline.operators.char_edits import _edit_one, edit_characters
from driftline.operators.local_edits import misspell
from driftline.operators.model_calls import AnswerStore, ask
from driftline.plans import run as R
from driftline.plans.catalog import SENTIMENT, load_tests, merged_catalog
from driftline.plans.templates import template
from driftline.session import dealt

TEXTS = [(1, "One a."), (1, "Other b."), (2, "One a."), (None, "Third c."), (None, "Third c."), (3, None), (4, "")]


def moved(df) -> str:
    """The columns that pass an exchange of the plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return " ".join(re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[(.*?)\]\n", plan))


def texts(spark):
    rows = spark.createDataFrame(TEXTS, "row_id bigint, text string")
    return rows.select("row_id", F.array("text").alias("inputs"))


def sentiment_tests(spark, *mrs):
    return [t for t in load_tests(merged_catalog(spark)) if t.task == SENTIMENT and t.mr in mrs]


def test_answers_come_to_the_rows_and_equal_questions_are_asked_once(spark):
    df, stores, found = dealt(texts(spark)), [AnswerStore(spark) for _ in range(2)], []
    for store, apart in zip(stores, (None, ["_at"])):
        out = ask(df, batch_model("length", length_of_last_quote), template("sut_prompt:sentiment_analysis_continuous"),
                  [F.get("inputs", F.lit(0))], "answer", store=store, keep_status=True, hot_minimum=2, told_apart=apart)
        found.append(sorted(out.collect(), key=repr))
        if apart:
            assert out.columns == [*df.columns, "answer", "answer_status"] and "inputs" not in moved(out)
    assert found[0] == found[1] and len(found[0]) == len(TEXTS)
    assert [s.read().count() for s in stores] == [4, 4]


def test_a_run_with_a_batch_model_moves_no_texts(spark):
    tests = sentiment_tests(spark, 49, 102)
    for dedup in (True, False):
        res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark), dedup=dedup)
        out = R.run_task(texts(spark), [batch_model("length", length_of_last_quote)], SENTIMENT, tests, res)
        assert not {"inputs", "followup_input", "variants"} & {c.split("#")[0].strip() for c in moved(out).split(",")}
        rows = out.collect()
        assert len(rows) == 2 * len(TEXTS)
        assert {r["followup_output"] for r in rows if r["source_input"][0] == "Other b."} == {"n=8"}


def test_records_move_no_texts(spark):
    tests = sentiment_tests(spark, 49, 102)
    unlike = spark.createDataFrame([(1, "One a."), (2, "Other b."), (None, "Third c."), (3, None)], "row_id bigint, text string")
    rows = unlike.select("row_id", F.array("text").alias("inputs"))
    out = R.run_records(rows, MODEL, SENTIMENT, tests, R.Resources(HELPER, ENCODER))
    assert not {"inputs", "source_input", "followup_input", "variants"} & {c.split("#")[0].strip() for c in moved(out).split(",")}


def test_records_are_those_of_the_long_form(spark):
    tests, res = sentiment_tests(spark, 49, 102), R.Resources(HELPER, ENCODER)
    plain = texts(spark).where("row_id = 1 OR row_id > 2 OR row_id IS NULL")
    for rows in (plain, plain.where("row_id > 2"), plain.limit(0)):
        expected = R.records(R.run_task(rows, [MODEL], SENTIMENT, tests, res)).drop("source_input", "followup_inputs")
        found = R.run_records(rows, MODEL, SENTIMENT, tests, res)
        assert sorted(found.select(*expected.columns).collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_misspelling_moves_no_pieces(spark):
    rows = spark.createDataFrame([(i, "some words here, and  other words there " * 5) for i in range(20)], "row_id bigint, text string")
    table = spark.createDataFrame([("words", "wrods")], "word string, misspelling string")
    out = misspell(rows, F.col("text"), F.col("row_id"), seed_for(42), table, "new", "row_id")
    assert "_pieces" not in moved(out) and "_changed" not in {c.split("#")[0].strip() for c in moved(out).split(",")}
    for row in out.collect():
        assert row["new"].replace("wrods", "words") == row["text"] and len(row["new"]) == len(row["text"])


def test_a_batch_of_long_texts_is_edited_in_slices(spark):
    long = [(1, "ab c " * 600_000), (2, None), (3, ""), (4, "x y" * 500_000)]
    rows = spark.createDataFrame(long, "row_id bigint, text string").coalesce(1)
    out = rows.select("row_id", edit_characters(F.col("text"), F.col("row_id"), "delete", 7, 0).alias("new")).collect()
    assert [(r["row_id"], r["new"]) for r in out] == [(i, None if t is None else _edit_one(t, i, "delete", 7, 0, 0.1)) for i, t in long]
