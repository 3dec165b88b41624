"""Catalog, model calls, whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.doubles import ENCODER, HELPER, MODEL, SECOND_MODEL
from checks.q_catalog import FIXED_VARIANTS
from driftline.functions.text import clean_text
from driftline.operators.encoders import BatchEncoder
from driftline.operators.model_calls import AnswerStore, BatchModel, ColumnModel, ask, join_answers
from driftline.operators.prompts import fill
from driftline.operators.registry import TRANSFORMS
from driftline.operators.rewrites import Edit
from driftline.plans import run as R
from driftline.plans.catalog import NLI, QA, RE, SENTIMENT, Property, Test, load_tests, merged_catalog
from driftline.plans.templates import template
from driftline.session import work_folder
from driftline.sources.commits import append_results
from driftline.streaming.arrivals import SOURCE_SCHEMA
from tests.batch_functions import Counting, fail_always, shout

QA_ROWS = [
    (1, ["The cat sat. The dog ran away.", "Where did the dog go?"]),
    (2, ["One sentence only", "What?"]),
    (3, ["The cat sat. The dog ran away.", "Where did the dog go?"]),
]


@pytest.fixture(scope="module")
def tests(spark):
    return load_tests(merged_catalog(spark))


@pytest.fixture(scope="module")
def qa(spark):
    return spark.createDataFrame(QA_ROWS, "row_id bigint, inputs array<string>").cache()


def test_catalog_has_108_pairs_and_189_variants(tests):
    variants = {}
    for t in tests:
        prop = t.props["transform"]
        variants.setdefault(t.task, []).append(FIXED_VARIANTS.get(prop.fn, len(prop.indices)))
    assert {k: len(v) for k, v in variants.items()} == {QA: 26, NLI: 28, SENTIMENT: 25, RE: 29}
    assert {k: sum(v) for k, v in variants.items()} == {QA: 68, NLI: 67, SENTIMENT: 25, RE: 29}


def test_missing_template_is_an_error(spark):
    with pytest.raises(Exception, match="no template"):
        merged_catalog(spark, [(QA, 999, "transform", "rewrite", {"template": "it_prompt:nowhere"})]).collect()


def test_later_slot_in_inserted_text_is_filled(spark):
    df = spark.createDataFrame([("see {INPUT_1}", None)], "a string, b string")
    assert df.select(fill(F.lit("<{INPUT_0}|{INPUT_1}>"), [F.col("a"), F.col("b")])).first()[0] == "<see |>"


def counted(tmp_path, **more):
    path = str(tmp_path / "questions")
    return BatchModel("counting", Counting(path), parallelism=2, wait_seconds=0.0, **more), lambda: sum(1 for _ in open(path))


def test_questions_are_asked_once(spark, qa, tests, tmp_path):
    model, asked = counted(tmp_path, chunks=3)
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark))
    chosen = [t for t in tests if t.task == QA and t.mr in (49, 102)]
    first = R.run_task(qa, [model], QA, chosen, res).orderBy("mr", "row_id", "variant").collect()
    # Two distinct rows: 2 source questions, 2 repeated ones for MR 49, 3 variants x 2 for MR 102.
    assert asked() == 2 + 2 + 6
    again = R.run_task(qa, [model], QA, chosen, res).orderBy("mr", "row_id", "variant").collect()
    assert asked() == 10 and again == first
    assert len(first) == 3 * (1 + 3)


def test_exhausted_retries_do_not_stop_the_job(spark, qa, tests):
    model = BatchModel("down", fail_always, max_retries=2, wait_seconds=0.0, parallelism=2)
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark))
    chosen = [t for t in tests if t.task == QA and t.mr == 49]
    out = R.records(R.run_task(qa, [model], QA, chosen, res)).collect()
    assert len(out) == 3 and all(r["source_output"] is None and r["verif_failure"] == "sfoe" for r in out)


def test_hot_and_cold_joins_agree(spark):
    df = spark.range(500).withColumn("_key", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.col("id").cast("string")))
    keys = df.where("_key IS NOT NULL").groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("n"))
    answers = keys.select("key", "n", F.concat(F.lit("a-"), "key").alias("output"), F.lit("ok").alias("status"))
    results = [join_answers(df, answers, "out", m).orderBy("id").collect() for m in (2, 10**9)]
    assert results[0] == results[1] and len(results[0]) == 500


def loud_rule(t, inputs):
    return F.upper(fill(F.lit(t.prompt), inputs))


@pytest.mark.parametrize(
    "name,params",
    [("rewrite", {"template": "it_prompt:paraphrasing"}), ("rewrite_sentences", {"template": "it_prompt:singular_plural"}),
     ("back_translate", {}), ("group_by_sentiment", {}), ("replace_category", {}), ("replace_synonym", {}),
     ("replace_antonym_qa", {}), ("remove_keywords", {}), ("remove_keywords_qa", {}), ("negate_qa", {})],
)
def test_batch_and_column_helpers_agree(spark, qa, name, params):
    """The same helper as a rule and as a batch function: expressions and distributed calls give the same variants."""
    out = []
    for helper in (ColumnModel("loud", loud_rule), BatchModel("loud", shout, parallelism=2)):
        edit = Edit(helper=helper, store=AnswerStore(spark), arity=2, indices=((0,), (1,)))
        df = TRANSFORMS[name](qa, edit, params)
        out.append(df.select("row_id", "variants").orderBy("row_id").collect())
    assert out[0] == out[1]


def test_whole_run_with_batch_helper(spark, qa, tests):
    chosen = [t for t in tests if t.task == QA and t.mr in (19, 8, 102, 10)]
    out = []
    for helper in (ColumnModel("loud", loud_rule), BatchModel("loud", shout, parallelism=2)):
        res = R.Resources(helper, ENCODER, store=AnswerStore(spark))
        out.append(R.run_task(qa, [MODEL], QA, chosen, res).orderBy("mr", "row_id", "variant").collect())
    assert out[0] == out[1]


def test_gates(spark, qa):
    test = Test(QA, 7, {
        "transform": Property("no_change", {}),
        "vsi": Property("has_sentences", {"minimum": "2"}),
        "vso": Property("not_in_set_of", {"value": "unknown"}),
        "vfi": Property("differs_at", {"value": "where did the dog go", "index": "1"}),
        "relation": Property("equivalent", {}),
    })
    res = R.Resources(HELPER, ENCODER)
    extra = spark.createDataFrame(
        [(4, ["Nothing here. At all.", "Why?"]), (5, ["He is in. She is out.", "Is she out?"])], qa.schema
    )
    got = {r["row_id"]: r for r in R.records(R.run_task(qa.union(extra), [MODEL], QA, [test], res)).collect()}
    assert [got[i]["verif_failure"] for i in (1, 2, 4, 5)] == ["fi", "si", "so", None]
    assert got[2]["followup_inputs"] is None and got[2]["source_output"] is not None
    assert got[4]["followup_inputs"] is not None and got[4]["followup_outputs"] is None and got[4]["relations"] is None
    assert got[5]["relations"] == [True]


def test_models_share_followups(spark, qa, tests):
    chosen = [t for t in tests if t.task == QA and t.mr == 102]
    both = R.run_task(qa, [MODEL, SECOND_MODEL], QA, chosen, R.Resources(HELPER, ENCODER))
    one = R.run_task(qa, [MODEL], QA, chosen, R.Resources(HELPER, ENCODER))
    assert both.count() == 18
    assert both.where(F.col("llm") == MODEL.name).orderBy("row_id", "variant").collect() == one.orderBy("row_id", "variant").collect()


def letter_counts():
    return lambda texts: np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])


def test_batch_encoder(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "xyz"), ("", "abc"), (None, "a"), ("unknown", "unknown")], "a string, b string")
    values = [r[0] for r in df.coalesce(1).select(BatchEncoder(letter_counts).similarity(F.col("a"), F.col("b"))).collect()]
    assert values[0] == pytest.approx(1.0) and values[1] == 0.0 and values[2] is None and values[3] is None
    assert values[4] == pytest.approx(1.0)


def test_unasked_rows_are_not_asked(spark, qa, tmp_path):
    model, asked = counted(tmp_path)
    when = clean_text(F.get("inputs", F.lit(1))) == "what"
    df = ask(qa, model, template("it_prompt:paraphrasing"), [F.get("inputs", F.lit(0))], "out", when=when)
    assert asked() == 1 and df.where("out IS NOT NULL").count() == 1


@pytest.mark.parametrize("task", [QA, NLI, SENTIMENT, RE])
def test_every_test_of_the_catalog_can_be_planned(spark, tests, task):
    """All relations of a task analyse with the doubles; nothing is run."""
    from checks.views import sentence_pool, word_pool
    from tests.conftest import SF

    res = R.Resources(HELPER, ENCODER, word_pool(spark, SF), sentence_pool(spark, SF))
    src = spark.createDataFrame([(1, ["a", "b", "c"])], "row_id bigint, inputs array<string>")
    long = R.run_task(src, [MODEL], task, [t for t in tests if t.task == task], res)
    assert long.columns == R.LONG_COLUMNS


def test_similar_or_unknown_relation(spark, qa):
    props = {"transform": Property("no_change", {}), "relation": Property("similar_or_unknown", {"threshold": "0.5"})}
    out = R.run_task(qa, [MODEL], QA, [Test(QA, 49, props)], R.Resources(HELPER, ENCODER)).collect()
    assert [r["verdict"] for r in out] == [True, True, True]


def test_records_of_a_run_are_made_where_its_rows_are(spark, tests, monkeypatch):
    """The rows are dealt once by their identifier; neither records nor the look at earlier ones move texts again."""
    plans = []
    monkeypatch.setattr(R, "append_results", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), append(df, *a, **k)))
    append, path = append_results, work_folder(spark, "results")
    tests = [t for t in tests if t.task == SENTIMENT and t.mr in (49, 102)]
    rows = spark.createDataFrame([(i, [f"A good text {i}. It is fine."]) for i in range(20)] + [(3, ["Once more."]), (None, ["No number."])], SOURCE_SCHEMA)
    R.run_resumable(rows.where("row_id < 5 OR row_id IS NULL"), MODEL, SENTIMENT, tests, R.Resources(HELPER, ENCODER), path, "one")
    log = R.run_resumable(rows, MODEL, SENTIMENT, tests, R.Resources(HELPER, ENCODER), path, "two")
    assert log.where("row_id IS NOT NULL").groupBy("row_id", "mr").count().where("count > 1").isEmpty() and log.select("row_id", "mr").distinct().count() == 42
    assert "hashpartitioning(row_id" in plans[0] and plans[0].count("Exchange") == 1
    assert not any("Exchange" in line and "mr#" in line and "inputs" in line for line in plans[1].splitlines())
