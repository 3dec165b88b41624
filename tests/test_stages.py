"""Kept stage tables, committed parts, resumed runs."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from checks.doubles import ENCODER, HELPER, MODEL, SECOND_MODEL
from driftline.operators.model_calls import AnswerStore, BatchModel
from driftline.plans import run as R
from driftline.plans.catalog import QA, Property, Test
from driftline.plans.stages import StageStore
from driftline.sources.commits import Part, PartTable, read_results, result_log
from tests.batch_functions import Counting, shout

ROWS = [(i, [f"The cat {i} sat. The dog ran away.", "Where did the dog go?"]) for i in range(12)]
UPPER = Test(QA, 102, {"transform": Property("upper", {}), "relation": Property("equivalent", {})})
SAME = Test(QA, 49, {"transform": Property("no_change", {}), "relation": Property("equivalent", {})})
REWRITE = Test(QA, 8, {"transform": Property("rewrite", {"template": "it_prompt:paraphrasing"}), "relation": Property("equivalent", {})})


@pytest.fixture(scope="module")
def qa(spark):
    return spark.createDataFrame(ROWS, "row_id bigint, inputs array<string>").repartition(3, "row_id").cache()


def store_at(spark, tmp_path):
    return StageStore(spark, lambda stage: str(tmp_path / stage))


def counting(tmp_path, name="counting"):
    path = str(tmp_path / f"asked-{name}")
    return BatchModel(name, Counting(path), parallelism=2, wait_seconds=0.0), lambda: len(open(path).readlines()) if glob.glob(path) else 0


def test_only_rows_that_changed_are_answered_again(spark, qa, tmp_path):
    model, asked = counting(tmp_path)
    fresh = lambda: R.Resources(HELPER, ENCODER, store=AnswerStore(spark), stages=store_at(spark, tmp_path))
    first = R.source_outputs(qa.where("row_id < 8"), model, QA, fresh()).orderBy("row_id").collect()
    assert asked() == 8 and len(first) == 8
    R.source_outputs(qa, model, QA, fresh())
    assert asked() == 12
    changed = qa.withColumn("inputs", F.when(F.col("row_id") == 3, F.array(F.lit("Other text."), F.lit("Why?"))).otherwise(F.col("inputs")))
    got = R.source_outputs(changed, model, QA, fresh())
    assert asked() == 13 and got.count() == 12
    assert [r for r in got.orderBy("row_id").collect() if r["row_id"] < 8 and r["row_id"] != 3] == [r for r in first if r["row_id"] != 3]
    other, asked_other = counting(tmp_path, "other")
    R.source_outputs(qa, other, QA, fresh())
    assert asked() == 13 and asked_other() == 12


def test_failed_answers_are_asked_again(spark, qa, tmp_path):
    down = BatchModel("m", lambda chats: [None] * len(chats), max_retries=1, wait_seconds=0.0, parallelism=2)
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark), stages=store_at(spark, tmp_path))
    assert R.source_outputs(qa, down, QA, res).where("source_output IS NULL").count() == 12
    up = BatchModel("m", shout, parallelism=2)
    assert R.source_outputs(qa, up, QA, res).where("source_output IS NOT NULL").count() == 12


def test_followups_depend_on_seed_settings_and_prompts_only(spark, qa, tmp_path):
    helper, asked = counting(tmp_path)
    res = lambda seed=1: R.Resources(helper, ENCODER, store=AnswerStore(spark), stages=store_at(spark, tmp_path), seed=seed)
    one = R.followup_inputs(qa, [REWRITE], res()).orderBy("row_id").collect()
    assert asked() == 12
    both = R.followup_inputs(qa, [REWRITE, UPPER], res())
    assert asked() == 12 and both.count() == 24
    assert both.where("mr = 8").orderBy("row_id").collect() == one
    R.followup_inputs(qa, [REWRITE], res(seed=2))
    assert asked() == 24
    table = store_at(spark, tmp_path).table("followup_inputs")
    assert [p.labels["mrs"] for p in table.parts()] == [[8], [102], [8]]


def test_runs_with_and_without_a_store_agree(spark, qa, tmp_path):
    plain = R.run_task(qa, [MODEL], QA, [SAME, UPPER], R.Resources(HELPER, ENCODER))
    kept = R.run_task(qa, [MODEL], QA, [SAME, UPPER], R.Resources(HELPER, ENCODER, stages=store_at(spark, tmp_path)))
    in_order = lambda df: df.orderBy("mr", "row_id", "variant").collect()
    assert in_order(plain) == in_order(kept)


def test_parts_show_up_whole_or_not_at_all(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), "row_id bigint, x string, llm string", ("llm",))
    assert table.read() is None and table.parts() == []
    rows = spark.createDataFrame([(1, "a", "007"), (5, "b", "m")], "row_id bigint, x string, llm string")
    table.append(rows, n=1)
    table.write_part(rows)  # a crash before the commit
    table.append(rows.limit(0), n=2)
    assert table.read().orderBy("row_id").collect() == rows.collect()
    assert [(p.labels["n"], p.least, p.most, p.rows) for p in table.parts()] == [(1, 1, 5, 2), (2, None, None, 0)]
    assert table.read([]).count() == 0


def test_parts_that_may_share_rows():
    part = lambda **labels: Part("p", labels, 10, 20, 3, None)
    for own, mine in ((2, 12), (6, 4), (1, 5), (3, 5)):
        for a in range(own):
            for b in range(mine):
                want = any(h % own == a and h % mine == b for h in range(own * mine))
                assert part(chunks=own, chunk=a).shares_chunk(mine, b) == want
    assert part().shares_chunk(7, 3)
    assert part().meets(20, 30) and part().meets(None, 10) and not part().meets(21, None) and part().meets(None, None)
    assert not Part("p", {}, None, None, 0, None).meets(1, 2)


def test_a_chunk_reads_its_own_part_of_the_log(spark, qa, tmp_path):
    path, res = str(tmp_path / "log"), R.Resources(HELPER, ENCODER)
    R.run_resumable(qa, MODEL, QA, [SAME], res, path, "one", chunks=4)
    log = result_log(spark, path)
    assert sorted(p.labels["chunk"] for p in log.parts()) == [0, 1, 2, 3]
    mine = {"llm": MODEL.name, "task": QA}
    rows = qa.where(F.pmod(F.xxhash64("row_id"), F.lit(4)) == 1)
    found = R.records_of(log, rows, mine, [49], 4, 1)
    [own] = [p for p in log.parts() if p.labels["chunk"] == 1]
    assert {f.split("commit=")[1].split("/")[0] for f in found.inputFiles()} == {own.name}
    assert R.records_of(log, rows, mine, [102], 4, 1) is None and R.records_of(log, rows, {**mine, "llm": "x"}, [49], 4, 1) is None
    far = qa.withColumn("row_id", F.col("row_id") + 1000)
    assert R.records_of(log, far, mine, [49]) is None


def test_resume_after_a_crash(spark, qa, tmp_path):
    path, res = str(tmp_path / "log"), R.Resources(HELPER, ENCODER)
    R.run_resumable(qa.where("row_id < 5"), MODEL, QA, [SAME], res, path, "one")
    # A part without its manifest row, as a crash leaves it.
    [part] = result_log(spark, path).parts()
    shutil.copytree(f"{path}/parts/commit={part.name}", f"{path}/parts/commit=half")
    assert read_results(spark, path).count() == 5
    log = R.run_resumable(qa, MODEL, QA, [SAME, UPPER], res, path, "two", chunks=3)
    assert log.groupBy("row_id", "mr").count().where("count > 1").count() == 0 and log.count() == 24
    assert log.where("run_id = 'one'").count() == 5
    before = len(result_log(spark, path).parts())
    R.run_resumable(qa.where("row_id = 1"), MODEL, QA, [SAME], res, path, "three", batch=7)
    R.run_resumable(qa.where("row_id = 1"), MODEL, QA, [SAME], res, path, "three", batch=7)
    assert len(result_log(spark, path).parts()) == before + 1 and read_results(spark, path).count() == 24


def test_kept_tables_meet_rows_by_their_number_alone(spark, qa, tmp_path):
    """What a run keeps is dealt like the rows' records: before, texts were moved by their fingerprints as well."""
    res = R.Resources(HELPER, ENCODER, stages=store_at(spark, tmp_path))
    long = R.run_task(qa, [MODEL], QA, [SAME, UPPER], res)
    moved = [line for line in long._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "print" in line or "mr" in line.split("hashpartitioning(")[1].split(")")[0]]
    plain = R.run_task(qa, [MODEL], QA, [SAME, UPPER], R.Resources(HELPER, ENCODER))
    assert long.exceptAll(plain).isEmpty() and plain.exceptAll(long).isEmpty()


@pytest.mark.parametrize("rows", ["unique", "twice", "one number for two texts"])
def test_kept_follow_ups_of_repeated_rows(spark, qa, tmp_path, rows):
    """Each row meets the follow-ups of its own inputs, also where its number comes again; rows without a number have none."""
    src = qa.unionByName(spark.createDataFrame([(None, ["No number.", "Why?"])], qa.schema))
    if rows == "twice":
        src = src.unionByName(qa.where("row_id < 2"))
    if rows == "one number for two texts":
        src = src.unionByName(qa.where("row_id = 3").withColumn("inputs", F.array(F.lit("Another."), F.lit("Who?"))))
    res = R.Resources(HELPER, ENCODER, stages=store_at(spark, tmp_path))
    made = R.followup_inputs(src, [UPPER, SAME], res)
    kept = res.stages.table("followup_inputs").read()
    assert kept.where("row_id IS NULL").isEmpty() and made.where("row_id IS NULL").isEmpty()
    if rows != "one number for two texts":
        bad = made.where((F.col("mr") == 102) & (F.get(F.get("variants", F.lit(0)), F.lit(0)) != F.upper(F.get("inputs", F.lit(0)))))
        assert bad.isEmpty() and made.select("row_id", "mr").distinct().count() == 24
    if rows == "unique":
        assert kept.count() == made.count() == 24
        again = R.followup_inputs(src, [UPPER, SAME], res)
        assert again.count() == 24 and sum(p.rows for p in res.stages.table("followup_inputs").parts()) == 24


def test_records_written_in_steps(spark, qa, tmp_path, monkeypatch):
    """Records of rows that meet kept tables are written a step at a time, as one part."""
    logs = []
    monkeypatch.setattr(R, "STEP_BYTES", 1)
    assert R._steps(qa) == 32
    for name, steps in (("whole", 1), ("steps", 3)):
        monkeypatch.setattr(R, "_steps", lambda rows, steps=steps: steps)
        res = R.Resources(HELPER, ENCODER, stages=store_at(spark, tmp_path / name))
        for model in (MODEL, SECOND_MODEL):
            logs.append(R.run_resumable(qa, model, QA, [SAME, UPPER], res, str(tmp_path / name / "log"), "one"))
        assert [p.rows for p in result_log(spark, str(tmp_path / name / "log")).parts()] == [24, 24]
    columns = [c for c in logs[1].columns if c != "committed_at"]
    assert logs[1].count() == 48 and logs[1].select(columns).exceptAll(logs[3].select(columns)).isEmpty()


def test_chunks_go_when_they_are_done(spark, qa, tmp_path, monkeypatch):
    """The dealt rows of a run stay on disk until their chunk is committed, not until the session ends."""
    made = []
    monkeypatch.setattr(R, "work_folder", lambda spark, name: made.append(str(tmp_path / f"{name}{len(made)}")) or made[-1])
    log = R.run_resumable(qa, MODEL, QA, [SAME], R.Resources(HELPER, ENCODER), str(tmp_path / "log"), "one", chunks=3)
    assert made and not glob.glob(f"{made[0]}/**/*.parquet", recursive=True) and log.count() == 12
    again = R.run_resumable(qa, MODEL, QA, [SAME], R.Resources(HELPER, ENCODER), str(tmp_path / "log"), "two")
    assert again.count() == 12 and [p.rows for p in result_log(spark, str(tmp_path / "log")).parts()][-1] == 0
