"""Files, sampling, and a part of the checked queries against their oracle on the smallest tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from checks import views
from driftline.sources import files, sampling, tasks as T
from tests.conftest import SF


def test_json_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["c", "q"], ["d", "r"]], indent=4))
    (tmp_path / "b.json").write_text(json.dumps(["bare", "texts"]))
    rows = files.read_inputs(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["inputs"] for r in rows] == [["c", "q"], ["d", "r"], ["bare"], ["texts"]]
    assert [r["row_id"] for r in rows] == [0, 1, 2**32, 2**32 + 1]


def test_existing_inputs_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.existing_inputs(spark, str(tmp_path / "missing"))


def test_csv_keeps_texts(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("line\nbreak", ""), (" padded ", "é")], "a string, b string")
    files.write_csv(df, str(tmp_path / "csv"), ["b", "a"])
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["b", "a"] and sorted(map(tuple, back.select("a", "b").collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [0, 1, 10, 999, 5000])
def test_sampling_forms_agree(spark, size):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    forms = [sampling.seeded_sample(df.repartition(n), "row_id", size, 7) for n in (1, 5)]
    small, large = (sorted(r["row_id"] for r in f.collect()) for f in forms)
    by_draw = df.orderBy(sampling.sample_draw(F.col("row_id"), 7), "row_id").limit(size)
    assert small == large == sorted(r["row_id"] for r in by_draw.collect()) and len(small) == min(size, 1000)


def test_arity_is_checked(spark):
    df = spark.createDataFrame([(1, ["a"])], "row_id bigint, inputs array<string>")
    with pytest.raises(Exception, match="expected 2 inputs"):
        T.check_arity(df, 2).collect()


def test_empty_label_lists_and_single_entities(spark):
    schema = "row_id bigint, sents array<array<string>>, vertexSet array<array<struct<name:string>>>, labels array<struct<h:int,t:int,r:string>>"
    rows = [
        (1, [["A", "b", "."]], [[("A",)]], []),
        (2, [["A", "met", "B", "."], ["So", "!"]], [[("A",), ("a",)], [("B",)]], [(0, 1, "R1")]),
    ]
    raw = spark.createDataFrame(rows, schema)
    got = T.relation_extraction_labelled(raw, spark.createDataFrame([("R2", "two")], "code string, name string")).collect()
    assert len(got) == 1 and got[0]["inputs"][0] == "A met B. So!" and got[0]["label"] is None
    pairs = {r["row_id"]: r["inputs"] for r in T.entity_pairs(raw).collect()}
    assert pairs[1][1:] == [None, None] and sorted(pairs[2][1:]) == ["A", "B"]


QUICK = (
    "x1_clean_text x5_sentences x7_keyword_parse s2_large_sample s5_question_answering_labelled s14_random_pair i4_permute "
    "i7_shuffle_sentences i8_shuffle_words i12_replace_characters i17_swap_characters i19_scramble_inside_words i23_typos_ocr "
    "i28_group_by_sentiment i39_replace_antonym_qa i42_replace_random_qa o7_stronger o10_similar v14_symmetric m5_refusals_as_text "
    "c5_add_to_rule p5_transform_input e6_batch_calls e7_flagship e7_run_question_answering e12_arrivals"
).split()


@pytest.mark.parametrize("name", QUICK)
def test_query_against_oracle(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from checks.compare import compare_one, connect

    state, *_, detail = compare_one(spark, connect(SF), name, queries()[name], oracle_sql().get(name), SF, 300)
    assert state == "ok", detail


def test_every_survey_id_has_a_query():
    from __spark_entry__ import queries

    names = {n.split("_")[0] for n in queries()}
    for prefix, count in (("s", 27), ("p", 10), ("c", 7), ("m", 10), ("x", 9), ("i", 51), ("o", 14), ("v", 16), ("e", 15)):
        missing = [f"{prefix}{i}" for i in range(1, count + 1) if f"{prefix}{i}" not in names]
        assert not missing, missing


def test_repository_holds_no_data():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    reports = ("BENCH_", "CORRECTNESS_")  # written beside the code after each round
    assert not [f for f in os.listdir(root) if f.endswith((".parquet", ".json")) and not f.startswith(reports)]


def test_relation_rows_work_tokens_out_once_and_write_only_inputs(spark, tmp_path, monkeypatch):
    texts = [(1, "One two. Threes four! Five?", "src1"), (2, "Alone here.", "src2"), (3, "", "src1"), (4, None, "src1"), (5, "Aa bb. Cc dd.", None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = views.relation_raw(spark, str(tmp_path)).localCheckpoint()
    plans, written, staged = [], [], views.staged

    def noted(session, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        written.append(set(df.columns))
        return staged(session, df)

    monkeypatch.setattr(views, "staged", noted)
    got = {tuple([r["row_id"], *r["inputs"]]) for r in views.relation_rows(spark, str(tmp_path)).collect()}
    assert got == {tuple([r["row_id"], *r["inputs"]]) for r in T.relation_extraction(raw).collect()} and {r[0] for r in got} == {1, 5}
    assert written == [{"row_id", "inputs"}] and plans[0].count("regexp_extract_all") == 1


def test_one_name_is_the_one_among_all(spark):
    sets = "array(array(named_struct('name', 'a'), named_struct('name', 'A')), array(named_struct('name', 'b'), named_struct('name', 'B')), array())"
    rows = spark.sql(f"SELECT id AS row_id, {sets} AS v FROM range(40)")
    names = T.random_names(F.col("v"), F.col("row_id"), 5)
    each = F.array(*[T.random_name(F.col("v"), F.lit(i), F.col("row_id"), 5) for i in range(3)])
    for r in rows.select(names.alias("all"), each.alias("each"), T.random_name(F.col("v"), F.lit(None).cast("int"), F.col("row_id"), 5).alias("none")).collect():
        assert r["all"] == r["each"] and r["none"] is None
