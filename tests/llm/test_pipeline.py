import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from driftline.llm import line_dedup, ngram_join, quality
from driftline.llm.common import staged

from .cases import prose
from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_classes

TESTDATA = "/root/testdata/sf0.001"


def docs_of(spark, given):
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in given]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    columns = docs.dtypes
    for place, (_, stage) in enumerate(P.STAGES):
        before, docs = docs, staged(stage(spark, docs, TESTDATA), "test-stage")
        if place < len(P.STAGES) - 1:
            assert docs.dtypes == columns and 0 < docs.count() <= before.count()
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        else:
            assert docs.select("doc_id").distinct().count() == before.count()


def test_line_stage_like_brute_force(spark):
    given = [(i, prose(i % 7, 12) + "\n" + prose(100 + i, 8)) for i in range(20)] + [(50, prose(3, 12)), (51, ""), (52, None), (53, " \n")]
    got = {r["doc_id"]: r["text"] for r in P.line_dedup_stage(spark, docs_of(spark, given), TESTDATA).collect()}
    wanted = {i: t for (i, t, gone) in brute_lines(given) if not gone or t.strip()}
    assert got == wanted and 50 not in got and {51, 52, 53} <= set(got)


def test_line_stage_takes_short_lines(spark):
    given = [(1, "Les.\none two three four"), (2, "one two three four five\nLes.\nrest"), (3, "Les."), (4, "x" * 500 + "\nnew"), (5, "x" * 500 + "\n ")]
    got = {r["doc_id"]: r["text"] for r in P.line_dedup_stage(spark, docs_of(spark, given), TESTDATA).collect()}
    assert got == {i: t for (i, t, gone) in brute_lines(given) if not gone or t.strip()} == {1: given[0][1], 2: "rest", 4: given[3][1]}


def test_near_copies_stage_like_brute_force(spark):
    base = prose(1, 60)
    given = [(i, base + f" tail{i}") for i in range(5)] + [(10, prose(2, 60)), (11, prose(2, 60)), (12, ""), (13, None), (14, "one"), (15, prose(5, 60))]
    got = sorted(r["doc_id"] for r in P.near_copies_stage(spark, docs_of(spark, given + given[:2]), TESTDATA).collect())
    assert got == sorted({i for i, name, _, kept in brute_classes(given) if kept})


def test_secrets_stage_masks_and_keeps_all(spark):
    given = [(i, f"{prose(i, 30)} token={'0a1b2c3d' * 4} end") for i in range(30)] + [(40, None), (41, "")]
    out = {r["doc_id"]: r for r in P.secrets_stage(spark, docs_of(spark, given), TESTDATA).collect()}
    assert len(out) == 32 and out[40]["text"] is None and out[41]["text"] == ""
    assert all(out[i]["text"] == f"{prose(i, 30)} [SECRET] end" and out[i]["n_chars"] == len(out[i]["text"]) for i in range(30))


def test_quality_stage_follows_the_score(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet").filter(~quality.held_out())
    model = quality.train_quality(docs, labels)
    wanted = {r["doc_id"] for r in docs.select("doc_id", quality.quality_score(model).alias("s")).collect() if r["s"] >= P.LEAST_QUALITY}
    assert {r["doc_id"] for r in P.quality_stage(spark, docs, TESTDATA).collect()} == wanted


@pytest.mark.parametrize("place", [1, 2, 3, 4])
def test_empty_tables(spark, place):
    assert P.STAGES[place][1](spark, docs_of(spark, []), TESTDATA).count() == 0


def test_stages_call_their_operators():
    assert [name for name, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert line_dedup.line_dedup.__defaults__[0] == ngram_join.ngram_join.__defaults__[1] == 0.8


def test_equal_rows_keep_the_first_in_order_of_columns(spark):
    rows = [(1, prose(1, 40), "en", "b", 9), (1, prose(1, 40), "en", "a", 9), (1, prose(2, 40), "en", "z", 9), (None, prose(3, 40), None, None, None), (None, None, "x", "y", 0)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, P.near_copies_stage(spark, docs, TESTDATA).collect()), key=repr)
    assert got == sorted({rows[1], *rows[2:]}, key=repr)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, prose(1, 9000)), (5, "x" * 70_000), (None, prose(2, 30)), (None, None), (7, prose(3, 30)), (7, prose(3, 30)), (8, prose(3, 30))]


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    stage, odd = dict(P.STAGES)[name], docs_of(spark, ODD)
    out = stage(spark, odd, TESTDATA).collect()
    known = {i for i, _ in ODD}
    assert out and {r["doc_id"] for r in out} <= known
    if name not in ("quality classifier",):
        assert {4, 5} <= {r["doc_id"] for r in out}
    if name != P.STAGES[-1][0]:
        assert stage(spark, odd, TESTDATA).columns == odd.columns
    assert stage(spark, odd.limit(0), TESTDATA).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES[:-1]])
def test_stages_take_other_columns_with_clashing_names(spark, name):
    odd = docs_of(spark, ODD[3:8]).withColumns({c: F.lit(7) for c in ("run", "node", "keys", "sid", "n", "spans", "score", "class", "place", "no")})
    assert dict(P.STAGES)[name](spark, odd, TESTDATA).columns == odd.columns
