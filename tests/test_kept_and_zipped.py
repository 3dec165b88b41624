"""Retry rounds, kept vectors, rows by position."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.encoders import BatchEncoder, KeptEncoder
from driftline.operators.model_calls import AnswerStore, BatchModel, ask
from driftline.operators.zipping import numbered, zip_rows
from driftline.plans import run as R
from driftline.plans.catalog import QA, Property, Test
from driftline.plans.templates import template
from checks.doubles import HELPER, MODEL

PROMPT = template("it_prompt:paraphrasing")


class InLaterRounds:
    """Writes a line for each question it is asked; the n-th letter's questions fail in n rounds."""

    def __init__(self, path):
        self.path = path

    def __call__(self, chats, round_):
        asked = [chat[-1]["content"].split('"', 1)[1].rsplit('"', 1)[0] for chat in chats]
        with open(self.path, "a") as f:
            f.writelines(f"{round_} {a}\n" for a in asked)
        return [a.upper() if "abcd".index(a[0]) <= round_ else None for a in asked]


def test_rounds_ask_only_what_failed(spark, tmp_path):
    path = str(tmp_path / "asked")
    model = BatchModel("later", InLaterRounds(path), max_retries=1, wait_seconds=0.2, parallelism=2, chunks=2, rounds=3, tell_round=True)
    df = spark.createDataFrame([(i, f"{c}{i % 3}") for i, c in enumerate("aabbccdd" * 3)] + [(99, None)], "row_id bigint, text string")
    store = AnswerStore(spark)
    got = {r["text"]: (r["out"], r["out_status"]) for r in ask(df, model, PROMPT, [F.col("text")], "out", store=store, keep_status=True).collect()}
    assert all(got[t] == ((t.upper(), "ok") if t[0] != "d" else (None, "error")) for t in got if t) and got[None] == (None, None)
    lines = sorted(open(path).read().split("\n")[:-1])
    want = sorted(f"{r} {t}" for t in got if t for r in range(3) if r <= "abcd".index(t[0]))
    assert lines == want
    failures = {r["failed"] for r in store.attempts("later").collect()}
    assert failures == {1, 2, 3}
    # What was answered is never asked again, whatever became of the executors or the run.
    ask(df, model, PROMPT, [F.col("text")], "out", store=store)
    again = sorted(open(path).read().split("\n")[:-1])
    assert {line.split(" ")[1][0] for line in again[len(lines) :] or again if again.count(line) > lines.count(line)} == {"d"}
    assert max(r["failed"] for r in store.attempts("later").collect()) == 6


def load_counts(path):
    def load():
        def encode(texts):
            with open(path, "a") as f:
                f.writelines("t\n" for _ in texts)
            return np.array([[t.count(c) for c in "abcxyz"] for t in texts])

        return encode

    return load


def test_kept_vectors_are_those_of_the_batch_encoder(spark, tmp_path):
    path = str(tmp_path / "encoded")
    rows = [("abc", "abc"), ("abc", "xyz"), ("", "abc"), (None, "a"), ("ab", "bc"), (None, None)] + [("abc", f"a{i}b") for i in range(40)]
    df = spark.createDataFrame([(i, *r, "k") for i, r in enumerate(rows)], "row_id bigint, a string, b string, key string").repartition(4)
    kept = KeptEncoder("counts", load_counts(path), str(tmp_path / "vectors"), parallelism=3)
    plain = BatchEncoder(load_counts(path + "-plain"))
    want = {r["row_id"]: r["s"] for r in df.withColumn("s", plain.similarity(F.col("a"), F.col("b"))).collect()}
    for _ in range(2):
        out = kept.add_similarity(df, F.col("a"), F.col("b"), "s")
        got = {r["row_id"]: r["s"] for r in out.collect()}
        assert out.columns == [*df.columns, "s"] and got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and (want[i] is None or got[i] == pytest.approx(want[i])) for i in want)
        assert len(open(path).readlines()) == len({t for r in rows for t in r if t is not None})
    other = KeptEncoder("other", load_counts(path), str(tmp_path / "vectors"), parallelism=2)
    before = len(open(path).readlines())
    other.add_similarity(df.limit(0), F.col("a"), F.col("b"), "s").count()
    assert len(open(path).readlines()) == before and other.add_similarity(df, F.col("a"), F.col("b"), "s").count() == len(rows)


def test_a_run_with_kept_vectors(spark, tmp_path):
    src = spark.createDataFrame([(i, [f"The cat {i} sat. The dog ran away.", "Where did the dog go?"]) for i in range(5)], "row_id bigint, inputs array<string>")
    test = Test(QA, 102, {"transform": Property("upper", {}), "relation": Property("similar", {"threshold": "0.5"})})
    out = []
    for encoder in (BatchEncoder(load_counts(str(tmp_path / "x"))), KeptEncoder("counts", load_counts(str(tmp_path / "y")), str(tmp_path / "v"), 2)):
        out.append(R.run_task(src, [MODEL], QA, [test], R.Resources(HELPER, encoder)).orderBy("row_id", "variant").collect())
    assert out[0] == out[1] and glob.glob(str(tmp_path / "v" / "manifest"))


def test_rows_by_position(spark):
    left = spark.range(1000).withColumn("v", F.col("id") * 7 % 1000).repartition(6)
    got = numbered(left, "v").collect()
    assert sorted(r["idx"] for r in got) == [*range(1000)] and all(r["idx"] == r["v"] for r in got)
    as_read = numbered(left)
    assert sorted(r["idx"] for r in as_read.collect()) == [*range(1000)]
    right = spark.createDataFrame([(x,) for x in "cab"], "w string")
    zipped, sizes = zip_rows(numbered(left, "v"), numbered(right, F.col("w").desc()))
    assert sizes == {"left": 1000, "right": 3}
    assert sorted((r["idx"], r["v"], r["w"]) for r in zipped.collect()) == [(0, 0, "c"), (1, 1, "b"), (2, 2, "a")]
    nothing, sizes = zip_rows(numbered(left.limit(0), "v"), numbered(right, "w"))
    assert nothing.count() == 0 and sizes == {"left": 0, "right": 3}
    equal = numbered(spark.createDataFrame([(1,)] * 50, "v int").repartition(5), "v")
    assert sorted(r["idx"] for r in equal.collect()) == [*range(50)]
