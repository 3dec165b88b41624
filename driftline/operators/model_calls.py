"""Model calls: each distinct question is asked once, the answers are kept, and every row gets its own.

Two kinds of model share one interface, ``ask``:

* ``ColumnModel``: a rule written as a Spark expression. It stays inside the projection.
* ``BatchModel``: a function from chats to answers (an endpoint, a local network). The questions are
  made distinct with a map-side partial aggregation, those already answered are left out, the rest are
  asked in Arrow batches and written to the store in chunks, and the answers are joined back. A lost
  executor repeats only its chunk; a second run asks nothing again.
"""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.templates import Template
from ..session import work_folder
from ..sources.commits import PartTable
from ..sources.files import read_if_exists
from .prompts import messages

# Answers that stand for two kinds of refusal, so that the row survives and is judged.
FILTERED_TEXT = "The response was filtered because of the content of the prompt."
REPETITIVE_TEXT = "The prompt was refused because of repeated patterns."
MANY_RETRIES = 9_999_999

# A question is hot from so many rows on, and from this share of all rows on. So there are 10,000 hot ones at most.
HOT_MINIMUM = 10_000
HOT_SHARE = 1 / 10_000

ANSWER_SCHEMA = "key string, purpose string, output string, status string"
PUT_OFF_SCHEMA = "key string, purpose string, attempt int, not_before timestamp, model string"
STORE_SCHEMA = "key string, output string, status string, model string, purpose string"


class ContentFiltered(Exception):
    """The endpoint refused the prompt because of its content."""


class RepetitivePrompt(Exception):
    """The endpoint refused the prompt because of repeated patterns."""


@dataclass(frozen=True)
class ColumnModel:
    """``rule(template, inputs)`` gives the answer as a column; ``inputs`` are the prompt's columns."""

    name: str
    rule: Callable[[Template, list[Column]], Column]


@dataclass(frozen=True)
class BatchModel:
    """``answer(chats)`` returns one text, or one exception, per chat.

    ``parallelism`` bounds the number of concurrent tasks that call the endpoint, ``chunks`` the number
    of separately committed parts of one stage.

    With ``rounds`` a question that fails is put off instead of holding its task: it goes to the table of put-off questions
    with the number of its attempt and the time before which it isn't asked again, and a later, separately committed round
    asks it, ``rounds`` times in all. Within a round ``max_retries`` counts as before. ``answer`` is told the number of
    the round, from 0, if ``tell_round`` is set.
    """

    name: str
    answer: Callable[[list[list[dict]]], list]
    max_retries: int = -1
    wait_seconds: float = 10.0
    parallelism: int = 64
    chunks: int = 1
    rounds: int = 1
    tell_round: bool = False


Model = ColumnModel | BatchModel


@dataclass
class AnswerStore:
    """Answers kept as a table partitioned by model and purpose."""

    spark: SparkSession
    path: str = field(default="")

    def __post_init__(self):
        self.path = self.path or work_folder(self.spark, "answers")

    def read(self) -> DataFrame | None:
        return read_if_exists(self.spark, self.path, STORE_SCHEMA)

    def append(self, answers: DataFrame) -> None:
        answers.write.mode("append").partitionBy("model", "purpose").parquet(self.path)

    def put_off(self) -> PartTable:
        """The questions that failed: (key, purpose, attempt, not_before, model), one row per failure."""
        return PartTable(self.spark, f"{self.path}-put-off", PUT_OFF_SCHEMA, ("model",), id_col="key")

    def attempts(self, model: str) -> DataFrame:
        """(key, failed, not_before): how often each question failed so far and when it may be asked again."""
        rows = self.put_off().read()
        rows = self.spark.createDataFrame([], PUT_OFF_SCHEMA) if rows is None else rows
        return rows.where(F.col("model") == model).groupBy("key").agg(F.max("attempt").alias("failed"), F.max("not_before").alias("not_before"))


def question_key(model: str, purpose: Column, template: Template, inputs: list[Column], each: Column | None = None) -> Column:
    """One key per (model, purpose, prompt, inputs). The purpose keeps a repeated question a new call; so does ``each``."""
    parts = F.struct(
        F.lit(model).alias("m"),
        purpose.alias("p"),
        F.lit(template.key).alias("t"),
        F.array(*[F.coalesce(i, F.lit("")) for i in inputs]).alias("i"),
        *([] if each is None else [each.cast("string").alias("e")]),
    )
    return F.sha2(F.to_json(parts), 256)


def _call_with_retries(model: BatchModel, chats: list[list[dict]], round_: int = 0) -> list[tuple[str | None, str]]:
    results: list[tuple[str | None, str] | None] = [None] * len(chats)
    waiting = list(range(len(chats)))
    attempts = model.max_retries if model.max_retries and model.max_retries > 0 else MANY_RETRIES
    for attempt in range(attempts):
        try:
            some = [chats[i] for i in waiting]
            answers = list(model.answer(some, round_) if model.tell_round else model.answer(some))
            if len(answers) != len(waiting):
                raise ValueError(f"{len(answers)} replies to {len(waiting)} questions: nobody knows which belongs to which")
        except Exception as error:  # the whole batch failed
            answers = [error] * len(waiting)
        again = []
        for i, answer in zip(waiting, answers):
            if isinstance(answer, ContentFiltered):
                results[i] = (FILTERED_TEXT, "filtered")
            elif isinstance(answer, RepetitivePrompt):
                results[i] = (REPETITIVE_TEXT, "repetitive")
            elif answer is None or isinstance(answer, Exception):
                again.append(i)
            else:
                results[i] = (str(answer), "ok")
        waiting = again
        if not waiting:
            break
        if attempt + 1 < attempts:
            time.sleep(model.wait_seconds)
    return [r if r is not None else (None, "error") for r in results]


def call_batches(questions: DataFrame, model: BatchModel, round_: int = 0) -> DataFrame:
    """(key, purpose, chat) -> (key, purpose, output, status). Rows whose retries run out get status "error" and no output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = [[{"role": m["role"], "content": m["content"]} for m in chat] for chat in batch["chat"]]
            answered = _call_with_retries(model, chats, round_)
            yield batch[["key", "purpose"]].assign(
                output=[a[0] for a in answered], status=[a[1] for a in answered]
            )

    return questions.select("key", "purpose", "chat").mapInPandas(run, ANSWER_SCHEMA)


def join_answers(df: DataFrame, answers: DataFrame, out: str, hot_minimum: int = HOT_MINIMUM) -> DataFrame:
    """Join (key, n, output, status) back on ``_key`` where a few keys may hold most of the rows.

    Hot keys, those with ``HOT_SHARE`` of the rows or more, are split: the answer is copied once for every
    ``hot_minimum`` rows, and each row meets one of the copies. Only hot keys and their numbers of copies are broadcast,
    never answers. Rows without a question (null key) get keys of their own that meet no answer.
    """
    total = answers.agg(F.sum("n")).first()[0] or 0
    least = max(hot_minimum, total * HOT_SHARE)
    copies = F.ceil(F.col("n") / hot_minimum).cast("int")
    split = answers.where(F.col("n") >= least).select(F.col("key").alias("_key"), copies.alias("_copies"))
    scattered = F.xxhash64(*[F.col(c) for c in df.columns if c != "_key"])
    first = df.join(F.broadcast(split), "_key", "left").withColumns(
        {
            "_copy": F.coalesce(F.pmod(scattered, F.col("_copies").cast("bigint")), F.lit(0).cast("bigint")),
            "_key": F.coalesce("_key", F.concat(F.lit("~"), scattered.cast("string"))),
        }
    )
    zero = F.lit(0).cast("bigint")
    numbers = F.when(F.col("n") >= least, F.sequence(zero, copies.cast("bigint") - 1)).otherwise(F.array(zero))
    copied = answers.select("key", "output", "status", F.explode(numbers).alias("copy"))
    told = copied.select(
        F.col("key").alias("_key"), F.col("copy").alias("_copy"), F.col("output").alias(out), F.col("status").alias(f"{out}_status")
    )
    return first.join(told, ["_key", "_copy"], "left").drop("_key", "_copy", "_copies")


def ask(
    df: DataFrame,
    model: Model,
    template: Template,
    inputs: list[Column],
    out: str,
    purpose: str | Column = "helper",
    when: Column | None = None,
    store: AnswerStore | None = None,
    keep_status: bool = False,
    hot_minimum: int = HOT_MINIMUM,
    each: Column | None = None,
    told_apart: list[str] | None = None,
) -> DataFrame:
    """Add the model's answer as column ``out``; rows where ``when`` is not true are not asked and get null.

    Nor is a row asked that lacks one of the inputs: it may come from a call that failed, and a question about an empty
    text would get an answer that looks real. Equal questions are asked once; with ``each`` once for each of its values.

    ``told_apart`` are columns that tell the rows apart, for rows that come from a table ``dealt`` by the first of them: only
    keys and answers are moved then. Each question is put by one of its rows, and the answers come to the rows.
    """
    when = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    for i in inputs:
        when = when & i.isNotNull()
    if isinstance(model, ColumnModel):
        df = df.withColumn(out, F.when(when, model.rule(template, inputs)))
        return df.withColumn(f"{out}_status", F.when(when, F.lit("ok"))) if keep_status else df

    spark = df.sparkSession
    store = store or AnswerStore(spark)
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    keyed = df.withColumn("_key", F.when(when, question_key(model.name, purpose, template, inputs, each)))

    # One row per distinct question with its number of rows, written so that nothing below recomputes it.
    asked_path = work_folder(spark, "questions")
    filled = [F.coalesce(i, F.lit("")) for i in inputs]
    if told_apart:
        places_path = work_folder(spark, "places")
        own = keyed.where(F.col("_key").isNotNull()).select(*told_apart, "_key", purpose.alias("_purpose"))
        own.write.parquet(places_path)
        places = spark.read.schema(own.schema).parquet(places_path)
        by_key = places.groupBy(F.col("_key").alias("key"), F.col("_purpose").alias("purpose"))
        by_key.agg(F.count("*").alias("n"), F.min(F.struct(*told_apart)).alias("first")).write.parquet(asked_path)
    else:
        (
            keyed.where(F.col("_key").isNotNull())
            .select(F.col("_key").alias("key"), purpose.alias("purpose"), F.array(*filled).alias("inputs"))
            .groupBy("key", "purpose", "inputs")
            .agg(F.count("*").alias("n"))
            .write.parquet(asked_path)
        )
    asked = spark.read.parquet(asked_path)

    def chats_of(part: DataFrame) -> DataFrame:
        """(key, purpose, chat) in as many partitions as may call the endpoint."""
        if not told_apart:
            prompt_inputs = [F.get("inputs", F.lit(i)) for i in range(len(inputs))]
            chats = part.select("key", "purpose", messages(template, prompt_inputs).alias("chat"))
            return chats.repartition(model.parallelism, "key")
        at = told_apart[0]
        by_row = part.select("first", "key", "purpose").groupBy(F.col(f"first.{at}").alias(at)).agg(F.collect_list(F.struct("first", "key", "purpose")).alias("_wants"))
        put = df.join(by_row.hint("shuffle_hash"), at)
        mine = F.get(F.filter("_wants", lambda w: w["first"] == F.struct(*told_apart)), F.lit(0))
        chats = put.select(mine.alias("_mine"), F.array(*filled).alias("_inputs")).where("_mine IS NOT NULL")
        prompt_inputs = [F.get("_inputs", F.lit(i)) for i in range(len(inputs))]
        return chats.select("_mine.key", "_mine.purpose", messages(template, prompt_inputs).alias("chat")).coalesce(model.parallelism)

    known = _known_answers(store, model, asked)
    open_questions = asked if known is None else asked.join(known, "key", "left_anti")
    for round_ in range(model.rounds):
        for chunk in range(model.chunks):
            part = open_questions.where(F.pmod(F.xxhash64("key"), F.lit(model.chunks)) == chunk)
            answered = call_batches(chats_of(part), model, round_).withColumn("model", F.lit(model.name))
            if model.rounds == 1:
                store.append(answered.where("status <> 'error'"))
            else:
                _commit_round(answered, model, store)
        if round_ + 1 < model.rounds:
            failed = store.attempts(model.name).join(asked, "key", "left_semi").join(_known_answers(store, model, asked), "key", "left_anti")
            failed = failed.select("key", "not_before")
            until = failed.agg(F.max("not_before")).first()[0]
            if until is None:
                break
            # The driver waits, no task does.
            time.sleep(max(0.0, until.timestamp() - time.time()))
            open_questions = asked.join(failed.select("key"), "key", "left_semi")

    known = _known_answers(store, model, asked)
    answers = asked.select("key", "n")
    if known is None:
        answers = answers.withColumns({"output": F.lit(None).cast("string"), "status": F.lit("error")})
    else:
        answers = answers.join(known, "key", "left").withColumn("status", F.coalesce("status", F.lit("error")))
    # This stage's answers are written to a folder of their own. Two reads of the growing store in one plan would be
    # taken for the same scan (equal root path) and the later one answered with the files of the earlier one.
    answers_path = work_folder(spark, "stage-answers")
    answers.write.parquet(answers_path)
    answers = spark.read.parquet(answers_path)
    if told_apart:
        result = _bring_answers(df, join_answers(places.drop("_purpose"), answers, out, hot_minimum), out, told_apart)
    else:
        result = join_answers(keyed, answers, out, hot_minimum)
    return result if keep_status else result.drop(f"{out}_status")


def _bring_answers(df: DataFrame, answered: DataFrame, out: str, told_apart: list[str]) -> DataFrame:
    """Join (*told_apart, out, status) to rows that are dealt by the first of these columns: the rows stay where they are."""
    at, more = told_apart[0], told_apart[1:]
    told = answered.groupBy(at).agg(F.collect_list(F.struct(*more, out, f"{out}_status")).alias("_told"))
    mine = F.get(F.filter("_told", lambda t: F.struct(*[t[c] for c in more]) == F.struct(*more)) if more else F.col("_told"), F.lit(0))
    joined = df.join(told.hint("shuffle_hash"), at, "left").withColumn("_told", mine)
    return joined.withColumns({c: F.col("_told")[c] for c in (out, f"{out}_status")}).select(*df.columns, out, f"{out}_status")


def _commit_round(answered: DataFrame, model: BatchModel, store: AnswerStore) -> None:
    """Write what a round was told once, then keep the answers and put the failures off."""
    path = work_folder(answered.sparkSession, "round")
    answered.write.parquet(path)
    told = answered.sparkSession.read.parquet(path)
    store.append(told.where("status <> 'error'"))
    later = datetime.now(timezone.utc) + timedelta(seconds=model.wait_seconds)
    before = store.attempts(model.name).select("key", "failed")
    failed = told.where("status = 'error'").join(before, "key", "left").select(
        "key", "purpose", (F.coalesce("failed", F.lit(0)) + 1).alias("attempt"), F.lit(later).alias("not_before"), "model"
    )
    store.put_off().append(failed, model=model.name)


def _known_answers(store: AnswerStore, model: BatchModel, asked: DataFrame) -> DataFrame | None:
    """(key, output, status) of this model, one row per key even where two runs stored the same key."""
    table = store.read()
    if table is None:
        return None
    purposes = [r["purpose"] for r in asked.select("purpose").distinct().collect()]
    return (
        table.where((F.col("model") == model.name) & F.col("purpose").isin(purposes))
        .groupBy("key")
        .agg(F.min(F.struct("output", "status")).alias("a"))
        .select("key", "a.output", "a.status")
    )
