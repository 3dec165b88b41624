"""The test run: source outputs, follow-up inputs, follow-up outputs, verdicts.

One pass over the source rows of a task makes the follow-up inputs of all its relations: transformations
add array columns, one generator turns them into rows. Nothing is shuffled on the way unless a batch
model is called. Stage functions are public, so a run can stop after any of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import sentences as by_rule
from ..operators.answer_checks import known_or_unknown
from ..operators.char_edits import edit_texts
from ..operators.encoders import Encoder, KeptEncoder
from ..operators.model_calls import AnswerStore, ColumnModel, Model, ask
from ..operators.pools import Pool
from ..operators.registry import (
    CHARACTER_EDITS,
    NEEDS_HELPER_CHECK,
    NEEDS_HELPER_JUDGE,
    NEEDS_KNOWN,
    NEEDS_SIMILARITY,
    RELATIONS,
    TRANSFORMS,
    VERIFIERS,
    differs_at_gate,
    helper_check_needed,
)
from ..operators.rewrites import ROW, Edit, input_at, splice, with_shared_keywords
from ..session import dealt, drop_folder, work_folder
from ..sources.commits import Part, PartTable, append_in_steps, append_results, read_results, result_log
from ..sources.files import cached_inputs
from .catalog import (
    ARITY,
    CHECK_FOLLOWUP,
    CHECK_INPUT,
    CHECK_OUTPUT,
    RELATION,
    SUT_TEMPLATE,
    TRANSFORM,
    RunOptions,
    Test,
    load_tests,
    select_tests,
    test_pairs,
)
from .stages import StageStore, fingerprint, template_text, test_settings
from .templates import template

RECORD_KEYS = ["llm", "task", "mr", "row_id"]
#: Records of rows that meet kept stage tables are written in steps of so many bytes of source inputs.
STEP_BYTES = 512 << 20


@dataclass(frozen=True)
class Resources:
    """Everything a run uses besides the data."""

    helper: Model
    encoder: Encoder
    words: Pool | None = None
    sentences: Pool | None = None
    store: AnswerStore | None = None
    #: Where source outputs and follow-up inputs are kept for other models and later runs; None keeps none.
    stages: StageStore | None = None
    seed: int = 42
    #: How transformations cut texts into sentences: by rule, or by a trained model's ``sentences``.
    split: Callable[[Column], Column] = by_rule
    #: False: the model under test is asked for every row, even where another row has the same question.
    dedup: bool = True


def row_range(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows with ``start <= row_id < end``, only if both are given and not negative. Ids stay as they are."""
    if start is None or end is None or start < 0 or end < 0:
        return df
    return df.where((F.col("row_id") >= start) & (F.col("row_id") < end))


def _inputs(task: str, column: str = "inputs") -> list[Column]:
    return [F.get(F.col(column), F.lit(i)) for i in range(ARITY[task])]


def splitter_name(split: Callable[[Column], Column]) -> str:
    """Tells the rule and models with different words apart."""
    model = getattr(split, "__self__", None)
    return split.__name__ if model is None else model.fingerprint()


def source_outputs(src: DataFrame, model: Model, task: str, res: Resources) -> DataFrame:
    """One answer per source row; all relations of the task share it. With a stage store, rows answered before are not asked."""
    if res.stages is not None:
        print_ = fingerprint(F.col("inputs"), model.name, template_text(template(SUT_TEMPLATE[task])), res.dedup)
        return res.stages.source_outputs(src, model.name, task, print_, lambda rows: source_outputs(rows, model, task, replace(res, stages=None)))
    each, apart = None if res.dedup else F.col("row_id"), ["_at"] if "_at" in src.columns else None
    return ask(src, model, template(SUT_TEMPLATE[task]), _inputs(task), "source_output", "source", store=res.store, each=each, told_apart=apart)


def input_gate(test: Test) -> Column:
    """The source input check looks at the first input."""
    prop = test.props.get(CHECK_INPUT)
    return F.lit(True) if prop is None else VERIFIERS[prop.fn](F.get("inputs", F.lit(0)), None, prop.params)


def followup_inputs(src: DataFrame, tests: list[Test], res: Resources) -> DataFrame:
    """Rows (row_id, ..., mr, vsi, variants) for every source row and test; variants are null where vsi rejects.

    They depend on no model under test. With a stage store they are made once, for all models and runs.
    """
    kept = src.columns
    if res.stages is not None and tests:
        others = [res.seed, res.helper.name, splitter_name(res.split), *(pool.fingerprint() if pool else None for pool in (res.words, res.sentences))]
        made = res.stages.followup_inputs(
            src.select("row_id", "inputs"), tests, lambda t: fingerprint(F.col("inputs"), test_settings(t), others),
            lambda rows, some: followup_inputs(rows, some, replace(res, stages=None)),
        )
        return src.join(made, "row_id").select(*kept, "mr", "vsi", "variants")
    if isinstance(res.helper, ColumnModel):
        # Everything but the edits of characters is an expression: one scan for all other relations.
        spelt = {t.props[TRANSFORM].indices: [] for t in tests if t.props[TRANSFORM].fn in CHARACTER_EDITS}
        for t in tests:
            if t.props[TRANSFORM].fn in CHARACTER_EDITS:
                spelt[t.props[TRANSFORM].indices].append(t)
        edited = [edited_characters(src, some, res) for some in spelt.values()]
        tests = [t for t in tests if t.props[TRANSFORM].fn not in CHARACTER_EDITS]
        if not tests and edited:
            return reduce(DataFrame.unionByName, edited)
        uses = [(t.props[TRANSFORM].fn, sorted({i for s in t.props[TRANSFORM].indices for i in s})) for t in tests]
        df = with_shared_keywords(src, Edit(helper=res.helper, store=res.store), uses)
        for test in tests:
            df = transform_rows(df, test, res, f"v{test.mr}")
        stacked = F.array(
            *[
                F.struct(
                    F.lit(t.mr).alias("mr"),
                    F.coalesce(input_gate(t), F.lit(False)).alias("vsi"),
                    F.when(input_gate(t), F.col(f"v{t.mr}")).alias("variants"),
                )
                for t in tests
            ]
        )
        return reduce(DataFrame.unionByName, edited, df.select(*kept, F.inline(stacked)))

    # Helper questions shuffle: one narrow branch per relation instead of one ever wider row.
    branches = []
    for test in tests:
        gate = F.coalesce(input_gate(test), F.lit(False))
        passed = transform_rows(src.where(gate), test, res, "variants")
        branches.append(passed.select(*kept, F.lit(test.mr).alias("mr"), F.lit(True).alias("vsi"), "variants"))
        if CHECK_INPUT in test.props:
            nothing = F.lit(None).cast("array<array<string>>").alias("variants")
            branches.append(src.where(~gate).select(*kept, F.lit(test.mr).alias("mr"), F.lit(False).alias("vsi"), nothing))
    return reduce(DataFrame.unionByName, branches)


def edited_characters(src: DataFrame, tests: list[Test], res: Resources) -> DataFrame:
    """``followup_inputs`` of tests that edit characters of the same inputs: a row per test before the edit, not a column.

    An Arrow batch then holds as much text as it has rows, not that times the number of tests.
    """
    sets = tests[0].props[TRANSFORM].indices
    changed = sorted({i for s in sets for i in s})
    told = []
    for t in tests:
        edit = Edit(relation=t.mr, seed=res.seed)
        told.append(F.struct(
            F.lit(t.mr).alias("mr"), F.coalesce(input_gate(t), F.lit(False)).alias("vsi"),
            F.lit(CHARACTER_EDITS[t.props[TRANSFORM].fn]).alias("_kind"),
            F.array(*[F.array(F.lit(edit.seed_at(i)).cast("bigint"), F.lit(edit.seed_at(i, 1)).cast("bigint")) for i in changed]).alias("_seeds"),
        ))
    rows = src.select(*src.columns, F.inline(F.array(*told)))
    texts = F.when(F.col("vsi"), F.array(*[input_at(i) for i in changed]))
    rows = rows.withColumn("_edited", edit_texts(texts, F.col(ROW), F.col("_kind"), F.col("_seeds")))
    variants = splice({i: F.get("_edited", F.lit(place)) for place, i in enumerate(changed)}, sets)
    return rows.select(*src.columns, "mr", "vsi", F.when(F.col("vsi"), variants).alias("variants"))


def transform_rows(df: DataFrame, test: Test, res: Resources, out: str) -> DataFrame:
    """Add the array of variants of one test."""
    prop = test.props[TRANSFORM]
    edit = Edit(
        helper=res.helper, words=res.words, sentences=res.sentences, store=res.store, relation=test.mr,
        seed=res.seed, indices=prop.indices, arity=ARITY[test.task], out=out, split=res.split,
    )
    return TRANSFORMS[prop.fn](df, edit, prop.params)


def _by_relation(tests: list[Test], kind: str, build, missing: Column) -> Column:
    """A CASE over ``mr`` with one branch per different property, not one per test."""
    groups: dict[tuple, list[int]] = {}
    for test in tests:
        prop = test.props.get(kind)
        if prop is not None:
            groups.setdefault((prop.fn, tuple(sorted(prop.params.items()))), []).append(test.mr)
    chosen = None
    for (fn, params), mrs in groups.items():
        condition, value = F.col("mr").isin(mrs), build(fn, dict(params))
        chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
    return missing if chosen is None else chosen.otherwise(missing)


def output_gates(df: DataFrame, tests: list[Test], res: Resources) -> DataFrame:
    """Add ``vso``: the source output check, for rows whose source input passed; null otherwise.

    The check depends on the model under test, so it is part of that model's rows and never shared.
    """
    answers: dict[str, str] = {}
    for fn, key in sorted(_helper_checks(tests)):
        if key not in answers:
            answers[key] = f"_check_{len(answers)}"
            mrs = [t.mr for t in tests if CHECK_OUTPUT in t.props and t.props[CHECK_OUTPUT].params.get("template") == key]
            wanted = F.col("mr").isin(mrs) & F.col("vsi") & helper_check_needed(fn, F.col("source_output"))
            df = ask(df, res.helper, template(key), [F.col("source_output")], answers[key], "helper", wanted, res.store)

    def build(fn: str, params: dict) -> Column:
        answer = F.col(answers[params["template"]]) if fn in NEEDS_HELPER_CHECK else None
        return VERIFIERS[fn](F.col("source_output"), answer, params)

    gate = _by_relation(tests, CHECK_OUTPUT, build, F.lit(True))
    return df.withColumn("vso", F.when(F.col("vsi"), gate)).drop(*answers.values())


def _helper_checks(tests: list[Test]) -> set[tuple[str, str]]:
    props = [t.props[CHECK_OUTPUT] for t in tests if CHECK_OUTPUT in t.props]
    return {(p.fn, p.params["template"]) for p in props if p.fn in NEEDS_HELPER_CHECK}


def followup_gates(df: DataFrame, tests: list[Test]) -> DataFrame:
    """Add ``vfi``: the check of the follow-up inputs. ``differs_at`` names an input of the first variant;
    the other checks look at its first input."""
    first = F.get(F.get("variants", F.lit(0)), F.lit(0))

    def build(fn: str, params: dict) -> Column:
        return differs_at_gate(F.col("variants"), params) if fn == "differs_at" else VERIFIERS[fn](first, None, params)

    gate = _by_relation(tests, CHECK_FOLLOWUP, build, F.lit(True))
    return df.withColumn("vfi", F.when(F.col("vsi"), gate))


def failed_gate() -> Column:
    """The first gate that did not say yes: false and null both reject."""
    return (
        F.when(~F.coalesce("vsi", F.lit(False)), "si")
        .when(~F.coalesce("vso", F.lit(False)), "so")
        .when(~F.coalesce("vfi", F.lit(False)), "fi")
    )


def fan_out(df: DataFrame) -> DataFrame:
    """One row per variant; a row without variants stays, with a null variant."""
    others = [c for c in df.columns if c != "variants"]
    return df.select(*others, F.posexplode_outer("variants").alias("variant", "followup_input"))


def followup_outputs(df: DataFrame, model: Model, task: str, res: Resources) -> DataFrame:
    """Ask the model about every variant that passed all gates. The relation id is part of the question's
    purpose: an unchanged prompt is asked again, which is what an unstable model is caught with."""
    purpose = F.concat(F.lit("followup:"), F.col("mr").cast("string"))
    when = F.col("failed").isNull() & F.col("followup_input").isNotNull()
    prompt = template(SUT_TEMPLATE[task])
    each = None if res.dedup else F.concat_ws(":", "row_id", "variant")
    apart = ["_at", "mr", "variant"] if "_at" in df.columns else None
    return ask(df, model, prompt, _inputs(task, "followup_input"), "followup_output", purpose, when, res.store, each=each, told_apart=apart)


def verdicts(df: DataFrame, tests: list[Test], res: Resources) -> DataFrame:
    """Add ``verdict``: true, false, or null where the outputs cannot be judged or were not asked for."""
    source, followup = F.col("source_output"), F.col("followup_output")
    judged = {t.mr: t.props[RELATION] for t in tests}
    answered = followup.isNotNull() & source.isNotNull()
    disguised = [mr for mr, p in judged.items() if p.fn in NEEDS_KNOWN]
    if disguised:
        # These relations look at copies of the answers in which a disguised "unknown" is spelt out.
        wanted = F.col("mr").isin(disguised) & answered
        df = df.withColumns({"_source": source, "_followup": followup})
        for column in ("_source", "_followup"):
            df = known_or_unknown(df, column, res.helper, res.store, wanted)
    close = [mr for mr, p in judged.items() if p.fn in NEEDS_SIMILARITY]
    if close:
        needed = F.col("mr").isin(close) & answered
        pair = [source, followup]
        if disguised:
            spelt_out = F.col("mr").isin(disguised)
            pair = [F.when(spelt_out, F.col(f"_{c}")).otherwise(F.col(f"{c}_output")) for c in ("source", "followup")]
        pair = [F.when(needed, c) for c in pair]
        kept = isinstance(res.encoder, KeptEncoder)
        df = res.encoder.add_similarity(df, *pair, "_similarity") if kept else df.withColumn("_similarity", res.encoder.similarity(*pair))
    helper_columns: dict[str, str] = {}
    for mr, prop in judged.items():
        key = prop.params.get("template")
        if prop.fn in NEEDS_HELPER_JUDGE and key not in helper_columns:
            helper_columns[key] = f"_judge_{len(helper_columns)}"
            mrs = [m for m, p in judged.items() if p.fn in NEEDS_HELPER_JUDGE and p.params.get("template") == key]
            wanted = F.col("mr").isin(mrs) & answered
            df = ask(df, res.helper, template(key), [source, followup], helper_columns[key], "helper", wanted, res.store)

    def build(fn: str, params: dict) -> Column:
        answer = F.col(helper_columns[params["template"]]) if fn in NEEDS_HELPER_JUDGE else None
        a, b = (F.col("_source"), F.col("_followup")) if fn in NEEDS_KNOWN else (source, followup)
        return RELATIONS[fn](a, b, F.col("_similarity") if close else None, answer, params)

    verdict = F.when(answered, _by_relation(tests, RELATION, build, F.lit(None).cast("boolean")))
    return df.withColumn("verdict", verdict).drop("_similarity", "_source", "_followup", *helper_columns.values())


LONG_COLUMNS = [
    "llm", "task", "mr", "row_id", "source_input", "source_output", "variant", "followup_input", "followup_output",
    "verdict", "failed",
]


def judge(answered: DataFrame, model: Model, task: str, tests: list[Test], res: Resources) -> DataFrame:
    """From (row_id, inputs, source_output, mr, vsi, variants) to one row per variant with its verdict."""
    df = followup_gates(output_gates(answered, tests, res), tests).withColumn("failed", failed_gate())
    df = verdicts(followup_outputs(fan_out(df), model, task, res), tests, res)
    return df.select(
        F.lit(model.name).alias("llm"), F.lit(task).alias("task"), "mr", "row_id", F.col("inputs").alias("source_input"),
        *LONG_COLUMNS[5:], *(c for c in df.columns if c == "_at"),
    )


def run_task(src: DataFrame, models: list[Model], task: str, tests: list[Test], res: Resources) -> DataFrame:
    """All tests of one task for all models, in long form.

    With one model and no stage store everything flows through one plan. Otherwise the follow-up inputs are written
    once and joined to each model's source outputs by row: each row meets its own tests only.
    """
    if len(models) == 1 and res.stages is None:
        # A batch model is asked about rows that stay where they are.
        answered = source_outputs(src if isinstance(models[0], ColumnModel) else dealt(src), models[0], task, res)
        return judge(followup_inputs(answered, tests, res), models[0], task, tests, res).select(*LONG_COLUMNS)
    spark = src.sparkSession
    if res.stages is None:
        path = work_folder(spark, "followup_inputs")
        followup_inputs(src, tests, res).select("row_id", "mr", "vsi", "variants").write.parquet(path)
        followups = spark.read.parquet(path)
    else:
        followups = followup_inputs(src.select("row_id", "inputs"), tests, res).drop("inputs")
    results = [
        judge(source_outputs(src, m, task, res).join(followups, "row_id"), m, task, tests, res) for m in models
    ]
    return reduce(DataFrame.unionByName, results)


def records(long: DataFrame) -> DataFrame:
    """One record per (llm, task, mr, row) with its variants as arrays; a group has as many rows as variants."""
    has_variant = F.col("variant").isNotNull()
    entry = F.struct("variant", "followup_input", "followup_output", "verdict")
    grouped = long.groupBy(*RECORD_KEYS).agg(
        F.first("source_input").alias("source_input"),
        F.first("source_output").alias("source_output"),
        F.first("failed").alias("failed"),
        F.sort_array(F.collect_list(F.when(has_variant, entry))).alias("v"),
    )
    asked = F.col("failed").isNull()
    return grouped.select(
        *RECORD_KEYS,
        "source_input",
        "source_output",
        F.when(F.size("v") > 0, F.transform("v", lambda x: x["followup_input"])).alias("followup_inputs"),
        F.when(asked, F.transform("v", lambda x: x["followup_output"])).alias("followup_outputs"),
        F.when(asked, F.transform("v", lambda x: x["verdict"])).alias("relations"),
        F.coalesce(
            "failed", F.when(F.exists("v", lambda x: x["verdict"].isNull()), F.lit("sfoe"))
        ).alias("verif_failure"),
    )


def run_records(src: DataFrame, model: Model, task: str, tests: list[Test], res: Resources) -> DataFrame:
    """As ``records`` of ``run_task`` for one model, without moving texts.

    The rows are dealt once. Their outputs and verdicts come back to them, and the inputs are made where the rows are. Only
    rows whose identifiers repeat are put together as ``records`` does, since such rows share their records.
    """
    if res.stages is not None:
        return records(run_task(src, [model], task, tests, res))
    repeated = src.groupBy("row_id").count().where("count > 1").select(F.col("row_id").alias("_again"))
    together = None
    if not repeated.isEmpty():
        same = F.col("row_id").eqNullSafe(F.col("_again"))
        together = records(run_task(src.join(repeated, same, "left_semi"), [model], task, tests, res))
        src = src.join(repeated, same, "left_anti")
    rows = dealt(src.select("row_id", "inputs"))
    made = followup_inputs(source_outputs(rows, model, task, res), tests, res)
    long = judge(made, model, task, tests, res)
    entry = F.struct("mr", "variant", "source_output", "followup_output", "verdict", "failed")
    told = long.groupBy("_at").agg(F.collect_list(entry).alias("_told"))
    # The inputs are made once more beside their outputs: that is an expression, while a shuffle would carry them all.
    inputs = followup_inputs(rows, tests, res).join(told.hint("shuffle_hash"), "_at")
    mine = F.sort_array(F.filter("_told", lambda t: t["mr"] == F.col("mr")))
    found = inputs.select("row_id", "inputs", "mr", "variants", mine.alias("_v")).where(F.size("_v") > 0).withColumn("failed", F.get("_v", F.lit(0))["failed"])
    asked, has_variant = F.col("failed").isNull(), lambda t: t["variant"].isNotNull()
    outputs = F.filter("_v", has_variant)
    fresh = found.select(
        F.lit(model.name).alias("llm"), F.lit(task).alias("task"), "mr", "row_id", F.col("inputs").alias("source_input"),
        F.get("_v", F.lit(0))["source_output"].alias("source_output"),
        F.when(F.size("variants") > 0, F.col("variants")).alias("followup_inputs"),
        F.when(asked, F.transform(outputs, lambda x: x["followup_output"])).alias("followup_outputs"),
        F.when(asked, F.transform(outputs, lambda x: x["verdict"])).alias("relations"),
        F.coalesce("failed", F.when(F.exists(outputs, lambda x: x["verdict"].isNull()), F.lit("sfoe"))).alias("verif_failure"),
    )
    return fresh if together is None else fresh.unionByName(together)


def alignment_gaps(src: DataFrame, other: DataFrame) -> DataFrame:
    """Data quality: how many rows either side of a stage join lacks (they are left out by the inner join)."""
    missing = src.join(other, "row_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("stage").alias("side"), "n")
    extra = other.join(src, "row_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("source").alias("side"), "n")
    return missing.unionByName(extra)


def finished_rows(done: DataFrame, model: str, task: str, tests: list[Test]) -> DataFrame:
    """Rows whose records of all the given tests are in the result log."""
    mrs = [t.mr for t in tests]
    mine = done.where((F.col("llm") == model) & (F.col("task") == task) & F.col("mr").isin(mrs))
    return mine.groupBy("row_id").agg(F.count_distinct("mr").alias("n")).where(F.col("n") == len(mrs)).select("row_id")


def run_resumable(
    src: DataFrame, model: Model, task: str, tests: list[Test], res: Resources, path: str, run_id: str, chunks: int = 1,
    batch: int | None = None,
) -> DataFrame:
    """Run in separately committed parts of the rows and skip what the result log at ``path`` already holds.

    A crash loses at most one part, as a part shows up as a whole or not at all. The rows are dealt over the chunks once, by
    a hash of their identifiers; a chunk then reads its own rows, and those parts of the log that may hold them. A ``batch``
    that the run has committed before is left out without a look at its rows.
    """
    spark, log, mrs = src.sparkSession, result_log(src.sparkSession, path), sorted(t.mr for t in tests)
    mine = {"llm": model.name, "task": task}
    if batch is not None and any(p.labels == {**p.labels, **mine, "run_id": run_id, "batch": batch, "mrs": mrs} for p in log.parts()):
        return log.read()
    if chunks > 1:
        dealt = work_folder(spark, "chunks")
        src.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks)).cast("int")).write.option("compression", "zstd").partitionBy("chunk").parquet(dealt)
    for chunk in range(chunks):
        part = src if chunks == 1 else spark.read.schema(src.withColumn("chunk", F.lit(0)).schema).parquet(dealt).where(F.col("chunk") == chunk).drop("chunk")
        done = records_of(log, part, mine, mrs, chunks, chunk)
        finished = None
        if done is not None:
            # Told by the identifiers: where all rows are finished, or none is, no text is moved to leave some out.
            finished = finished_rows(done, model.name, task, tests)
            rest, whole = part.select("row_id").join(finished, "row_id", "left_anti").count(), part.count()
            if rest in (0, whole):
                part, finished = part if rest else part.where(F.lit(False)), None
        expressions = isinstance(model, ColumnModel) and isinstance(res.helper, ColumnModel)
        if expressions and res.stages is None:
            # Such a run moves no rows by itself: dealt once as they come, the rows are where their records are made. A task
            # holds several times its texts, so parts are not put together to the size that suits a shuffle.
            part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_id")
        if finished is not None:
            part = part.join(finished, "row_id", "left_anti")
        steps = _steps(part) if expressions and res.stages is not None else 1
        labels = {"chunks": chunks, "chunk": chunk, "mrs": mrs} | ({} if batch is None else {"batch": batch})
        number = chunk if batch is None else batch

        def fresh(rows: DataFrame, done: DataFrame | None = done) -> DataFrame:
            made = records(run_task(rows, [model], task, tests, res))
            if done is None:
                return made
            # By row alone, so that records stay where they were made.
            known = done.groupBy("row_id").agg(F.collect_set("mr").alias("_known")).hint("shuffle_hash")
            kept = made.join(known, "row_id", "left").where(~F.coalesce(F.array_contains("_known", F.col("mr")), F.lit(False)))
            return kept.select(*made.columns)

        if steps == 1:
            append_results(fresh(part), path, run_id, number, **mine, **labels)
        else:
            run_task(part, [model], task, tests, res)  # fills the kept tables, all rows at once
            step = F.when(F.col("row_id").isNotNull(), F.pmod(F.xxhash64("row_id"), F.lit(steps)))
            append_in_steps(spark, (fresh(part.where(step == i)) for i in range(steps)), path, run_id, number, **mine, **labels)
        if chunks > 1:
            drop_folder(spark, f"{dealt}/chunk={chunk}")
        spark.sparkContext._jvm.System.gc()  # what was shuffled for the chunk goes now
    return log.read()


def _steps(rows: DataFrame) -> int:
    """In how many steps records are written: rows and their kept follow-ups are shuffled to meet, a step at a time."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, min(32, -(-size // STEP_BYTES)))


def records_of(log: PartTable, rows: DataFrame, mine: dict, mrs: list[int], chunks: int = 1, chunk: int = 0) -> DataFrame | None:
    """The log's records of one model and task that may belong to the given rows, or None where no part can hold any.

    Parts are chosen by their labels first. Only if some are left, the range of the rows' identifiers is found out and met
    with the parts' ranges.
    """
    def fits(part: Part) -> bool:
        known = part.labels
        same = all(known.get(k, v) == v for k, v in mine.items()) and bool({*known.get("mrs", mrs)} & {*mrs})
        return part.rows > 0 and same and part.shares_chunk(chunks, chunk)

    if not (parts := [p for p in log.parts() if fits(p)]):
        return None
    least, most = rows.agg(F.min("row_id"), F.max("row_id")).first()
    if not (parts := [p for p in parts if p.meets(least, most)]):
        return None
    return log.read(parts).where((F.col("llm") == mine["llm"]) & (F.col("task") == mine["task"]) & F.col("mr").isin(mrs))


def latest_run(log: DataFrame) -> DataFrame:
    """(run_id, part, n): the part of a result log that was committed last, and its size."""
    parts = log.groupBy("run_id", "part").agg(F.max("committed_at").alias("at"), F.count("*").alias("n"))
    return parts.agg(F.max_by(F.struct("run_id", "part", "n"), F.struct("at", "part", "run_id")).alias("last")).select("last.*")


def violation_rates(long: DataFrame) -> DataFrame:
    """Judged variants and violations by (llm, task, mr), with sub-totals.

    Counted conditionally: a filter on the verdict would be pushed down through the projections and have every
    expression that leads to it computed again in the filter. For the same reason, filter the written log of a run
    rather than the plan that makes it.
    """
    return long.rollup("llm", "task", "mr").agg(
        F.count("verdict").alias("judged"), F.sum(F.when(~F.col("verdict"), 1).otherwise(0)).alias("violations")
    )


def with_seed(res: Resources, seed: int) -> Resources:
    return replace(res, seed=seed)


def run_all(
    spark: SparkSession, options: RunOptions, sources: dict[str, DataFrame], models: dict[str, Model], res: Resources,
    catalog: DataFrame, run_id: str = "run",
) -> tuple[DataFrame | None, list[tuple[str, int | None]]]:
    """Run the requested tests of every task with a source for every model, as the options say, and resume what a log holds.

    ``models`` gives a model for each name in the options. Gives the result log and the requests that match no test: these
    are reported and left out. The log is None where nothing was run.

    Every stage has a table in its folder: the source inputs of each task, source outputs and follow-up inputs for all
    models and later runs, answers, and results.
    """
    chosen, unknown = select_tests(test_pairs(catalog), options.requested(spark))
    tests, path = load_tests(catalog, chosen), options.folder("results")
    store = AnswerStore(spark, options.folder("answers"))
    stages = StageStore(spark, options.folder)
    res = replace(res, helper=_with_retries(models[options.helper], options), store=store, stages=stages, seed=options.seed)
    for task, src in sources.items():
        mine = [t for t in tests if t.task == task]
        if not mine:
            continue
        kept = cached_inputs(spark, f"{options.folder('source_inputs')}/{task}", lambda src=src: src)
        for name in options.models:
            rows, model = row_range(kept, options.start_row, options.end_row), _with_retries(models[name], options)
            run_resumable(rows, model, task, mine, res, path, run_id, options.chunks)
    return read_results(spark, path), [(r["task"], r["mr"]) for r in unknown.collect()]


def _with_retries(model: Model, options: RunOptions) -> Model:
    if isinstance(model, ColumnModel):
        return model
    return replace(model, max_retries=options.max_retries, wait_seconds=options.wait_seconds)
