"""The catalog of tests: which transformation, output relation and verifiers each (task, relation) uses.

The catalog is a few hundred short rows. It is kept as small tables so that users add tasks and
relations as rows, and it is merged with ordinary joins: general entries flow into every task unless a
task overrides or excludes them, then per-task rules replace or complete properties.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .templates import templates_table

GENERAL = "general"
QA, NLI, SENTIMENT, RE = "question_answering", "inference", "sentiment_analysis_continuous", "relation_extraction"
TASKS = (QA, NLI, SENTIMENT, RE)
ARITY = {QA: 2, NLI: 2, SENTIMENT: 1, RE: 3}
SUT_TEMPLATE = {task: f"sut_prompt:{task}" for task in TASKS}

TRANSFORM, RELATION, CHECK_INPUT, CHECK_OUTPUT, CHECK_FOLLOWUP = "transform", "relation", "vsi", "vso", "vfi"

# The general relations as (id, transformation, its parameters, output relation).
GENERAL_RELATIONS = (
    (49, "no_change", {}, "equivalent"),
    (8, "replace_synonym", {}, "equivalent"),
    (51, "rewrite", {"template": "it_prompt:paraphrasing"}, "equivalent"),
    (120, "back_translate", {}, "equivalent"),
    (127, "rewrite", {"template": "it_prompt:misspell"}, "equivalent"),
    (9, "rewrite", {"template": "it_prompt:word_insertion"}, "equivalent"),
    (149, "rewrite_sentences", {"template": "it_prompt:singular_plural"}, "equivalent"),
    (155, "rewrite", {"template": "it_prompt:tense_change"}, "equivalent"),
    (136, "rewrite", {"template": "it_prompt:passive_active"}, "equivalent"),
    (152, "negate", {}, "different"),
    (10, "replace_antonym", {}, "different"),
    (84, "append_random_sentence", {}, "equivalent"),
    (137, "replace_category", {}, "equivalent"),
    (34, "remove_keywords", {}, "different"),
    (25, "replace_random", {}, "different"),
    (102, "upper", {}, "equivalent"),
    (19, "shuffle_sentences", {}, "equivalent"),
    (126, "typos", {"kind": "keyboard"}, "equivalent"),
    (128, "typos", {"kind": "ocr"}, "equivalent"),
    (7, "scramble_inside_words", {}, "equivalent"),
    (1, "replace_characters", {}, "equivalent"),
    (2, "delete_characters", {}, "equivalent"),
    (4, "add_characters", {}, "equivalent"),
    (5, "add_spaces", {}, "equivalent"),
    (6, "swap_characters", {}, "equivalent"),
    (3, "leet", {}, "equivalent"),
)
GENERAL_CHECKS = ((19, CHECK_INPUT, "has_sentences", {"minimum": "2"}),)
# General relations a task does not take over.
EXCEPTIONS = (
    (149, NLI),
    (155, SENTIMENT),
    (136, SENTIMENT),
    (84, SENTIMENT),
    (19, SENTIMENT),
    (19, NLI),
)
FIRST, EITHER = "[[0]]", "[[0],[1]]"
ALL_SETS = "[[0],[1],[0,1]]"


def _difference_checks(task: str, fn: str, params: dict) -> tuple:
    return tuple((task, mr, CHECK_OUTPUT, fn, params) for mr in (152, 10, 34, 25))


# Properties that belong to one task, as (task, id, property, function, parameters).
TASK_PROPERTIES = (
    (QA, 9, TRANSFORM, "rewrite", {"template": "it_prompt:word_insertion", "transform_indices": FIRST}),
    (QA, 19, TRANSFORM, "shuffle_sentences", {"transform_indices": FIRST}),
    (QA, 137, TRANSFORM, "replace_category_qa", {}),
    (QA, 152, TRANSFORM, "negate_qa", {}),
    (QA, 10, TRANSFORM, "replace_antonym_qa", {}),
    (QA, 34, TRANSFORM, "remove_keywords_qa", {}),
    (QA, 25, TRANSFORM, "replace_random_qa", {}),
    *_difference_checks(QA, "not_in_set_of", {"value": "unknown"}),
    (NLI, 77, TRANSFORM, "append_generated",
     {"template": "it_prompt:generate_premesis_from_hypothesis", "transform_indices": "[[0]]"}),
    (NLI, 78, TRANSFORM, "append_generated",
     {"template": "it_prompt:generate_hypothesis_from_premesis", "transform_indices": "[[1]]"}),
    (NLI, 79, TRANSFORM, "rewrite",
     {"template": "it_prompt:generate_hypothesis_from_hypothesis", "transform_indices": "[[1]]"}),
    (NLI, 80, TRANSFORM, "rewrite",
     {"template": "it_prompt:generate_hypothesis_from_premesis", "transform_indices": "[[0]]"}),
    (NLI, 77, RELATION, "equivalent", {}),
    (NLI, 78, RELATION, "equivalent", {}),
    (NLI, 79, RELATION, "not_inverse", {"first": "entailment", "second": "contradiction"}),
    (NLI, 80, RELATION, "not_inverse", {"first": "entailment", "second": "contradiction"}),
    (NLI, 77, CHECK_OUTPUT, "equals", {"value": "entailment"}),
    (NLI, 78, CHECK_OUTPUT, "equals", {"value": "entailment"}),
    (NLI, 79, CHECK_OUTPUT, "equals", {"value": "entailment"}),
    (NLI, 80, CHECK_OUTPUT, "equals", {"value": "entailment"}),
    (NLI, 9, TRANSFORM, "rewrite", {"template": "it_prompt:word_insertion", "transform_indices": FIRST}),
    (NLI, 84, TRANSFORM, "append_random_sentence", {"transform_indices": FIRST}),
    (NLI, 10, TRANSFORM, "replace_antonym", {"transform_indices": EITHER}),
    *_difference_checks(NLI, "not_in_set_of", {"value": "neutral"}),
    (RE, 141, TRANSFORM, "permute", {"permute_to": "[0,2,1]"}),
    (RE, 142, TRANSFORM, "permute", {"permute_to": "[0,2,1]"}),
    (RE, 57, TRANSFORM, "rewrite", {"template": "it_prompt:declarative_interrogative"}),
    (RE, 141, RELATION, "similar", {"threshold": "0.4"}),
    (RE, 142, RELATION, "helper_says_true", {"template": "or_prompt:re_opposite_relation"}),
    (RE, 57, RELATION, "similar", {"threshold": "0.4"}),
    (RE, 141, CHECK_OUTPUT, "symmetric", {"template": "verify_prompt:re_symmetry"}),
    (RE, 142, CHECK_OUTPUT, "asymmetric", {"template": "verify_prompt:re_symmetry"}),
    (RE, 152, TRANSFORM, "negate_re", {}),
    (RE, 10, TRANSFORM, "replace_antonym_re", {}),
    (RE, 34, TRANSFORM, "remove_keywords_re", {}),
    (RE, 25, TRANSFORM, "replace_random_re", {}),
    (RE, 137, TRANSFORM, "replace_category_re", {}),
    *_difference_checks(RE, "not_in_set_of", {"value": "no relation"}),
    (SENTIMENT, 150, TRANSFORM, "exclaim", {}),
    (SENTIMENT, 151, TRANSFORM, "rewrite", {"template": "it_prompt:emphasis_words"}),
    (SENTIMENT, 154, TRANSFORM, "rewrite", {"template": "it_prompt:capitalize_words"}),
    (SENTIMENT, 150, RELATION, "stronger", {}),
    (SENTIMENT, 151, RELATION, "stronger", {}),
    (SENTIMENT, 154, RELATION, "stronger", {}),
    (SENTIMENT, 150, CHECK_OUTPUT, "differs_from_number", {"value": "0.5"}),
    (SENTIMENT, 151, CHECK_OUTPUT, "differs_from_number", {"value": "0.5"}),
    (SENTIMENT, 154, CHECK_OUTPUT, "differs_from_number", {"value": "0.5"}),
    (SENTIMENT, 102, RELATION, "same_or_stronger", {}),
    *_difference_checks(SENTIMENT, "out_of_range", {"start": "0.4", "end": "0.6"}),
)
# Per-task replacement of one function by another.
REPLACEMENTS = (
    (QA, RELATION, "equivalent", "similar", {"threshold": "0.4"}),
    (QA, RELATION, "different", "not_similar", {"threshold": "0.8"}),
    (RE, RELATION, "equivalent", "similar", {"threshold": "0.4"}),
    (RE, RELATION, "different", "not_similar", {"threshold": "0.8"}),
    (SENTIMENT, RELATION, "equivalent", "equivalent_numeric", {"error": "0.11"}),
    (SENTIMENT, RELATION, "different", "different_numeric", {"error": "0.11"}),
)
# Per-task defaults for parameters that are not given.
DEFAULTS = (
    (QA, TRANSFORM, {"transform_indices": ALL_SETS}),
    (NLI, TRANSFORM, {"transform_indices": ALL_SETS}),
)

PARAMS = T.MapType(T.StringType(), T.StringType())
PROPERTY_SCHEMA = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("mr", T.IntegerType()),
        T.StructField("prop", T.StringType()),
        T.StructField("fn", T.StringType()),
        T.StructField("params", PARAMS),
    ]
)


def property_rows() -> list[tuple]:
    rows = [(GENERAL, mr, TRANSFORM, fn, params) for mr, fn, params, _ in GENERAL_RELATIONS]
    rows += [(GENERAL, mr, RELATION, relation, {}) for mr, _, _, relation in GENERAL_RELATIONS]
    rows += [(GENERAL, mr, prop, fn, params) for mr, prop, fn, params in GENERAL_CHECKS]
    return rows + list(TASK_PROPERTIES)


def properties_table(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """All properties as rows; ``more`` adds a user's own."""
    return spark.createDataFrame([*property_rows(), *more], PROPERTY_SCHEMA)


def exceptions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXCEPTIONS), "mr int, task string")


def replacements_table(spark: SparkSession) -> DataFrame:
    schema = "task string, prop string, from_fn string, to_fn string, to_params map<string,string>"
    return spark.createDataFrame(list(REPLACEMENTS), schema)


def defaults_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULTS), "task string, prop string, defaults map<string,string>")


def tasks_table(spark: SparkSession, tasks=TASKS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tasks], "task string")


def resolve_templates(props: DataFrame, templates: DataFrame) -> DataFrame:
    """Look up ``params['template']``: its ``multi_input`` flag joins the parameters and wins over a given one.

    A name without a template is an error.
    """
    known = templates.select(F.concat_ws(":", "category", "name").alias("template"), "multi_input")
    joined = props.withColumn("template", F.col("params")["template"]).join(known, "template", "left")
    missing = F.col("template").isNotNull() & F.col("multi_input").isNull()
    resolved = (
        F.when(missing, F.raise_error(F.concat(F.lit("no template "), "template")).cast(PARAMS))
        .when(F.col("template").isNull(), F.col("params"))
        .otherwise(_overlay(F.col("params"), F.create_map(F.lit("multi_input"), F.col("multi_input").cast("string"))))
    )
    return joined.withColumn("params", resolved).select("task", "mr", "prop", "fn", "params")


def _overlay(base, top):
    """Entries of both maps; those of ``top`` win."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k))
    return F.map_concat(kept, top)


def inherit_ids(props: DataFrame, tasks: DataFrame, exceptions: DataFrame) -> DataFrame:
    """A task takes every general relation it neither defines itself nor excludes."""
    general = props.where(F.col("task") == GENERAL).drop("task").crossJoin(F.broadcast(tasks))
    explicit = props.where(F.col("task") != GENERAL)
    taken = general.join(explicit.select("task", "mr").distinct(), ["task", "mr"], "left_anti").join(
        exceptions, ["task", "mr"], "left_anti"
    )
    return explicit.unionByName(taken.select("task", "mr", "prop", "fn", "params"))


def inherit_properties(props: DataFrame, general_props: DataFrame) -> DataFrame:
    """A relation that a task defines takes the properties it leaves out from the general one."""
    general = general_props.where(F.col("task") == GENERAL).drop("task")
    missing = (
        props.select("task", "mr").distinct().join(general, "mr").join(props, ["task", "mr", "prop"], "left_anti")
    )
    return props.unionByName(missing.select("task", "mr", "prop", "fn", "params"))


def apply_replacements(props: DataFrame, replacements: DataFrame) -> DataFrame:
    rules = replacements.withColumnRenamed("from_fn", "fn")
    return props.join(rules, ["task", "prop", "fn"], "left").select(
        "task", "mr", "prop", F.coalesce("to_fn", "fn").alias("fn"),
        F.when(F.col("to_fn").isNotNull(), F.col("to_params")).otherwise(F.col("params")).alias("params"),
    )


def apply_defaults(props: DataFrame, defaults: DataFrame) -> DataFrame:
    filled = F.when(F.col("defaults").isNull(), F.col("params")).otherwise(_overlay(F.col("defaults"), F.col("params")))
    return props.join(defaults, ["task", "prop"], "left").select("task", "mr", "prop", "fn", filled.alias("params"))


def merged_catalog(spark: SparkSession, more: list[tuple] = (), tasks=TASKS) -> DataFrame:
    """The full catalog: one row per (task, mr, prop). General rows and exceptions are gone."""
    raw = resolve_templates(properties_table(spark, more), templates_table(spark))
    props = inherit_ids(raw, tasks_table(spark, tasks), exceptions_table(spark))
    props = inherit_properties(props, raw)
    props = apply_replacements(props, replacements_table(spark))
    return apply_defaults(props, defaults_table(spark))


def test_pairs(catalog: DataFrame) -> DataFrame:
    return catalog.select("task", "mr").distinct()


def select_tests(pairs: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests to run, requests that match nothing). A request is (task, mr); a null mr asks for all of the task."""
    whole = requested.where("mr IS NULL").select("task").distinct()
    single = requested.where("mr IS NOT NULL").select("task", "mr").distinct()
    chosen = pairs.join(whole, "task", "left_semi").unionByName(pairs.join(single, ["task", "mr"], "left_semi")).distinct()
    unknown = (
        single.join(pairs, ["task", "mr"], "left_anti")
        .unionByName(whole.join(pairs, "task", "left_anti").withColumn("mr", F.lit(None).cast("int")))
    )
    return chosen, unknown


@dataclass(frozen=True)
class Property:
    fn: str
    params: dict[str, str]

    @property
    def indices(self) -> tuple[tuple[int, ...], ...]:
        return tuple(tuple(s) for s in json.loads(self.params.get("transform_indices", FIRST)))


@dataclass(frozen=True)
class Test:
    """One (task, relation) with its properties, as the driver needs it to put the plan together."""

    __test__ = False  # its name is no sign of a test case

    task: str
    mr: int
    props: dict[str, Property] = field(default_factory=dict)


def load_tests(catalog: DataFrame, pairs: DataFrame | None = None) -> list[Test]:
    """The chosen tests as Python objects: a few hundred rows of configuration, no data."""
    rows = catalog if pairs is None else catalog.join(pairs, ["task", "mr"], "left_semi")
    tests: dict[tuple[str, int], Test] = {}
    for row in rows.orderBy("task", "mr", "prop").collect():
        test = tests.setdefault((row["task"], row["mr"]), Test(row["task"], row["mr"], {}))
        test.props[row["prop"]] = Property(row["fn"], dict(row["params"]))
    return list(tests.values())


@dataclass(frozen=True)
class RunOptions:
    """Options of a run with their defaults. The helper model defaults to the first model under test."""

    tasks: dict[str, list[int]] = field(default_factory=dict)
    run_all: bool = False
    models: tuple[str, ...] = ()
    helper_model: str | None = None
    start_row: int = -1
    end_row: int = -1
    chunks: int = 1
    seed: int = 42
    max_retries: int = -1
    wait_seconds: float = 10.0
    base_folder: str = "runs"
    stage_folders: dict[str, str] = field(default_factory=dict)

    STAGES = ("source_inputs", "source_outputs", "followup_inputs", "answers", "results")

    @property
    def helper(self) -> str | None:
        return self.helper_model or (self.models[0] if self.models else None)

    def folder(self, stage: str) -> str:
        if stage not in self.STAGES:
            raise KeyError(f"no stage {stage!r}")
        return f"{self.stage_folders.get(stage, self.base_folder)}/{stage}"

    def requested(self, spark: SparkSession, tasks=TASKS) -> DataFrame:
        wanted = {t: [] for t in tasks} if self.run_all else self.tasks
        rows = [(t, mr) for t, mrs in wanted.items() for mr in (mrs or [None])]
        return spark.createDataFrame(rows, "task string, mr int")
