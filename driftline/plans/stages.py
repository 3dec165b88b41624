"""Stage tables that are kept: source outputs and follow-up inputs, shared by models, relations and runs.

Every row is kept with a fingerprint of all that its value depends on. A run takes what is there under its fingerprints and
computes the rest, which is committed for later runs. So a change of a prompt, a seed, an input or a setting computes the
rows again that it touches, and no others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.commits import Part, PartTable
from .catalog import Test
from .templates import ALL_TEMPLATES, Template

KEPT_KEYS = "row_id bigint, print string"
SOURCE_OUTPUTS = f"{KEPT_KEYS}, source_output string, llm string, task string"
FOLLOWUP_INPUTS = f"{KEPT_KEYS}, vsi boolean, variants array<array<string>>, task string, mr int"


def fingerprint(inputs: Column, *settings) -> Column:
    """SHA-256 of a row's inputs and of everything else that a stage's value depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(json.dumps(settings, sort_keys=True, default=str)).alias("s"), inputs.alias("i")), {"ignoreNullFields": "false"}), 256)


def template_text(template: Template) -> list:
    return [template.key, template.prompt, template.examples, template.multi_input]


def test_settings(test: Test) -> list:
    """What a test's follow-up inputs depend on besides the rows: its properties, with the text of the prompts they name."""
    used = []
    for kind, prop in sorted(test.props.items()):
        named = [template_text(ALL_TEMPLATES[v]) for v in prop.params.values() if v in ALL_TEMPLATES]
        used.append([kind, prop.fn, sorted(prop.params.items()), prop.indices, named])
    return [test.task, test.mr, used]


def _once(kept: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key. Only the keys are moved to find out whether any comes twice, as after two runs at the same time."""
    return kept if kept.groupBy(*keys).count().where("count > 1").isEmpty() else kept.dropDuplicates(keys)


def _met(rows: DataFrame, kept: DataFrame, more: list[str], how: str = "inner") -> DataFrame:
    """Join by ``row_id`` and ``more``, but dealt by ``row_id`` alone: later steps meet and group the same rows where they are."""
    told = kept.select(F.col("row_id").alias("_row_id"), *[F.col(c).alias(f"_{c}") for c in more], *[c for c in kept.columns if c in ("source_output", "vsi", "variants")])
    same = [F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)) for c in more]
    return rows.join(told, reduce(Column.__and__, same, F.col("row_id") == F.col("_row_id")), how)


@dataclass
class StageStore:
    """``folder(stage)`` says where the tables of a stage are."""

    spark: SparkSession
    folder: Callable[[str], str]

    def table(self, stage: str) -> PartTable:
        if stage == "source_outputs":
            return PartTable(self.spark, self.folder(stage), SOURCE_OUTPUTS, ("llm", "task"))
        return PartTable(self.spark, self.folder(stage), FOLLOWUP_INPUTS, ("task", "mr"))

    def source_outputs(self, src: DataFrame, llm: str, task: str, print_: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``src`` with ``source_output``. ``compute`` gives it for the rows that have none under their fingerprint.

        Answers that are missing (failed calls) are not kept, so a later run asks again.
        """
        keyed = src.withColumn("print", print_)
        table = self.table("source_outputs")
        parts = [p for p in table.parts() if (p.labels["llm"], p.labels["task"]) == (llm, task)]
        before = self._kept(table, keyed, parts)
        missing = keyed if before is None else keyed.join(before, ["row_id", "print"], "left_anti")
        if before is None or not missing.isEmpty():
            fresh = compute(missing).where("source_output IS NOT NULL")
            columns = ["row_id", "print", "source_output", F.lit(llm).alias("llm"), F.lit(task).alias("task")]
            parts.append(table.append(fresh.select(*columns), llm=llm, task=task))
        kept = _once(table.read(parts), ["row_id", "print"])
        return _met(keyed, kept, ["print"], "left").select(*src.columns, "source_output")

    def followup_inputs(
        self, src: DataFrame, tests: list[Test], print_of: Callable[[Test], Column], compute: Callable[[DataFrame, list[Test]], DataFrame]
    ) -> DataFrame:
        """(row_id, mr, vsi, variants) of every row and test. ``compute`` gives them for some rows and some tests.

        What is computed is what at least one row lacks of a test, for rows that lack at least one of those tests.
        """
        task, table = tests[0].task, self.table("followup_inputs")
        mrs = [t.mr for t in tests]
        wanted = src.select("row_id", F.inline(F.array(*[F.struct(F.lit(t.mr).alias("mr"), print_of(t).alias("print")) for t in tests])))
        parts = [p for p in table.parts() if p.labels["task"] == task and {*p.labels["mrs"]} & {*mrs}]
        before = self._kept(table, src, parts)
        missing = wanted if before is None else wanted.join(before, ["row_id", "mr", "print"], "left_anti")
        lacking = {*mrs} if before is None else {r["mr"] for r in missing.select("mr").distinct().collect()}  # one row per test
        if lacking:
            some = src if before is None else src.join(missing.select("row_id").distinct(), "row_id", "left_semi")
            if before is None and src.groupBy("row_id").count().where("count > 1").isEmpty():
                # Rows that all lack all tests bring their fingerprints with them: nothing is moved to meet what is missing.
                place = F.array_position(F.lit(mrs), F.col("mr")).cast("int") - 1
                carried = some.where("row_id IS NOT NULL").withColumn("_prints", F.array(*[print_of(t) for t in tests]))
                made = compute(carried, tests).withColumn("print", F.get("_prints", place))
            else:
                made = compute(some, [t for t in tests if t.mr in lacking]).select("row_id", "mr", "vsi", "variants").join(missing, ["row_id", "mr"])
            columns = ["row_id", "print", "vsi", "variants", F.lit(task).alias("task"), F.col("mr").cast("int").alias("mr")]
            parts.append(table.append(made.select(*columns), task=task, mrs=sorted(lacking)))
        kept = _once(table.read(parts), ["row_id", "mr", "print"])
        return _met(wanted, kept, ["mr", "print"]).select("row_id", "mr", "vsi", "variants")

    @staticmethod
    def _kept(table: PartTable, rows: DataFrame, parts: list[Part]) -> DataFrame | None:
        """The kept rows of those of the parts that may meet the given rows; None where there are none."""
        if not any(p.rows for p in parts):
            return None
        least, most = rows.agg(F.min("row_id"), F.max("row_id")).first()
        met = [p for p in parts if p.meets(least, most)]
        return table.read(met) if met else None
