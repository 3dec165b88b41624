"""The catalog of tests and the work it plans over the task data."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driftline.plans import catalog as C
from driftline.plans.templates import ALL_TEMPLATES, templates_table
from driftline.sources.tasks import viable_relations

from . import sqltext as S
from .registry import query
from .views import inference_raw, question_raw, relation_raw, sentiment_raw

VIEW_OF = {C.QA: "qa_raw", C.NLI: "nli_raw", C.SENTIMENT: "sst_raw", C.RE: "re_raw"}


def row_counts(spark, sf):
    """How many source rows each task has."""
    raws = {
        C.QA: question_raw(spark, sf),
        C.NLI: inference_raw(spark, sf),
        C.SENTIMENT: sentiment_raw(spark, sf),
        C.RE: viable_relations(relation_raw(spark, sf)),
    }
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(t).alias("task"), "rows") for t, df in raws.items()]
    return reduce(DataFrame.unionByName, counts)


COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS task, count(*) AS rows FROM {v}" + (" WHERE len(labels) > 0" if v == "re_raw" else "") for t, v in VIEW_OF.items()
)


def text_of(params):
    """Parameters as one text, for a comparison across engines."""
    return ";".join(f"{k}={v}" for k, v in sorted(params.items()))


def params_text(column="params"):
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else S.lit(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + ")"


MULTI = {t.key: str(t.multi_input).lower() for t in ALL_TEMPLATES.values()}
RAW = values([(task, mr, prop, fn, text_of(params)) for task, mr, prop, fn, params in C.property_rows()])
TEMPLATES = values(sorted(MULTI.items()))
STEPS = {
    "counts": COUNTS_SQL,
    "props": f"""SELECT task, mr, prop, fn, CASE WHEN multi IS NULL THEN params ELSE 'multi_input=' || multi || ';' || params END AS params
        FROM {RAW} p(task, mr, prop, fn, params)
        LEFT JOIN {TEMPLATES} t(template, multi) ON t.template = regexp_extract(p.params, 'template=([^;]*)', 1)""",
    "tasks": f"SELECT * FROM {values([(t,) for t in C.TASKS])} t(task)",
    "exceptions": f"SELECT * FROM {values(C.EXCEPTIONS)} t(mr, task)",
    "inherited": """SELECT task, mr, prop, fn, params FROM props WHERE task <> 'general' UNION ALL
        SELECT t.task, g.mr, g.prop, g.fn, g.params FROM props g, tasks t WHERE g.task = 'general'
        AND NOT EXISTS (SELECT 1 FROM props x WHERE x.task = t.task AND x.mr = g.mr)
        AND NOT EXISTS (SELECT 1 FROM exceptions e WHERE e.task = t.task AND e.mr = g.mr)""",
    "completed": """SELECT * FROM inherited UNION ALL
        SELECT i.task, g.mr, g.prop, g.fn, g.params FROM (SELECT DISTINCT task, mr FROM inherited) i
        JOIN props g ON g.task = 'general' AND g.mr = i.mr
        WHERE NOT EXISTS (SELECT 1 FROM inherited x WHERE x.task = i.task AND x.mr = i.mr AND x.prop = g.prop)""",
    "rules": f"SELECT * FROM {values([(t, p, f, g, text_of(k)) for t, p, f, g, k in C.REPLACEMENTS])} t(task, prop, fn, to_fn, to_params)",
    "replaced": """SELECT c.task, c.mr, c.prop, coalesce(r.to_fn, c.fn) AS fn, coalesce(r.to_params, c.params) AS params
        FROM completed c LEFT JOIN rules r USING (task, prop, fn)""",
    "defaults": f"SELECT * FROM {values([(t, p, text_of(k)) for t, p, k in C.DEFAULTS])} t(task, prop, extra)",
    "merged": """SELECT r.task, r.mr, r.prop, r.fn, CASE WHEN d.extra IS NULL OR r.params LIKE '%transform_indices=%' THEN r.params
        WHEN r.params = '' THEN d.extra ELSE r.params || ';' || d.extra END AS params
        FROM replaced r LEFT JOIN defaults d USING (task, prop)""",
}


def up_to(step: str) -> dict[str, str]:
    names = list(STEPS)
    return {n: STEPS[n] for n in names[: names.index(step) + 1]}


def stage_query(name, step, build):
    """Register (task, mr, prop, fn, params) after one merge step, with the number of rows each entry applies to."""
    sql = f"SELECT s.task, mr, prop, fn, params, c.rows FROM {step} s LEFT JOIN counts c ON c.task = s.task"

    @query(name, S.with_views(sql, *VIEW_OF.values(), **up_to(step)))
    def run(spark, sf):
        stage = build(spark).join(row_counts(spark, sf), "task", "left")
        return stage.select("task", "mr", "prop", "fn", params_text().alias("params"), "rows")


def resolved(spark):
    return C.resolve_templates(C.properties_table(spark), templates_table(spark))


def inherited(spark):
    return C.inherit_ids(resolved(spark), C.tasks_table(spark), C.exceptions_table(spark))


def completed(spark):
    return C.inherit_properties(inherited(spark), resolved(spark))


def replaced(spark):
    return C.apply_replacements(completed(spark), C.replacements_table(spark))


stage_query("c1_template_resolution", "props", resolved)
stage_query("c2_inherit_relations", "inherited", inherited)
stage_query("c3_inherit_properties", "completed", completed)
stage_query("c4_replace_rule", "replaced", replaced)
stage_query("c5_add_to_rule", "merged", C.merged_catalog)

# Variants per row of a test: fixed by the transformation or by its index sets.
FIXED_VARIANTS = {
    "no_change": 1, "permute": 1, "append_generated": 1, "replace_category": 1, "replace_category_qa": 1, "replace_category_re": 1,
    "replace_antonym_qa": 2, "negate_qa": 2, "replace_random_qa": 3, "remove_keywords_qa": 3,
}


@query(
    "c6_planned_work",
    S.with_views(
        f"""SELECT m.task, m.mr, c.rows, c.rows * coalesce(f.n, CASE WHEN params LIKE '%transform_indices=%'
          THEN len(regexp_extract_all(params, '\\[[0-9,]+\\]')) ELSE 1 END) AS followups
        FROM merged m JOIN counts c USING (task) LEFT JOIN {values(sorted(FIXED_VARIANTS.items()))} f(fn, n) ON f.fn = m.fn
        WHERE m.prop = 'transform'""",
        *VIEW_OF.values(),
        **up_to("merged"),
    ),
)
def c6(spark, sf):
    """The matrix of tests (108 pairs) with the number of questions each asks."""
    tests = C.load_tests(C.merged_catalog(spark))
    rows = [(t.task, t.mr, FIXED_VARIANTS.get(t.props[C.TRANSFORM].fn, len(t.props[C.TRANSFORM].indices))) for t in tests]
    planned = spark.createDataFrame(rows, "task string, mr int, variants int")
    work = planned.join(row_counts(spark, sf), "task")
    return work.select("task", "mr", "rows", (F.col("rows") * F.col("variants")).alias("followups"))


WANTED = {C.QA: [1, 19, 57], C.NLI: [], "summarisation": []}
WANTED_SQL = values([(t, mr) for t, mrs in WANTED.items() for mr in (mrs or [None])])


@query(
    "c7_run_options",
    S.with_views(
        "SELECT 'double-a' AS helper, 'runs/results' AS results, task, rows FROM counts", *VIEW_OF.values(), counts=COUNTS_SQL
    ),
)
def c7(spark, sf):
    """Defaults: everything runs, the first model helps, stages live below one folder."""
    options = C.RunOptions(run_all=True, models=("double-a", "double-b"))
    wanted = options.requested(spark).join(row_counts(spark, sf), "task")
    return wanted.select(F.lit(options.helper).alias("helper"), F.lit(options.folder("results")).alias("results"), "task", "rows")


@query(
    "p8_test_selection",
    S.with_views(
        f"""SELECT DISTINCT m.task, m.mr, c.rows, false AS unknown FROM merged m JOIN counts c USING (task)
        JOIN {WANTED_SQL} w(task, mr) ON w.task = m.task AND (w.mr IS NULL OR w.mr = m.mr)
        UNION ALL SELECT w.task, w.mr, NULL, true FROM {WANTED_SQL} w(task, mr)
        WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.task = w.task AND (w.mr IS NULL OR w.mr = m.mr))""",
        *VIEW_OF.values(),
        **up_to("merged"),
    ),
)
def p8(spark, sf):
    """Named relations, all relations of a task, and requests that match nothing."""
    pairs = C.test_pairs(C.merged_catalog(spark))
    chosen, unknown = C.select_tests(pairs, C.RunOptions(tasks=WANTED).requested(spark))
    found = chosen.join(row_counts(spark, sf), "task").withColumn("unknown", F.lit(False))
    missing = unknown.select("task", "mr", F.lit(None).cast("bigint").alias("rows"), F.lit(True).alias("unknown"))
    return found.select("task", "mr", "rows", "unknown").unionByName(missing)
