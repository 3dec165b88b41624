"""Output relations and verifiers, over answers that the test doubles give on whole tables."""

from pyspark.sql import functions as F

from driftline.functions import relations as R, verifiers as V
from driftline.operators.answer_checks import known_or_unknown, question_of_answer
from driftline.operators.model_calls import ask
from driftline.operators.registry import VERIFIERS, differs_at_gate, helper_check_needed
from driftline.plans.templates import template
from driftline.sources import tasks as T

from . import sqltext as S
from .doubles import ENCODER, HELPER, _answer_question, _infer, _rate, _relate
from .q_edits import re_rows_sql
from .registry import query
from .views import documents, inference_raw, question_raw, relation_rows

# Pairs of answers: numbers for premise and hypothesis, labels both ways round, an answer and its question.
NUMBERS_SQL = f"SELECT row_id, {S.rate('premise')} AS a, {S.rate('hypothesis')} AS b FROM nli_raw"
LABELS_SQL = f"SELECT row_id, {S.infer('premise', 'hypothesis')} AS a, {S.infer('hypothesis', 'premise')} AS b FROM nli_raw"
ANSWERS_SQL = f"SELECT row_id, {S.answer_question('context', 'question')} AS a, question AS b FROM qa_raw"
RELATED_SQL = (
    f"SELECT row_id, {S.relate('text', 'head', 'tail')} AS a, {S.relate('text', 'tail', 'head')} AS b FROM re_rows"
)


def numbers(spark, sf):
    return inference_raw(spark, sf).select("row_id", _rate(F.col("premise")).alias("a"), _rate(F.col("hypothesis")).alias("b"))


def labels(spark, sf):
    p, h = F.col("premise"), F.col("hypothesis")
    return inference_raw(spark, sf).select("row_id", _infer(p, h).alias("a"), _infer(h, p).alias("b"))


def answers(spark, sf):
    c, q = F.col("context"), F.col("question")
    return question_raw(spark, sf).select("row_id", _answer_question(c, q).alias("a"), q.alias("b"))


def related(spark, sf):
    rows = relation_rows(spark, sf)
    text, head, tail = (F.get("inputs", F.lit(i)) for i in range(3))
    return rows.select("row_id", _relate(text, head, tail).alias("a"), _relate(text, tail, head).alias("b"))


SOURCES = {
    "numbers": (numbers, NUMBERS_SQL, ("nli_raw",), {}),
    "labels": (labels, LABELS_SQL, ("nli_raw",), {}),
    "answers": (answers, ANSWERS_SQL, ("qa_raw",), {}),
    "related": (related, RELATED_SQL, ("re_raw",), {"re_rows": re_rows_sql()}),
}


def judged(name: str, source: str, expression, sql: str) -> None:
    """Register a query (row_id, verdict) over one kind of answer pair."""
    rows, pair_sql, views, ctes = SOURCES[source]
    body = f"SELECT row_id, ({sql}) AS verdict FROM pairs"

    @query(name, S.with_views(body, *views, **ctes, pairs=pair_sql))
    def run(spark, sf):
        return rows(spark, sf).select("row_id", expression(F.col("a"), F.col("b")).alias("verdict"))


CA, CB = S.clean("a"), S.clean("b")
NA, NB = S.number("a"), S.number("b")
INVERSE = f"({CA} = 'entailment' AND {CB} = 'contradiction') OR ({CA} = 'contradiction' AND {CB} = 'entailment')"
STRONGER = f"""CASE WHEN {NA} IS NULL OR {NB} IS NULL THEN NULL WHEN {NA} = {NB} AND ({NA} = 0 OR {NA} = 1) THEN true
    WHEN {NA} < 0.5 THEN {NB} <= {NA} WHEN {NA} > 0.5 THEN {NB} >= {NA} ELSE true END"""
COSINE = S.cosine(S.vector("a"), S.vector("b"))


def similar_sql(threshold: float) -> str:
    return f"coalesce({COSINE} >= {threshold}::DOUBLE, false) OR {S.subset('a', 'b')}"


judged("o1_equivalent", "labels", R.equivalent, f"{CA} = {CB}")
judged("o2_different", "labels", R.different, f"{CA} <> {CB}")
judged("o3_inverse", "labels", lambda a, b: R.inverse(a, b, "entailment", "contradiction"), INVERSE)
judged("o4_not_inverse", "labels", lambda a, b: R.not_inverse(a, b, "entailment", "contradiction"), f"NOT ({INVERSE})")
judged("o5_equivalent_numeric", "numbers", lambda a, b: R.equivalent_numeric(a, b, 0.11), f"abs({NA} - {NB}) <= 0.11::DOUBLE")
judged(
    "o6_different_numeric",
    "numbers",
    lambda a, b: R.different_numeric(a, b, 0.11),
    f"coalesce(NOT (abs({NA} - {NB}) <= 0.11::DOUBLE), true)",
)
judged("o7_stronger", "numbers", R.stronger, STRONGER)
judged(
    "o8_same_or_stronger",
    "numbers",
    R.same_or_stronger,
    f"CASE WHEN {NA} IS NULL OR {NB} IS NULL THEN NULL ELSE abs({NA} - {NB}) <= 0 OR ({STRONGER}) END",
)
judged(
    "o10_similar",
    "answers",
    lambda a, b: R.similar(a, b, ENCODER.similarity(a, b), 0.8),
    similar_sql(0.8),
)
judged(
    "o11_not_similar",
    "answers",
    lambda a, b: R.not_similar(a, b, ENCODER.similarity(a, b), 0.8),
    f"NOT ({similar_sql(0.8)})",
)


@query(
    "o9_helper_judge",
    S.with_views(
        f"SELECT row_id, {S.clean(S.yes_no('a', 'b'))} = 'true' AS verdict FROM pairs",
        "re_raw", re_rows=re_rows_sql(), pairs=RELATED_SQL,
    ),
)
def o9(spark, sf):
    df = ask(related(spark, sf), HELPER, template("or_prompt:re_opposite_relation"), [F.col("a"), F.col("b")], "said")
    return df.select("row_id", R.says_true(F.col("said")).alias("verdict"))


def _known(x: str) -> str:
    return f"CASE WHEN {S.subset(x, chr(39) + 'unknown' + chr(39))} OR {S.clean(S.yes_no(x))} <> 'true' THEN 'unknown' ELSE {x} END"


KNOWN_SQL = f"SELECT row_id, {_known('a')} AS a, {_known('b')} AS b FROM raw_pairs"


def _o12(spark, sf):
    df = known_or_unknown(known_or_unknown(answers(spark, sf), "a", HELPER), "b", HELPER)
    return df.select("row_id", R.similar(F.col("a"), F.col("b"), ENCODER.similarity(F.col("a"), F.col("b")), 0.6).alias("v"))


@query(
    "o12_similar_or_unknown",
    S.with_views(
        f"SELECT row_id, ({similar_sql(0.6)}) AS verdict FROM pairs", "qa_raw", raw_pairs=ANSWERS_SQL, pairs=KNOWN_SQL
    ),
)
def o12(spark, sf):
    return _o12(spark, sf).select("row_id", F.col("v").alias("verdict"))


@query(
    "o13_not_similar_or_unknown",
    S.with_views(
        f"SELECT row_id, NOT ({similar_sql(0.6)}) AS verdict FROM pairs",
        "qa_raw", raw_pairs=ANSWERS_SQL, pairs=KNOWN_SQL,
    ),
)
def o13(spark, sf):
    return _o12(spark, sf).select("row_id", (~F.col("v")).alias("verdict"))


@query(
    "o14_question_of_answer",
    S.with_views(
        f"SELECT row_id, {S.echo('question_of_answer', 'a')} AS question FROM pairs", "qa_raw", pairs=ANSWERS_SQL
    ),
)
def o14(spark, sf):
    return question_of_answer(answers(spark, sf), "a", "question", HELPER).select("row_id", "question")


# Verifiers

UNKNOWN = S.lit("Unknown!")
judged("v1_equals", "labels", lambda a, b: V.equals(a, "Entailment."), f"{CA} = 'entailment'")
judged("v2_differs", "labels", lambda a, b: V.differs(a, "Entailment."), f"{CA} <> 'entailment'")
judged("v4_is_in", "labels", lambda a, b: V.is_in(a, ["Neutral", "contra-diction"]), f"{CA} IN ('neutral', 'contradiction')")
judged("v5_in_set_of", "answers", lambda a, b: V.in_set_of(a, "Unknown!"), f"{CA} = 'unknown' OR {S.subset('a', UNKNOWN)}")
judged(
    "v6_not_in_set_of", "answers", lambda a, b: V.not_in_set_of(a, "Unknown!"), f"NOT ({CA} = 'unknown' OR {S.subset('a', UNKNOWN)})"
)
judged("v7_equals_number", "numbers", lambda a, b: V.equals_number(a, 0.5, 0.1), f"abs({NA} - 0.5::DOUBLE) <= 0.1::DOUBLE")
judged(
    "v8_differs_from_number", "numbers", lambda a, b: V.differs_from_number(a, 0.5), f"NOT (abs({NA} - 0.5::DOUBLE) <= 0::DOUBLE)"
)
judged("v9_in_range", "numbers", lambda a, b: V.in_range(a, 0.4, 0.6), f"{NA} BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE")
judged("v10_out_of_range", "numbers", lambda a, b: V.out_of_range(a, 0.4, 0.6), f"NOT ({NA} BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE)")
judged("v16_always", "labels", lambda a, b: V.always(a), "true")


@query(
    "v3_differs_at",
    S.with_views(f"SELECT row_id, {S.clean('hypothesis')} <> 'in of the' AS verdict FROM nli_raw", "nli_raw"),
)
def v3(spark, sf):
    rows = T.inference(inference_raw(spark, sf), size=None)
    return rows.select("row_id", differs_at_gate(F.array("inputs"), {"value": "In of the.", "index": "1"}).alias("verdict"))


@query("v11_has_sentences", f"SELECT doc_id AS row_id, len({S.sents('text')}) >= 2 AS verdict FROM documents")
def v11(spark, sf):
    return documents(spark, sf).select("row_id", V.has_sentences(F.col("text")).alias("verdict"))


SAYS = f"{S.clean(S.yes_no('a'))} = 'true'"
HELPER_CHECKS = (
    ("v12_helper_true", "helper_true", SAYS),
    ("v13_helper_not_true", "helper_not_true", f"NOT ({SAYS})"),
    ("v14_symmetric", "symmetric", f"{CA} = 'no relation' OR {SAYS}"),
    ("v15_asymmetric", "asymmetric", f"NOT ({CA} = 'no relation' OR {SAYS})"),
)


def _helper_check(name, fn, sql):
    @query(
        name,
        S.with_views(f"SELECT row_id, ({sql}) AS verdict FROM pairs", "re_raw", re_rows=re_rows_sql(), pairs=RELATED_SQL),
    )
    def run(spark, sf):
        asked = helper_check_needed(fn, F.col("a"))
        df = ask(related(spark, sf), HELPER, template("verify_prompt:re_symmetry"), [F.col("a")], "said", "helper", asked)
        return df.select("row_id", VERIFIERS[fn](F.col("a"), F.col("said"), {}).alias("verdict"))


for _name, _fn, _sql in HELPER_CHECKS:
    _helper_check(_name, _fn, _sql)
