"""Prompts, model calls and the test run itself, with test doubles as models."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driftline.operators.model_calls import (
    FILTERED_TEXT,
    REPETITIVE_TEXT,
    AnswerStore,
    ask,
    question_key,
)
from driftline.operators.encoders import KeptEncoder
from driftline.operators.zipping import numbered, zip_rows
from driftline.operators.prompts import fill, messages
from driftline.functions.relations import says_true
from driftline.operators.registry import VERIFIERS
from driftline.plans import run as R
from driftline.plans.catalog import NLI, QA, RE, SENTIMENT, TRANSFORM, Property, RunOptions, Test, load_tests, merged_catalog
from driftline.plans.stages import StageStore
from driftline.plans.templates import ALL_TEMPLATES, SYSTEM_LINE, template
from driftline.session import work_folder
from driftline.sources import tasks as T
from driftline.sources.commits import append_results, read_results
from driftline.streaming.arrivals import run_arrivals

from . import q_rewrites  # noqa: F401  (its oracles are used below)
from . import sqltext as S
from .batch_doubles import (
    AnswerSecondTime,
    answer_in_later_rounds,
    batch_model,
    fail_some,
    length_of_last_quote,
    length_of_question,
    load_letter_counts,
    one_reply_less,
    rate_chats,
    refuse_some,
)
from .doubles import ENCODER, HELPER, MODEL, SECOND_MODEL
from .q_edits import re_rows_sql
from .registry import ORACLES, query
from .views import (
    documents,
    inference_raw,
    inference_rows,
    question_raw,
    question_rows,
    relation_rows,
    sentence_pool,
    spread,
    table,
    text_rows,
    word_pool,
)

SEED = 42
_TESTS: dict[str, list[Test]] = {}


def all_tests(spark) -> list[Test]:
    """The catalog as the driver needs it; the same for every query of a session."""
    app = spark.sparkContext.applicationId
    if app not in _TESTS:
        _TESTS[app] = load_tests(merged_catalog(spark))
    return _TESTS[app]


def tests_of(spark, task, mrs=None) -> list[Test]:
    return [t for t in all_tests(spark) if t.task == task and (mrs is None or t.mr in mrs)]


def resources(spark, sf, pools=False) -> R.Resources:
    words, sents = (word_pool(spark, sf), sentence_pool(spark, sf)) if pools else (None, None)
    return R.Resources(HELPER, ENCODER, words, sents, seed=SEED)


# M: prompts


def filled(prompt: str, *inputs: str) -> str:
    sql = S.lit(prompt)
    for i, x in enumerate(inputs):
        sql = f"replace({sql}, '{{INPUT_{i}}}', coalesce({x}, ''))"
    return sql


NLI_PROMPT = template("sut_prompt:inference")


@query(
    "m1_use_template", S.with_views(f"SELECT row_id, {filled(NLI_PROMPT.prompt, 'premise', 'hypothesis')} AS prompt FROM nli_raw", "nli_raw")
)
def m1(spark, sf):
    rows = inference_raw(spark, sf)
    return rows.select("row_id", fill(F.lit(NLI_PROMPT.prompt), [F.col("premise"), F.col("hypothesis")]).alias("prompt"))


def chat_sql(t, *inputs):
    """(pos, role, content) structs of the chat of a template."""
    chat = [("system", S.lit(SYSTEM_LINE))]
    for example_inputs, answer in t.examples:
        chat += [("user", filled(t.prompt, *[S.lit(v) for v in example_inputs])), ("assistant", S.lit(answer))]
    chat.append(("user", filled(t.prompt, *inputs)))
    return "[" + ", ".join(f"{{'pos': {i}::BIGINT, 'role': '{r}', 'content': {c}}}" for i, (r, c) in enumerate(chat)) + "]"


OPPOSITE = template("or_prompt:re_opposite_relation")


@query(
    "m2_messages",
    S.with_views(
        f"SELECT row_id, m.pos, m.role, m.content FROM (SELECT row_id, unnest({chat_sql(OPPOSITE, 'question', 'context')}) AS m FROM qa_raw)",
        "qa_raw",
    ),
)
def m2(spark, sf):
    chat = messages(OPPOSITE, [F.col("question"), F.col("context")])
    rows = question_raw(spark, sf).select("row_id", F.posexplode(chat).alias("pos", "m"))
    return rows.select("row_id", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query(
    "m3_model_under_test",
    f"SELECT doc_id AS row_id, 'n=' || length({filled(template('sut_prompt:sentiment_analysis_continuous').prompt, 'text')}) AS output FROM documents",
)
def m3(spark, sf):
    """A batch function is asked each distinct question once; copies of a document share the answer."""
    res = R.Resources(HELPER, ENCODER)
    out = R.source_outputs(text_rows(spark, sf), batch_model("length", length_of_question), SENTIMENT, res)
    return out.select("row_id", F.col("source_output").alias("output"))


@query(
    "m4_helper_model",
    f"SELECT doc_id AS row_id, 'n=' || length({filled(template('it_prompt:paraphrasing').prompt, 'text')}) AS output FROM documents",
)
def m4(spark, sf):
    helper = batch_model("length", length_of_question)
    return ask(documents(spark, sf), helper, template("it_prompt:paraphrasing"), [F.col("text")], "output").select("row_id", "output")


PARAPHRASE_LENGTH = f"length({filled(template('it_prompt:paraphrasing').prompt, 'text')})"


@query(
    "m5_refusals_as_text",
    f"""SELECT row_id, CASE n % 3 WHEN 0 THEN {S.lit(FILTERED_TEXT)} WHEN 1 THEN {S.lit(REPETITIVE_TEXT)} ELSE 'n=' || n END AS output,
        CASE n % 3 WHEN 0 THEN 'filtered' WHEN 1 THEN 'repetitive' ELSE 'ok' END AS output_status
        FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n FROM documents)""",
)
def m5(spark, sf):
    df = ask(
        documents(spark, sf), batch_model("refusing", refuse_some), template("it_prompt:paraphrasing"), [F.col("text")], "output",
        keep_status=True,
    )
    return df.select("row_id", "output", "output_status")


@query(
    "m6_bounded_retry",
    f"""SELECT row_id, CASE WHEN n % 5 <> 0 THEN 'n=' || n END AS output, CASE WHEN n % 5 <> 0 THEN 'ok' ELSE 'error' END AS output_status
        FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n FROM documents)""",
)
def m6(spark, sf):
    """Every first try fails; some questions fail always, end as errors and do not stop the job."""
    model = batch_model("unsteady", AnswerSecondTime(), max_retries=3)
    df = ask(documents(spark, sf), model, template("it_prompt:paraphrasing"), [F.col("text")], "output", keep_status=True)
    return df.select("row_id", "output", "output_status")


# A helper that fails for some questions: nothing that depends on such a call is judged, asked about or let through.
DOWN = batch_model("down-for-some", fail_some, max_retries=1)


@query(
    "m6_helper_down_transform",
    f"SELECT row_id, n % 5 <> 0 AS asked, CASE WHEN n % 5 <> 0 THEN 'n=' || length('n=' || n) END AS output FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n FROM documents)",
)
def m6_transform(spark, sf):
    """A follow-up that a failed call should have made is no question to the model, not even an empty one."""
    df = ask(documents(spark, sf), DOWN, template("it_prompt:paraphrasing"), [F.col("text")], "followup")
    echo = batch_model("bare-length", length_of_last_quote)
    df = ask(df, echo, template("helper:sentiment_word"), [F.col("followup")], "output", keep_status=True)
    return df.select("row_id", F.col("output_status").isNotNull().alias("asked"), "output")


@query(
    "m6_helper_down_judge",
    f"SELECT row_id, CASE WHEN n % 5 <> 0 THEN false END AS verdict, CASE WHEN n % 5 <> 0 THEN known END AS known FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n, 'unknown' AS known FROM documents)",
)
def m6_judge(spark, sf):
    df = ask(documents(spark, sf), DOWN, template("it_prompt:paraphrasing"), [F.col("text")], "said")
    return df.select("row_id", says_true(F.col("said")).alias("verdict"), F.when(~says_true(F.col("said")), "unknown").alias("known"))


@query(
    "m6_helper_down_gate",
    f"SELECT row_id, false AS is_true, n % 5 <> 0 AS is_not_true FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n FROM documents)",
)
def m6_gate(spark, sf):
    """A gate lets a row through only if the helper's reply says so."""
    df = ask(documents(spark, sf), DOWN, template("it_prompt:paraphrasing"), [F.col("text")], "said")
    passes = lambda fn: F.coalesce(VERIFIERS[fn](F.col("text"), F.col("said"), {}), F.lit(False))
    return df.select("row_id", passes("helper_true").alias("is_true"), passes("helper_not_true").alias("is_not_true"))


@query("m6_short_reply", "SELECT doc_id AS row_id, NULL::VARCHAR AS output, 'error' AS output_status FROM documents")
def m6_short(spark, sf):
    """A list of replies that is not as long as that of the questions answers none of them."""
    model = batch_model("short", one_reply_less, max_retries=1)
    df = ask(documents(spark, sf), model, template("it_prompt:paraphrasing"), [F.col("text")], "output", keep_status=True)
    return df.select("row_id", "output", "output_status")


def _prompt_catalog(name, category):
    """Every prompt of a category, filled with question answering rows."""
    chosen = [t for t in ALL_TEMPLATES.values() if t.category == category]
    parts = [
        f"SELECT row_id, '{t.name}' AS name, {filled(t.prompt, 'context', 'question', 'question')} AS prompt FROM qa_raw" for t in chosen
    ]

    @query(name, S.with_views("\nUNION ALL ".join(parts), "qa_raw"))
    def run(spark, sf):
        inputs = [F.col("context"), F.col("question"), F.col("question")]
        prompts = [F.struct(F.lit(t.name).alias("name"), fill(F.lit(t.prompt), inputs).alias("prompt")) for t in chosen]
        return question_raw(spark, sf).select("row_id", F.inline(F.array(*prompts)))


_prompt_catalog("m7_model_prompts", "sut_prompt")
_prompt_catalog("m8_transformation_prompts", "it_prompt")
_prompt_catalog("m9_relation_prompts", "or_prompt")
_prompt_catalog("m10_verifier_prompts", "verify_prompt")


# P: shaping


@query("p1_row_range", "SELECT doc_id AS row_id, text FROM documents WHERE doc_id >= 100")
def p1(spark, sf):
    return R.row_range(documents(spark, sf), 100, 10**12)


@query("p2_output_id", f"SELECT doc_id AS row_id, {S.rate('text')} AS output FROM documents WHERE doc_id >= 100")
def p2(spark, sf):
    out = R.source_outputs(R.row_range(text_rows(spark, sf), 100, 10**12), MODEL, SENTIMENT, resources(spark, sf))
    return out.select("row_id", F.col("source_output").alias("output"))


@query("p3_scalar_to_list", "SELECT doc_id AS row_id, 1::BIGINT AS n, text FROM documents")
def p3(spark, sf):
    rows = T.check_arity(documents(spark, sf).select("row_id", T.as_inputs(F.col("text")).alias("inputs")), 1)
    return rows.select("row_id", F.size("inputs").cast("bigint").alias("n"), F.get("inputs", F.lit(0)).alias("text"))


@query("p4_first_input_check", S.with_views(f"SELECT row_id, len({S.sents('context')}) >= 2 AS vsi FROM qa_raw", "qa_raw"))
def p4(spark, sf):
    test = tests_of(spark, QA, [19])[0]
    return question_rows(spark, sf).select("row_id", R.input_gate(test).alias("vsi"))


@query(
    "p7_fan_out",
    S.with_views(
        f"""SELECT row_id, 0 AS variant, {S.upper('premise')} AS a, hypothesis AS b FROM nli_raw
        UNION ALL SELECT row_id, 1, premise, {S.upper('hypothesis')} FROM nli_raw
        UNION ALL SELECT row_id, 2, {S.upper('premise')}, {S.upper('hypothesis')} FROM nli_raw""",
        "nli_raw",
    ),
)
def p7(spark, sf):
    df = R.followup_inputs(inference_rows(spark, sf), tests_of(spark, NLI, [102]), resources(spark, sf))
    long = R.fan_out(df.select("row_id", "variants"))
    return long.select(
        "row_id", "variant", F.get("followup_input", F.lit(0)).alias("a"), F.get("followup_input", F.lit(1)).alias("b")
    )


NLI_LABEL = S.infer("premise", "hypothesis")


@query(
    "p9_model_loop",
    S.with_views(
        f"""SELECT 'double-a' AS llm, row_id, {NLI_LABEL} AS output FROM nli_raw
        UNION ALL SELECT 'double-b', row_id, upper({NLI_LABEL}) FROM nli_raw""",
        "nli_raw",
    ),
)
def p9(spark, sf):
    rows, res = inference_rows(spark, sf), resources(spark, sf)
    outs = [R.source_outputs(rows, m, NLI, res).select(F.lit(m.name).alias("llm"), "row_id", "source_output") for m in (MODEL, SECOND_MODEL)]
    return outs[0].unionByName(outs[1]).withColumnRenamed("source_output", "output")


@query("p10_source_outputs_only", f"SELECT doc_id AS row_id, {S.rate('text')} AS output FROM documents")
def p10a(spark, sf):
    out = R.source_outputs(text_rows(spark, sf), MODEL, SENTIMENT, resources(spark, sf))
    return out.select("row_id", F.col("source_output").alias("output"))


@query(
    "p10_followup_inputs_only",
    f"""SELECT 102 AS mr, doc_id AS row_id, {S.upper('text')} AS text FROM documents
    UNION ALL SELECT 49, doc_id, text FROM documents""",
)
def p10b(spark, sf):
    df = R.followup_inputs(text_rows(spark, sf), tests_of(spark, SENTIMENT, [102, 49]), resources(spark, sf))
    return df.select("mr", "row_id", F.get(F.get("variants", F.lit(0)), F.lit(0)).alias("text"))


# E: the run. Follow-up inputs as (row_id, variant, in0, in1, in2) come from the oracles of the transformations.


def single(name: str) -> str:
    """Follow-ups of a one-input transformation whose oracle is (row_id, text) or (row_id, variant, place, text)."""
    return f"SELECT row_id, 0::BIGINT AS variant, text AS in0, NULL AS in1, NULL AS in2 FROM ({ORACLES[name]})"


def single_prompt(prompt: str) -> str:
    return f"SELECT row_id, 0::BIGINT AS variant, text AS in0, NULL AS in1, NULL AS in2 FROM ({ORACLES['i24_rewrite']}) WHERE prompt = '{prompt}'"


def several(name: str) -> str:
    columns = ", ".join(f"max(CASE WHEN place = {i} THEN text END) AS in{i}" for i in range(3))
    return f"SELECT row_id, variant, {columns} FROM ({ORACLES[name]}) GROUP BY row_id, variant"


def listed(base: str, *variants: tuple[str, ...]) -> str:
    parts = [
        f"SELECT row_id, {v}::BIGINT AS variant, {', '.join(f'{e} AS in{i}' for i, e in enumerate((*x, 'NULL', 'NULL')[:3]))} FROM {base}"
        for v, x in enumerate(variants)
    ]
    return " UNION ALL ".join(parts)


def run_sql(task, base, inputs, followups, sut, relation, vso=None, vsi=None, views=(), ctes=None, tail=None):
    """The whole run in SQL: gates, answers, verdicts, in long form."""
    vso, vsi = vso or {}, vsi or {}
    fu = " UNION ALL ".join(f"SELECT {mr} AS mr, * FROM ({sql})" for mr, sql in followups.items())
    src = f"SELECT row_id, {', '.join(f'{x} AS s{i}' for i, x in enumerate(inputs))}, {sut(*inputs)} AS a FROM {base}"
    case_vsi = "CASE mr " + " ".join(f"WHEN {m} THEN {g}" for m, g in vsi.items()) + " ELSE true END" if vsi else "true"
    case_vso = "CASE mr " + " ".join(f"WHEN {m} THEN {g}" for m, g in vso.items()) + " ELSE true END" if vso else "true"
    mrs = ", ".join(f"({m})" for m in followups)
    case_rel = "CASE mr " + " ".join(f"WHEN {m} THEN {r}" for m, r in relation.items()) + " END"
    steps = {
        "src": src,
        "gated": f"SELECT *, CASE WHEN NOT coalesce({case_vsi}, false) THEN 'si' WHEN NOT coalesce({case_vso}, false) THEN 'so' END AS failed "
        f"FROM src, (VALUES {mrs}) t(mr)",
        "fu": fu,
        "pairs": f"""SELECT g.mr, g.row_id, g.a, g.failed, f.variant, f.in0, f.in1, f.in2,
            CASE WHEN g.failed IS NULL THEN {sut(*[f'f.in{i}' for i in range(len(inputs))])} END AS b
            FROM gated g LEFT JOIN fu f ON f.mr = g.mr AND f.row_id = g.row_id AND g.failed IS DISTINCT FROM 'si'""",
        "judged": f"SELECT *, CASE WHEN b IS NOT NULL THEN {case_rel} END AS verdict FROM pairs",
    }
    last = tail or (
        f"SELECT '{task}' AS task, mr, row_id, a AS source_output, variant, in0 AS followup, b AS followup_output, verdict, failed FROM judged"
    )
    return S.with_views(last, *views, **(ctes or {}), **steps)


def long_form(df):
    return df.select(
        "task", "mr", "row_id", "source_output", F.col("variant").cast("bigint").alias("variant"),
        F.get("followup_input", F.lit(0)).alias("followup"), "followup_output", "verdict", "failed",
    )


A, B = S.number("a"), S.number("b")
NEAR = f"abs({A} - {B}) <= 0.11::DOUBLE"
FAR = f"coalesce(NOT ({NEAR}), true)"
STRONGER = f"""CASE WHEN {A} IS NULL OR {B} IS NULL THEN NULL WHEN {A} = {B} AND ({A} = 0 OR {A} = 1) THEN true
    WHEN {A} < 0.5 THEN {B} <= {A} WHEN {A} > 0.5 THEN {B} >= {A} ELSE true END"""
STRONGER_OR_SAME = f"CASE WHEN {A} IS NULL OR {B} IS NULL THEN NULL ELSE {A} = {B} OR ({STRONGER}) END"
EXTREME = f"NOT ({A} BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE)"
NOT_HALF = f"{A} <> 0.5::DOUBLE"

SENTIMENT_FOLLOWUPS = {
    1: single("i12_replace_characters"), 2: single("i13_delete_characters"), 3: single("i15_leet"),
    4: single("i14_add_characters"), 5: single("i16_add_spaces"), 6: single("i17_swap_characters"),
    7: single("i19_scramble_inside_words"), 8: single("i36_replace_synonym"), 9: single_prompt("word_insertion"),
    10: single("i36_replace_synonym"), 25: single("i41_replace_random"), 34: single("i46_remove_keywords_by_sentence"),
    49: single("i1_no_change"), 51: single_prompt("paraphrasing"), 102: single("i2_upper"), 120: single("i23_back_translate"),
    126: single("i23_typos_keyboard"), 127: single_prompt("misspell"), 128: single("i23_typos_ocr"),
    137: single("i36_replace_synonym"), 149: single("i25_rewrite_sentences"), 150: single("i3_exclaim"),
    151: single_prompt("emphasis_words"), 152: single("i49_negate"), 154: single_prompt("capitalize_words"),
}
SENTIMENT_RELATIONS = {
    **{m: NEAR for m in SENTIMENT_FOLLOWUPS}, **{m: FAR for m in (152, 10, 34, 25)},
    **{m: STRONGER for m in (150, 151, 154)}, 102: STRONGER_OR_SAME,
}
SENTIMENT_CHECKS = {**{m: EXTREME for m in (152, 10, 34, 25)}, **{m: NOT_HALF for m in (150, 151, 154)}}


def sentiment_sql(mrs=None, tail=None):
    chosen = {m: f for m, f in SENTIMENT_FOLLOWUPS.items() if mrs is None or m in mrs}
    return run_sql(
        SENTIMENT, "docs", ["text"], chosen, S.rate, {m: SENTIMENT_RELATIONS[m] for m in chosen},
        {m: SENTIMENT_CHECKS[m] for m in chosen if m in SENTIMENT_CHECKS}, views=("docs",), tail=tail,
    )


def run_sentiment(spark, sf, mrs=None, pools=True):
    res = resources(spark, sf, pools)
    return R.run_task(text_rows(spark, sf), [MODEL], SENTIMENT, tests_of(spark, SENTIMENT, mrs), res)


@query("e7_run_sentiment", sentiment_sql())
def e7_sentiment(spark, sf):
    """All 25 relations of the sentiment task over all documents."""
    return long_form(run_sentiment(spark, sf))


COSINE = S.cosine(S.vector("a"), S.vector("b"))


def sim(threshold):
    return f"(coalesce({COSINE} >= {threshold}::DOUBLE, false) OR {S.subset('a', 'b')})"


def not_unknown(value):
    return f"NOT ({S.clean('a')} = '{value}' OR {S.subset('a', S.lit(value))})"


EQUAL = f"{S.clean('a')} = {S.clean('b')}"
ENTAILS = f"{S.clean('a')} = 'entailment'"
NOT_INVERSE = (
    f"NOT (({S.clean('a')} = 'entailment' AND {S.clean('b')} = 'contradiction') "
    f"OR ({S.clean('a')} = 'contradiction' AND {S.clean('b')} = 'entailment'))"
)
P_H, H_P = "generate_premesis_from_hypothesis", "generate_hypothesis_from_premesis"
UP, UH = S.upper("premise"), S.upper("hypothesis")
NEG_P, NEG_H = S.echo("negate_text", "premise"), S.echo("negate_text", "hypothesis")
NLI_FOLLOWUPS = {
    102: listed("nli_raw", (UP, "hypothesis"), ("premise", UH), (UP, UH)),
    49: listed("nli_raw", ("premise", "hypothesis")),
    77: listed("nli_raw", (f"premise || ' ' || {S.echo(P_H, 'premise', 'hypothesis')}", "hypothesis")),
    78: several("i26_append_generated"),
    79: several("i24_rewrite_multi_input"),
    80: listed("nli_raw", (S.echo(H_P, "premise", "hypothesis"), "hypothesis")),
    137: several("i33_replace_category"),
    10: several("i38_replace_antonym"),
    152: listed("nli_raw", (NEG_P, "hypothesis"), ("premise", NEG_H), (NEG_P, NEG_H)),
}
NLI_RELATIONS = {
    102: EQUAL, 49: EQUAL, 77: EQUAL, 78: EQUAL, 79: NOT_INVERSE, 80: NOT_INVERSE, 137: EQUAL, 10: f"NOT ({EQUAL})", 152: f"NOT ({EQUAL})",
}
NLI_CHECKS = {77: ENTAILS, 78: ENTAILS, 79: ENTAILS, 80: ENTAILS, 10: not_unknown("neutral"), 152: not_unknown("neutral")}


@query(
    "e7_run_inference",
    run_sql(NLI, "nli_raw", ["premise", "hypothesis"], NLI_FOLLOWUPS, S.infer, NLI_RELATIONS, NLI_CHECKS, views=("nli_raw",)),
)
def e7_inference(spark, sf):
    res = resources(spark, sf)
    return long_form(R.run_task(inference_rows(spark, sf), [MODEL], NLI, tests_of(spark, NLI, NLI_FOLLOWUPS), res))


UC, UQ = S.upper("context"), S.upper("question")
QA_FOLLOWUPS = {
    102: listed("qa_raw", (UC, "question"), ("context", UQ), (UC, UQ)),
    49: listed("qa_raw", ("context", "question")),
    19: listed("qa_raw", (S.join(S.shuffled(S.sents("context"), "row_id", S.seed_for(SEED, 19))), "question")),
    137: several("i34_replace_category_qa"),
    10: several("i39_replace_antonym_qa"),
    25: several("i42_replace_random_qa"),
    34: several("i47_remove_keywords_qa"),
    152: several("i50_negate_qa"),
}
QA_RELATIONS = {**{m: sim(0.4) for m in (102, 49, 19, 137)}, **{m: f"NOT {sim(0.8)}" for m in (10, 25, 34, 152)}}
QA_CHECKS = {m: not_unknown("unknown") for m in (10, 25, 34, 152)}


@query(
    "e7_run_question_answering",
    run_sql(
        QA, "qa_raw", ["context", "question"], QA_FOLLOWUPS, S.answer_question, QA_RELATIONS, QA_CHECKS,
        {19: f"len({S.sents('s0')}) >= 2"}, views=("qa_raw",),
    ),
)
def e7_question_answering(spark, sf):
    res = resources(spark, sf, pools=True)
    return long_form(R.run_task(question_rows(spark, sf), [MODEL], QA, tests_of(spark, QA, QA_FOLLOWUPS), res))


RE_FOLLOWUPS = {
    49: listed("re_rows", ("text", "head", "tail")),
    102: listed("re_rows", (S.upper("text"), "head", "tail")),
    141: listed("re_rows", ("text", "tail", "head")),
    142: listed("re_rows", ("text", "tail", "head")),
    57: listed("re_rows", (S.echo("declarative_interrogative", "text"), "head", "tail")),
    137: several("i35_replace_category_re"),
    10: several("i40_replace_antonym_re"),
    25: several("i43_replace_random_re"),
    34: several("i48_remove_keywords_re"),
    152: several("i51_negate_re"),
}
SYMMETRIC = f"({S.clean('a')} = 'no relation' OR {S.clean(S.yes_no('a'))} = 'true')"
RE_RELATIONS = {
    **{m: sim(0.4) for m in (49, 102, 141, 57, 137)}, **{m: f"NOT {sim(0.8)}" for m in (10, 25, 34, 152)},
    142: f"{S.clean(S.yes_no('a', 'b'))} = 'true'",
}
RE_CHECKS = {141: SYMMETRIC, 142: f"NOT {SYMMETRIC}", **{m: not_unknown("no relation") for m in (10, 25, 34, 152)}}


def re_sql(tail=None, mrs=None):
    chosen = {m: f for m, f in RE_FOLLOWUPS.items() if mrs is None or m in mrs}
    return run_sql(
        RE, "re_rows", ["text", "head", "tail"], chosen, S.relate, {m: RE_RELATIONS[m] for m in chosen},
        {m: RE_CHECKS[m] for m in chosen if m in RE_CHECKS}, views=("re_raw",), ctes={"re_rows": re_rows_sql()}, tail=tail,
    )


@query("e7_run_relation_extraction", re_sql())
def e7_relation_extraction(spark, sf):
    res = resources(spark, sf, pools=True)
    return long_form(R.run_task(relation_rows(spark, sf), [MODEL], RE, tests_of(spark, RE, RE_FOLLOWUPS), res))


def _all_relations(name, task, rows):
    """Every relation of a task, as counts of judged and violated variants."""

    @query(name)
    def run(spark, sf):
        long = R.run_task(rows(spark, sf), [MODEL], task, tests_of(spark, task), resources(spark, sf, pools=True))
        return R.violation_rates(long)


_all_relations("e7_rates_question_answering", QA, question_rows)
_all_relations("e7_rates_inference", NLI, inference_rows)
_all_relations("e7_rates_relation_extraction", RE, relation_rows)


# stages


@query("e1_source_outputs", S.with_views(f"SELECT row_id, {S.answer_question('context', 'question')} AS output FROM qa_raw", "qa_raw"))
def e1(spark, sf):
    out = R.source_outputs(question_rows(spark, sf), MODEL, QA, resources(spark, sf))
    return out.select("row_id", F.col("source_output").alias("output"))


@query("e2_verify_source_input", S.with_views(f"SELECT row_id, len({S.sents('text')}) >= 2 AS vsi FROM re_rows", "re_raw", re_rows=re_rows_sql()))
def e2(spark, sf):
    return relation_rows(spark, sf).select("row_id", R.input_gate(tests_of(spark, RE, [19])[0]).alias("vsi"))


TWO_GATES = Test(QA, 19, {
    TRANSFORM: Property("no_change", {}),
    "vsi": Property("has_sentences", {"minimum": "3"}),
    "vso": Property("not_in_set_of", {"value": "unknown"}),
    "vfi": Property("differs_at", {"value": "unknown", "index": "1"}),
    "relation": Property("equivalent", {}),
})


@query(
    "e3_verify_source_output",
    S.with_views(
        f"SELECT row_id, CASE WHEN len({S.sents('context')}) >= 3 THEN {not_unknown('unknown')} END AS vso "
        f"FROM (SELECT *, {S.answer_question('context', 'question')} AS a FROM qa_raw)",
        "qa_raw",
    ),
)
def e3(spark, sf):
    res = resources(spark, sf)
    answered = R.source_outputs(question_rows(spark, sf), MODEL, QA, res)
    return R.output_gates(R.followup_inputs(answered, [TWO_GATES], res), [TWO_GATES], res).select("row_id", "vso")


@query(
    "e4_followup_inputs",
    S.with_views(
        f"""SELECT row_id, shuffled IS NOT NULL AS vsi, shuffled AS followup FROM (SELECT row_id,
        CASE WHEN len({S.sents('text')}) >= 2 THEN {S.join(S.shuffled(S.sents('text'), 'row_id', S.seed_for(SEED, 19)))} END AS shuffled
        FROM re_rows)""",
        "re_raw", re_rows=re_rows_sql(),
    ),
)
def e4(spark, sf):
    df = R.followup_inputs(relation_rows(spark, sf), tests_of(spark, RE, [19]), resources(spark, sf))
    return df.select("row_id", "vsi", F.get(F.get("variants", F.lit(0)), F.lit(0)).alias("followup"))


@query(
    "e5_verify_followup_input",
    S.with_views(
        f"SELECT row_id, CASE WHEN len({S.sents('context')}) >= 3 THEN {S.clean('question')} <> 'unknown' END AS vfi FROM qa_raw", "qa_raw"
    ),
)
def e5(spark, sf):
    df = R.followup_inputs(question_rows(spark, sf), [TWO_GATES], resources(spark, sf))
    return R.followup_gates(df, [TWO_GATES]).select("row_id", "vfi")


# Kept stage tables.


@query("e1_stage_table", f"SELECT doc_id AS row_id, {S.rate('text')} AS output, 0::BIGINT AS asked_again FROM documents")
def e1_stage(spark, sf):
    """Source outputs from a table that another run has filled in two steps; the second run asks nothing."""
    folder, rows = work_folder(spark, "stages"), text_rows(spark, sf)
    model = batch_model("rating", rate_chats)
    runs = [R.Resources(HELPER, ENCODER, store=AnswerStore(spark), stages=StageStore(spark, lambda s: f"{folder}/{s}")) for _ in range(2)]
    R.source_outputs(labelled(spark, sf, rows), model, SENTIMENT, runs[0])
    R.source_outputs(rows, model, SENTIMENT, runs[0])
    again = R.source_outputs(rows, model, SENTIMENT, runs[1])
    asked = runs[1].store.read()
    return again.select("row_id", F.col("source_output").alias("output"), F.lit(0 if asked is None else asked.count()).alias("asked_again"))


@query(
    "e4_shared_by_models",
    f"""SELECT llm, doc_id AS row_id, 'n=' || length({filled(template('it_prompt:paraphrasing').prompt, 'text')}) AS followup, u.n AS asked_first, 0::BIGINT AS asked_then
    FROM documents, (VALUES ('double-a'), ('double-b')) m(llm), (SELECT count(DISTINCT text) AS n FROM documents) u""",
)
def e4_shared(spark, sf):
    """Follow-ups that a helper makes: the first model's run asks it once per distinct text, the second model's not at all."""
    folder, rows = work_folder(spark, "stages"), text_rows(spark, sf)
    test = Test(SENTIMENT, 8, {"transform": Property("rewrite", {"template": "it_prompt:paraphrasing"}), "relation": Property("equivalent", {})})
    helper, out, asked = batch_model("length", length_of_question), [], []
    for model in (MODEL, replace(MODEL, name="double-b")):
        res = R.Resources(helper, ENCODER, store=AnswerStore(spark), stages=StageStore(spark, lambda s: f"{folder}/{s}"), seed=SEED)
        long = R.run_task(rows, [model], SENTIMENT, [test], res)
        out.append(long.select("llm", "row_id", F.get("followup_input", F.lit(0)).alias("followup")))
        helped = res.store.read()
        asked.append(0 if helped is None else helped.where("purpose = 'helper'").count())
    return out[0].union(out[1]).withColumns({"asked_first": F.lit(asked[0]), "asked_then": F.lit(asked[1])})


@query(
    "c7_stage_folders",
    """SELECT stage, n FROM (SELECT count(*) FILTER (doc_id >= 100) AS few, count(*) AS everything FROM documents),
    LATERAL (VALUES ('source_inputs', everything), ('source_outputs', 2 * few), ('followup_inputs', 2 * few), ('results', 4 * few)) v(stage, n)""",
)
def c7_folders(spark, sf):
    """What a run of two models and two relations keeps in the folder of each stage: follow-ups once for both models."""
    base = work_folder(spark, "run")
    options = RunOptions(tasks={SENTIMENT: [49, 102]}, models=("double-a", "double-b"), start_row=100, end_row=10**9, base_folder=base)
    models = {"double-a": MODEL, "double-b": replace(MODEL, name="double-b")}
    log, _ = R.run_all(spark, options, {SENTIMENT: text_rows(spark, sf)}, models, resources(spark, sf), merged_catalog(spark))
    stages = StageStore(spark, options.folder)
    tables = {
        "source_inputs": spark.read.parquet(f"{options.folder('source_inputs')}/{SENTIMENT}"), "source_outputs": stages.table("source_outputs").read(),
        "followup_inputs": stages.table("followup_inputs").read(), "results": log,
    }
    return reduce(DataFrame.unionAll, [t.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n")) for stage, t in tables.items()])


# Batch calls. Copies of a document are one question; MR 49 asks its own question again.


@query(
    "e6_batch_calls",
    "WITH judged AS (" + sentiment_sql([49, 102, 150]) + ") SELECT mr, row_id, source_output, followup_output, verdict, failed FROM judged",
)
def e6(spark, sf):
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark), seed=SEED)
    model = batch_model("rating", rate_chats, chunks=2)
    long = R.run_task(text_rows(spark, sf), [model], SENTIMENT, tests_of(spark, SENTIMENT, [49, 102, 150]), res)
    return long.select("mr", "row_id", "source_output", "followup_output", "verdict", "failed")


@query(
    "e6_questions_asked",
    f"""SELECT 'followup:49' AS purpose, count(DISTINCT text) AS asked FROM documents
    UNION ALL SELECT 'source', count(DISTINCT text) FROM documents
    UNION ALL SELECT 'followup:102', count(DISTINCT {S.upper('text')}) FROM documents""",
)
def e6_asked(spark, sf):
    """What the store holds after two runs: one answer per distinct question, whatever the number of copies and runs."""
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark), seed=SEED)
    model = batch_model("rating", rate_chats)
    for _ in range(2):
        R.run_task(text_rows(spark, sf), [model], SENTIMENT, tests_of(spark, SENTIMENT, [49, 102]), res)
    return res.store.read().groupBy("purpose").agg(F.count("*").alias("asked"))


@query(
    "e6_each_row_asked",
    "SELECT p AS purpose, count(*) AS asked FROM documents, (VALUES ('source'), ('followup:49'), ('followup:102')) v(p) GROUP BY p",
)
def e6_each(spark, sf):
    """Without dedup every row is asked for itself, and a second run still asks nothing again."""
    res = R.Resources(HELPER, ENCODER, store=AnswerStore(spark), seed=SEED, dedup=False)
    model = batch_model("rating", rate_chats)
    for _ in range(2):
        R.run_task(text_rows(spark, sf), [model], SENTIMENT, tests_of(spark, SENTIMENT, [49, 102]), res).write.format("noop").mode("overwrite").save()
    return res.store.read().groupBy("purpose").agg(F.count("*").alias("asked"))


@query("e6_hot_questions", f"SELECT doc_id AS row_id, 'n=' || length({filled(template('it_prompt:paraphrasing').prompt, 'lang')}) AS output FROM documents")
def e6_hot(spark, sf):
    """Four questions hold all rows: each answer is copied and every row meets one of the copies."""
    rows = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang"))
    helper = batch_model("length", length_of_question)
    return ask(rows, helper, template("it_prompt:paraphrasing"), [F.col("lang")], "output", hot_minimum=2).select("row_id", "output")


# Records, lazy fill, alignment, resume


def record_rows(df):
    """Scalar form of the nested records."""
    return df.select(
        "mr", "row_id", F.array_join("source_input", "\n").alias("source_input"), "source_output",
        F.size("followup_inputs").cast("bigint").alias("variants"), F.array_join(F.flatten("followup_inputs"), "\n").alias("followups"),
        F.array_join("followup_outputs", ",").alias("outputs"),
        F.array_join(F.transform("relations", lambda r: r.cast("string")), ",", "null").alias("relations"), "verif_failure",
    )


RECORDS_TAIL = """SELECT mr, row_id, any_value(s0) AS source_input, any_value(a) AS source_output, NULLIF(count(variant), 0) AS variants,
    string_agg(fu_text, chr(10) ORDER BY variant) AS followups,
    CASE WHEN any_value(failed) IS NULL THEN string_agg(b, ',' ORDER BY variant) END AS outputs,
    CASE WHEN any_value(failed) IS NULL THEN string_agg(coalesce(verdict::VARCHAR, 'null'), ',' ORDER BY variant) END AS relations,
    coalesce(any_value(failed), CASE WHEN bool_or(verdict IS NULL) THEN 'sfoe' END) AS verif_failure
    FROM (SELECT j.*, concat_ws(chr(10), in0, in1, in2) AS fu_text, {inputs} AS s0 FROM judged j JOIN src USING (row_id)) GROUP BY mr, row_id"""


def records_tail(inputs):
    return RECORDS_TAIL.replace("{inputs}", f"concat_ws(chr(10), {inputs})").replace("any_value(failed)", "max(failed)")


@query("e8_rejected_rows", re_sql(records_tail("s0, s1, s2"), [141, 142, 152]))
def e8(spark, sf):
    """Rejected rows keep their source output; those rejected after the source output keep their follow-ups."""
    res = resources(spark, sf)
    return record_rows(R.records(R.run_task(relation_rows(spark, sf), [MODEL], RE, tests_of(spark, RE, [141, 142, 152]), res)))


@query("e15_records", run_sql(
    NLI, "nli_raw", ["premise", "hypothesis"], {m: NLI_FOLLOWUPS[m] for m in (102, 79, 10)}, S.infer, NLI_RELATIONS, NLI_CHECKS,
    views=("nli_raw",), tail=records_tail("s0, s1"),
))
def e15(spark, sf):
    return record_rows(R.run_records(inference_rows(spark, sf), MODEL, NLI, tests_of(spark, NLI, [102, 79, 10]), resources(spark, sf)))


def labelled(spark, sf, rows):
    """The rows whose document has a label, a part of the table to start with."""
    return rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("row_id")), "row_id", "left_semi")


@query("e9_lazy_fill", f"SELECT doc_id AS row_id, {S.rate('text')} AS output FROM documents")
def e9(spark, sf):
    """Answers of a cache with holes are used, the holes are asked: the labelled documents have a cached answer."""
    rows = text_rows(spark, sf)
    store = AnswerStore(spark)
    res, model = R.Resources(HELPER, ENCODER, store=store), batch_model("rating", rate_chats)
    R.source_outputs(labelled(spark, sf, rows), model, SENTIMENT, res)
    return R.source_outputs(rows, model, SENTIMENT, res).select("row_id", F.col("source_output").alias("output"))


GAPS_SQL = """SELECT 'stage' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'source', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""


@query("e10_alignment", GAPS_SQL)
def e10(spark, sf):
    """Rows that one side of a stage join lacks: documents without a label, labels without a document."""
    ids = [table(spark, sf, n).select(F.col("doc_id").alias("row_id")) for n in ("documents", "labels")]
    return R.alignment_gaps(*ids)


@query(
    "e10_zip",
    """
    WITH a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
    b AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id DESC) - 1 AS idx FROM pages)
    SELECT idx, doc_id, n_chars, page_id, url, (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM pages) AS n_right FROM a JOIN b USING (idx)
    """,
)
def e10_zip(spark, sf):
    """Documents with pages by position, one in ascending and one in descending order; the longer table's rest is told by the sizes."""
    docs = numbered(table(spark, sf, "documents").select("doc_id", "n_chars").repartition(5, "n_chars"), "doc_id")
    pages = numbered(table(spark, sf, "pages").select("page_id", "url").repartition(7, "url"), F.col("page_id").desc())
    zipped, sizes = zip_rows(docs, pages)
    return zipped.withColumns({"n_left": F.lit(sizes["left"]), "n_right": F.lit(sizes["right"])})


@query(
    "m6_retry_rounds",
    f"""SELECT row_id, CASE WHEN n % 4 < 3 THEN 'n=' || n END AS output, CASE WHEN n % 4 < 3 THEN 'ok' ELSE 'error' END AS output_status,
        least(n % 4, 3) AS failures FROM (SELECT doc_id AS row_id, {PARAPHRASE_LENGTH} AS n FROM documents)""",
)
def m6_rounds(spark, sf):
    """A question of length n fails n % 4 times; three rounds ask it, each commits by itself, and the failures are counted."""
    model = batch_model("by-round", answer_in_later_rounds, max_retries=1, rounds=3, tell_round=True)
    store, prompt = AnswerStore(spark), template("it_prompt:paraphrasing")
    rows = documents(spark, sf).withColumn("key", question_key(model.name, F.lit("helper"), prompt, [F.col("text")]))
    df = ask(rows, model, prompt, [F.col("text")], "output", store=store, keep_status=True)
    failures = store.attempts(model.name).select("key", "failed")
    return df.join(failures, "key", "left").select("row_id", "output", "output_status", F.coalesce("failed", F.lit(0)).cast("bigint").alias("failures"))


@query(
    "x9_kept_vectors",
    f"""SELECT doc_id AS row_id, round({S.cosine(S.letter_counts('text'), S.letter_counts('lang || source'))}, 6) AS similarity,
        (SELECT count(DISTINCT t) FROM (SELECT text AS t FROM documents UNION ALL SELECT lang || source FROM documents)) AS encoded, 0::BIGINT AS again FROM documents""",
)
def x9_kept(spark, sf):
    """Each distinct text is encoded once, though four of them are in all rows; a second run encodes nothing."""
    encoder = KeptEncoder("letters", load_letter_counts, work_folder(spark, "vectors"), parallelism=8)
    rows = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text", F.concat("lang", "source").alias("other")))
    encoder.add_similarity(rows, F.col("text"), F.col("other"), "similarity").write.format("noop").mode("overwrite").save()
    first = sum(p.rows for p in encoder.table(spark).parts())
    df = encoder.add_similarity(rows, F.col("text"), F.col("other"), "similarity")
    second = sum(p.rows for p in encoder.table(spark).parts()) - first
    return df.select("row_id", F.round("similarity", 6).alias("similarity"), F.lit(first).alias("encoded"), F.lit(second).alias("again"))


@query(
    "p8_run_selected",
    sentiment_sql(
        [49, 102],
        """SELECT llm, mr, row_id, verdict, '9999' AS unknown FROM judged, (VALUES ('double-a'), ('double-b')) m(llm)
        WHERE row_id >= 100 AND row_id < 700""",
    ),
)
def p8_run(spark, sf):
    """Two models, a range of rows, named relations and one that doesn't exist, all through a run's options."""
    base = work_folder(spark, "run")
    options = RunOptions(
        tasks={SENTIMENT: [49, 102, 9999]}, models=("double-a", "double-b"), start_row=100, end_row=700, chunks=2, base_folder=base
    )
    models = {"double-a": MODEL, "double-b": replace(MODEL, name="double-b")}
    log, unknown = R.run_all(spark, options, {SENTIMENT: text_rows(spark, sf)}, models, resources(spark, sf), merged_catalog(spark))
    rows = log.select("llm", "mr", "row_id", F.explode("relations").alias("verdict"))
    return rows.withColumn("unknown", F.lit(",".join(str(mr) for _, mr in unknown)))


@query("e11_cached_slice", f"SELECT doc_id AS row_id, {S.rate('text')} AS output FROM documents WHERE doc_id >= 100")
def e11(spark, sf):
    """Outputs cached for all rows serve a part of them: rows meet by id, not by place."""
    path = work_folder(spark, "source_outputs")
    R.source_outputs(text_rows(spark, sf), MODEL, SENTIMENT, resources(spark, sf)).select("row_id", "source_output").write.parquet(path)
    part = R.row_range(text_rows(spark, sf), 100, 10**12)
    return part.join(spark.read.parquet(path), "row_id").select("row_id", F.col("source_output").alias("output"))


def resumed(spark, sf):
    """The labelled documents first, then everything, then everything again into the same log."""
    rows, res = text_rows(spark, sf), resources(spark, sf)
    tests, path = tests_of(spark, SENTIMENT, [49, 102, 150]), work_folder(spark, "results")
    R.run_resumable(labelled(spark, sf, rows), MODEL, SENTIMENT, tests, res, path, "run-1")
    R.run_resumable(rows, MODEL, SENTIMENT, tests, res, path, "run-2", chunks=2)
    return R.run_resumable(rows, MODEL, SENTIMENT, tests, res, path, "run-3")


@query("e12_resume", sentiment_sql([49, 102, 150], records_tail("s0")))
def e12(spark, sf):
    return record_rows(resumed(spark, sf).withColumn("mr", F.col("mr").cast("int")))


@query(
    "e13_latest_checkpoint",
    "SELECT 'a-second-run' AS run_id, 11 AS part, count(*) > 0 AS some FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def e13(spark, sf):
    """The newest part of a log of two runs, the second with twelve parts; neither names nor digits are in the order of time."""
    path, res = work_folder(spark, "results"), resources(spark, sf)
    tests, rows = tests_of(spark, SENTIMENT, [49]), text_rows(spark, sf)
    R.run_resumable(labelled(spark, sf, rows), MODEL, SENTIMENT, tests, res, path, "the-first-run", chunks=2)
    log = R.run_resumable(rows, MODEL, SENTIMENT, tests, res, path, "a-second-run", chunks=12)
    return R.latest_run(log).select("run_id", "part", (F.col("n") > 0).alias("some"))


@query(
    "e14_skip_finished",
    """SELECT 'run-1' AS run, 3 * count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'run-2', 3 * count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def e14(spark, sf):
    """How many records each run added: the second only the missing ones, the third none."""
    return resumed(spark, sf).groupBy(F.substring("run_id", 1, 5).alias("run")).agg(F.count("*").alias("n"))


@query("e12_arrivals", sentiment_sql([49, 102, 150], records_tail("s0")))
def e12_arrivals(spark, sf):
    """The same run over rows that arrive as files, in two calls of an available-now stream."""
    rows, res = text_rows(spark, sf), resources(spark, sf)
    tests = tests_of(spark, SENTIMENT, [49, 102, 150])
    source, results, state = (work_folder(spark, n) for n in ("arrivals", "results", "stream"))
    first = labelled(spark, sf, rows)
    first.write.parquet(source)
    run_arrivals(spark, source, results, state, MODEL, SENTIMENT, tests, res)
    rows.join(first.select("row_id"), "row_id", "left_anti").write.mode("append").parquet(source)
    log = run_arrivals(spark, source, results, state, MODEL, SENTIMENT, tests, res)
    return record_rows(log.withColumn("mr", F.col("mr").cast("int")))


@query("s27_result_log", sentiment_sql([49, 102], "SELECT '007' AS llm, mr, row_id, verdict FROM judged"))
def s27(spark, sf):
    """A model's name stays a text, though it names a folder and looks like a number."""
    path = work_folder(spark, "results")
    append_results(R.records(run_sentiment(spark, sf, [49, 102], pools=False)).withColumn("llm", F.lit("007")), path, "run-1")
    back = read_results(spark, path).where((F.col("task") == SENTIMENT) & (F.col("run_id") == "run-1"))
    return back.select("llm", "mr", "row_id", F.explode("relations").alias("verdict"))


@query(
    "violation_rates",
    sentiment_sql(
        [49, 102, 150, 151, 154],
        """SELECT llm, task, mr, count(verdict) AS judged,
        (count(*) FILTER (NOT verdict))::BIGINT AS violations
        FROM (SELECT 'double-a' AS llm, 'sentiment_analysis_continuous' AS task, * FROM judged) GROUP BY ROLLUP (llm, task, mr)""",
    ),
)
def rates(spark, sf):
    return R.violation_rates(run_sentiment(spark, sf, [49, 102, 150, 151, 154], pools=False))


def flagship(spark, sf):
    """Sentiment under upper-casing, as result records."""
    df = R.records(run_sentiment(spark, sf, [102], pools=False))
    return record_rows(df)


@query("e7_flagship", sentiment_sql([102], records_tail("s0")))
def e7_flagship(spark, sf):
    return flagship(spark, sf)


