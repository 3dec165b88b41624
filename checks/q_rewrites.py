"""Input transformations that ask a helper, with the rule-based double as helper."""

from pyspark.sql import functions as F

from driftline.functions.draws import seed_for
from driftline.functions.text import rows_of
from driftline.operators import rewrites as W
from driftline.operators.answer_checks import sentiment_word
from driftline.operators.registry import TRANSFORMS
from driftline.operators.rewrites import Edit
from driftline.plans.templates import template

from . import sqltext as S
from .doubles import HELPER
from .q_edits import re_rows_sql, variant_texts
from .registry import query
from .views import documents, inference_rows, question_rows, relation_rows, text_rows, word_pool

SEED = 42


KINDS = {
    "docs": (text_rows, 1, ("docs",), {}, ("text",), "docs"),
    "nli": (inference_rows, 2, ("nli_raw",), {}, ("premise", "hypothesis"), "nli_raw"),
    "qa": (question_rows, 2, ("qa_raw",), {}, ("context", "question"), "qa_raw"),
    "re": (relation_rows, 3, ("re_raw",), {"re_rows": re_rows_sql()}, ("text", "head", "tail"), "re_rows"),
}


def rewritten(name, kind, transform, sql_steps, sql_variants, params=None, words=False, **more):
    """Register a query (row_id, variant, place, text).

    ``sql_steps`` maps CTE names to SELECTs, the last one is what ``sql_variants`` (lists of expressions) reads.
    """
    rows, arity, views, ctes, _, base = KINDS[kind]
    last = list(sql_steps)[-1] if sql_steps else base
    parts = [
        f"SELECT row_id, {v}::BIGINT AS variant, {p}::BIGINT AS place, {expression} AS text FROM {last}"
        for v, variant in enumerate(sql_variants)
        for p, expression in enumerate(variant)
    ]
    pools = ("prime",) if words else ()

    @query(name, S.with_views("\nUNION ALL ".join(parts), *views, *pools, **ctes, **sql_steps))
    def run(spark, sf):
        pool = word_pool(spark, sf) if words else None
        edit = Edit(helper=HELPER, seed=SEED, arity=arity, words=pool, **more)
        return variant_texts(TRANSFORMS[transform](rows(spark, sf), edit, params or {}))


# Rewriting, adding, sentiment, keywords

SINGLE = ("word_insertion", "paraphrasing", "declarative_interrogative", "misspell", "passive_active", "emphasis_words",
          "capitalize_words", "tense_change")


@query(
    "i24_rewrite",
    "\nUNION ALL ".join(f"SELECT doc_id AS row_id, '{n}' AS prompt, {S.echo(n, 'text')} AS text FROM documents" for n in SINGLE),
)
def i24(spark, sf):
    df = text_rows(spark, sf)
    for name in SINGLE:
        df = W.rewrite(df, Edit(helper=HELPER, out=name), f"it_prompt:{name}")
    texts = F.array(*[F.struct(F.lit(n).alias("prompt"), F.get(F.get(n, F.lit(0)), F.lit(0)).alias("text")) for n in SINGLE])
    return df.select("row_id", F.inline(texts))


FROM_H, FROM_P = "generate_hypothesis_from_hypothesis", "generate_hypothesis_from_premesis"
rewritten(
    "i24_rewrite_multi_input", "nli", "rewrite", {}, [["premise", S.echo(FROM_H, "premise", "hypothesis")]],
    {"template": f"it_prompt:{FROM_H}"}, indices=((1,),),
)
rewritten(
    "i25_rewrite_sentences", "docs", "rewrite_sentences", {},
    [[S.join(f"list_transform({S.sents('text')}, lambda s: 'singular_plural: ' || s)")]], {"template": "it_prompt:singular_plural"},
)
rewritten(
    "i26_append_generated", "nli", "append_generated", {},
    [["premise", "hypothesis || ' ' || " + S.echo(FROM_P, "premise", "hypothesis")]], {"template": f"it_prompt:{FROM_P}"}, indices=((1,),),
)

MOODS = "['positive', 'negative', 'neutral']"


@query("i27_sentiment_word", f"SELECT doc_id AS row_id, {MOODS}[1 + length(text) % 3] AS mood FROM documents")
def i27(spark, sf):
    return sentiment_word(documents(spark, sf), "text", "mood", HELPER).select("row_id", "mood")


def _dotted() -> str:
    stripped = f"regexp_replace(s, '^{S.WHITE}+|{S.WHITE}+$', '', 'g') || '.'"
    return f"list_transform(list_filter(string_split(text, '.'), lambda s: s <> ''), lambda s: {stripped})"


GROUPED = {
    "d1": f"SELECT row_id, text, {_dotted()} AS l FROM docs",
    "d2": "SELECT row_id, CASE WHEN len(l) = 0 OR text LIKE '%.' THEN l ELSE list_concat(l[1:len(l) - 1], [rtrim(l[len(l)], '.')]) END AS l FROM d1",
    "d3": "SELECT row_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM d2",
    "d4": "SELECT row_id, s, min(pos) AS pos FROM d3 GROUP BY row_id, s",
    "d5": "SELECT row_id, length(s) % 3 AS mood, string_agg(s, ' ' ORDER BY pos) AS s FROM d4 GROUP BY row_id, length(s) % 3",
    "d6": "SELECT row_id, string_agg(s, ' ' ORDER BY mood) AS text FROM d5 GROUP BY row_id",
    "d7": "SELECT docs.row_id, coalesce(d6.text, '') AS text FROM docs LEFT JOIN d6 USING (row_id)",
}
rewritten("i28_group_by_sentiment", "docs", "group_by_sentiment", GROUPED, [["text"]])
rewritten(
    "i29_back_translate", "docs", "back_translate", {}, [["'to_english: to_korean: ' || text"]], {"to": "helper:to_korean"}
)
rewritten("i23_back_translate", "docs", "back_translate", {}, [["'to_english: to_german: ' || text"]])


@query(
    "i30_keywords",
    f"""SELECT row_id, unnest(kw) AS keyword, generate_subscripts(kw, 1) - 1 AS pos
        FROM ({S.with_keywords('SELECT doc_id AS row_id, text FROM documents', 'text')})""",
)
def i30(spark, sf):
    rows = W.keywords(text_rows(spark, sf), Edit(helper=HELPER), W.input_at(0), "kw")
    return rows.select("row_id", rows_of(F.col("kw")).alias("pos", "keyword")).where("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("bigint"))


# Keywords replaced


def with_partners(source: str, kw: str = "kw", to: str = "partners") -> str:
    return f"SELECT *, list_transform({kw}, lambda k: {S.clean('reverse(k)')}) AS {to} FROM ({source})"


def with_rules(source: str, kw: str = "kw", to: str = "partners", out: str = "rules") -> str:
    pairs = f"list_transform(list_zip({kw}, {to}), lambda z: z[1] || ' -> ' || z[2])"
    return f"SELECT *, array_to_string({pairs}, chr(10)) AS {out} FROM ({source})"


def apply(text: str, rules: str = "rules") -> str:
    return S.echo("apply_rules", text, rules)


def kw_rules(base: str, text: str, filtered: str | None = None) -> dict[str, str]:
    """Steps for keywords of ``text``, their partners and the rules."""
    found = S.with_keywords(f"SELECT * FROM {base}", text)
    if filtered:
        found = f"SELECT * REPLACE ({filtered} AS kw) FROM ({found})"
    return {"k1": found, "k2": with_rules(with_partners("SELECT * FROM k1"))}


NOT_ENTITY = f"list_filter(kw, lambda k: k <> {S.clean('head')} AND k <> {S.clean('tail')})"


@query(
    "i32_replace_by_rules",
    S.with_views(f"SELECT row_id, rules, {apply('text')} AS text FROM k2", "docs", **kw_rules("docs", "text")),
)
def i32(spark, sf):
    edit = Edit(helper=HELPER)
    df = W.keywords(text_rows(spark, sf), edit, W.input_at(0), "kw")
    df = W._word_for_word(df, edit, "helper:category_word", "kw", None, "partners")
    df = W._replace(df, edit, W.input_at(0), "kw", "partners", "text")
    return df.select("row_id", W.rules_text(F.col("kw"), F.col("partners")).alias("rules"), "text")


rewritten(
    "i33_replace_category", "nli", "replace_category", kw_rules("nli_raw", "premise || chr(10) || chr(10) || hypothesis"),
    [[apply("premise"), apply("hypothesis")]],
)
rewritten(
    "i34_replace_category_qa", "qa", "replace_category_qa", kw_rules("qa_raw", "question"), [[apply("context"), apply("question")]]
)
rewritten(
    "i35_replace_category_re", "re", "replace_category_re",
    {
        "k1": f"SELECT *, [{S.clean('head')}, {S.clean('tail')}] AS kw FROM re_rows",
        "k2": with_rules(with_partners("SELECT * FROM k1")),
    },
    [[apply("text"), "partners[1]", "partners[2]"]],
)
rewritten("i36_replace_synonym", "docs", "replace_synonym", kw_rules("docs", "text"), [[apply("text")]])


@query(
    "i37_entity_keywords",
    S.with_views(
        "SELECT row_id, unnest(kw) AS keyword, generate_subscripts(kw, 1) - 1 AS pos FROM k1",
        "re_raw", re_rows=re_rows_sql(), k1=kw_rules("re_rows", "text", NOT_ENTITY)["k1"],
    ),
)
def i37(spark, sf):
    rows = W.entity_keywords(relation_rows(spark, sf), Edit(helper=HELPER, arity=3), "kw")
    return rows.select("row_id", rows_of(F.col("kw")).alias("pos", "keyword")).where("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("bigint"))


TWO_TEXTS = {
    **{f"p{k[1]}": v.replace("k1", "p1") for k, v in kw_rules("nli_raw", "premise").items()},
    "q1": "SELECT * EXCLUDE (kw, partners, rules), rules AS p_rules FROM p2",
    "q2": S.with_keywords("SELECT * FROM q1", "hypothesis"),
    "q3": with_rules(with_partners("SELECT * FROM q2")),
}
rewritten(
    "i38_replace_antonym", "nli", "replace_antonym", TWO_TEXTS,
    [[apply("premise", "p_rules"), "hypothesis"], ["premise", apply("hypothesis")]], indices=((0,), (1,)),
)
rewritten(
    "i39_replace_antonym_qa", "qa", "replace_antonym_qa", kw_rules("qa_raw", "question"),
    [[apply("context"), "question"], ["context", apply("question")]],
)
rewritten(
    "i40_replace_antonym_re", "re", "replace_antonym_re", kw_rules("re_rows", "text", NOT_ENTITY), [[apply("text"), "head", "tail"]]
)


def random_partners(source: str, seed: int, kw: str, to: str) -> str:
    """Different words for the keywords: a walk with a fixed step round a prime, numbers beyond the pool left out."""
    start = f"({S.draw('row_id', '1', seed)}) % prime.p"
    step = f"({S.draw('row_id', '2', seed)}) % greatest(prime.p - 1, 1) + 1"
    walked = f"SELECT s.*, prime.n AS n_w, prime.p AS p_w, {start} AS a_w, {step} AS b_w FROM ({source}) s, prime"
    numbers = "list_transform(range(0, len(kw_) + p_w - n_w + 1), lambda j: (a_w + j * b_w) % p_w)".replace("kw_", kw)
    kept = f"SELECT *, list_filter(l_w, lambda x: x < n_w)[1:len({kw})] AS i_w FROM (SELECT *, {numbers} AS l_w FROM ({walked}))"
    words = "(SELECT list(value ORDER BY idx) AS w_w FROM word_pool)"
    return (
        f"SELECT * EXCLUDE (n_w, p_w, a_w, b_w, l_w, i_w, w_w), list_transform(i_w, lambda i: w_w[i + 1]) AS {to} "
        f"FROM ({kept}) k, {words} w"
    )


rewritten(
    "i41_replace_random", "docs", "replace_random",
    {
        "k1": S.with_keywords("SELECT * FROM docs", "text"),
        "k2": with_rules(random_partners("SELECT * FROM k1", seed_for(SEED, 25, 0, 1), "kw", "partners")),
    },
    [[apply("text")]], words=True, relation=25,
)
rewritten(
    "i42_replace_random_qa", "qa", "replace_random_qa",
    {
        "k1": S.with_keywords("SELECT * FROM qa_raw", "question"),
        "k2": with_rules(random_partners("SELECT * FROM k1", seed_for(SEED, 25, 0, 1), "kw", "to_c"), "kw", "to_c", "rules_c"),
        "k3": with_rules(random_partners("SELECT * FROM k2", seed_for(SEED, 25, 1, 2), "kw", "to_q"), "kw", "to_q", "rules_q"),
    },
    [[apply("context", "rules_c"), "question"], ["context", apply("question", "rules_q")],
     [apply("context", "rules_c"), apply("question", "rules_q")]],
    words=True, relation=25,
)
rewritten(
    "i43_replace_random_re", "re", "replace_random_re",
    {
        "k1": kw_rules("re_rows", "text", NOT_ENTITY)["k1"],
        "k2": with_rules(random_partners("SELECT * FROM k1", seed_for(SEED, 25, 0, 1), "kw", "partners")),
    },
    [[apply("text"), "head", "tail"]], words=True, relation=25,
)


# Keywords removed, negation


def removed(text: str) -> str:
    return S.echo("remove_words", text, "array_to_string(kw, chr(10))")


def removed_by_sentence(text: str) -> str:
    return S.join(f"list_transform({S.sents(text)}, lambda s: 'remove_words: ' || s || ' | ' || array_to_string(kw, chr(10)))")


TRANSFORMS["remove_keywords_whole"] = lambda df, e, p: W.remove_keywords(df, e, by_sentence=False)
rewritten(
    "i45_remove_keywords", "docs", "remove_keywords_whole", {"k1": S.with_keywords("SELECT * FROM docs", "text")}, [[removed("text")]]
)
rewritten(
    "i46_remove_keywords_by_sentence", "docs", "remove_keywords", {"k1": S.with_keywords("SELECT * FROM docs", "text")},
    [[removed_by_sentence("text")]],
)
rewritten(
    "i47_remove_keywords_qa", "qa", "remove_keywords_qa", {"k1": S.with_keywords("SELECT * FROM qa_raw", "question")},
    [[removed_by_sentence("context"), "question"], ["context", removed_by_sentence("question")],
     [removed_by_sentence("context"), removed_by_sentence("question")]],
)
rewritten(
    "i48_remove_keywords_re", "re", "remove_keywords_re", {"k1": kw_rules("re_rows", "text", NOT_ENTITY)["k1"]},
    [[removed_by_sentence("text"), "head", "tail"]],
)
rewritten("i49_negate", "docs", "negate", {}, [[S.echo("negate_text", "text")]])
rewritten(
    "i50_negate_qa", "qa", "negate_qa", {},
    [[S.echo("negate_context", "context", "question"), "question"], ["context", S.echo("negate_text", "question")]],
)
rewritten("i51_negate_re", "re", "negate_re", {}, [[S.echo("negate_text", "text"), "head", "tail"]])
rewritten(
    "i51_negate_re_entity_aware", "re", "negate_re", {}, [[S.echo("negate_relation", "text", "head", "tail"), "head", "tail"]],
    {"entity_aware": "true"},
)


@query(
    "p6_transform_targeted",
    S.with_views(
        f"""SELECT row_id, 'one' AS seen, {S.echo('paraphrasing', 'hypothesis')} AS text FROM nli_raw
        UNION ALL SELECT row_id, 'all', {S.echo(FROM_P, 'premise', 'hypothesis')} FROM nli_raw""",
        "nli_raw",
    ),
)
def p6(spark, sf):
    """A prompt sees the input that is changed, or the whole row if it is a multi-input prompt."""
    edit = Edit(helper=HELPER, indices=((1,),), arity=2)
    df = W.rewrite(inference_rows(spark, sf), edit, "it_prompt:paraphrasing").withColumnRenamed("variants", "one")
    df = W.rewrite(df, edit, template(f"it_prompt:{FROM_P}").key)
    seen = [F.struct(F.lit(n).alias("seen"), F.get(F.get(c, F.lit(0)), F.lit(1)).alias("text")) for n, c in (("one", "one"), ("all", "variants"))]
    return df.select("row_id", F.inline(F.array(*seen)))
