"""Text primitives."""

from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.operators.sentence_model import sentence_statistics

from . import sqltext as S
from .registry import query
from .views import documents, inference_raw, question_raw, table

CALLED = S.with_views


@query("x1_clean_text", f"SELECT doc_id AS row_id, {S.clean('text')} AS cleaned FROM documents")
def x1(spark, sf):
    return documents(spark, sf).select("row_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("x2_string_to_float", f"SELECT page_id AS row_id, {S.number('html')} AS number FROM pages")
def x2(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), X.string_to_float(F.col("html")).alias("number"))


@query(
    "x3_both_numeric",
    f"SELECT page_id AS row_id, ({S.number('url')} IS NOT NULL AND {S.number('html')} IS NOT NULL) AS judged FROM pages",
)
def x3(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("row_id"), X.both_numeric(F.col("url"), F.col("html")).alias("judged")
    )


@query(
    "x4_is_subset",
    CALLED(f"SELECT row_id, {S.subset('premise', 'hypothesis')} AS inside FROM nli_raw", "nli_raw"),
)
def x4(spark, sf):
    return inference_raw(spark, sf).select("row_id", X.is_subset(F.col("premise"), F.col("hypothesis")).alias("inside"))


def _unnest(list_sql: str, name: str) -> str:
    return (
        f"SELECT row_id, pos, {name} FROM (SELECT row_id, unnest(l) AS {name}, generate_subscripts(l, 1) - 1 AS pos "
        f"FROM (SELECT doc_id AS row_id, {list_sql} AS l FROM documents))"
    )


@query("x5_sentences", _unnest(S.sents("text"), "sentence"))
def x5(spark, sf):
    return documents(spark, sf).select(
        "row_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query("x6_words", f"SELECT doc_id AS row_id, {S.join(S.words('text'))} AS tokens FROM documents")
def x6(spark, sf):
    return documents(spark, sf).select("row_id", X.join_words(X.words(F.col("text"))).alias("tokens"))


@query("x7_keyword_parse", _unnest(S.keywords("text"), "keyword"))
def x7(spark, sf):
    parsed = documents(spark, sf).select("row_id", F.posexplode(X.parse_keywords(F.col("text"))).alias("pos", "keyword"))
    return parsed.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "x8_bind_context",
    CALLED(
        f"SELECT row_id, context || chr(10) || question AS context, unnest({S.keywords('question')}) AS keyword FROM qa_raw",
        "qa_raw",
    ),
)
def x8(spark, sf):
    rows = question_raw(spark, sf).select("row_id", F.array("context", "question").alias("inputs"), "question")
    bound = rows.select(
        "row_id",
        F.explode(
            F.transform(X.parse_keywords(F.col("question")), lambda k: X.bind_context(X.join_inputs(F.col("inputs")), k))
        ).alias("b"),
    )
    return bound.select("row_id", F.get("b", F.lit(0)).alias("context"), F.get("b", F.lit(1)).alias("keyword"))


@query(
    "x9_cosine",
    f"""SELECT a.vec_id AS row_id, round({S.cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS similarity,
        {S.cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} >= 0.1 AS close
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def x9(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    following = vectors.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("following"))
    pairs = vectors.join(following, "row_id")
    near = X.cosine(F.col("embedding"), F.col("following"))
    return pairs.select("row_id", F.round(near, 6).alias("similarity"), (near >= F.lit(0.1)).alias("close"))


_TOKENS = r"list_filter(string_split_regex(text, '[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda t: t <> '')"
_BARE = lambda t: rf"regexp_replace(regexp_replace({t}, '\A[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.!?]+\z', '')"
_WORD = lambda t: rf"lower(regexp_replace({t}, '[.!?]\z', ''))"
_LIKELY = lambda p, k, n: f"(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln({p}) END + CASE WHEN {n} = {k} THEN 0.0 ELSE ({n} - {k}) * ln(1 - {p}) END)"


def _together(a, b, both, n):
    p, p1, p2 = f"({b} / {n})", f"({both} / {a})", f"(({b} - {both}) / ({n} - {a}))"
    parts = [_LIKELY(p1, both, a), _LIKELY(p2, f"({b} - {both})", f"({n} - {a})"), _LIKELY(p, both, a), _LIKELY(p, f"({b} - {both})", f"({n} - {a})")]
    return f"2 * ({parts[0]} + {parts[1]} - {parts[2]} - {parts[3]})"


@query(
    "x5_trained_sentences",
    rf"""
    WITH t AS (SELECT {_TOKENS} AS toks FROM documents WHERE text IS NOT NULL),
    rows AS (SELECT unnest(range(len(toks))) = 0 AS first, unnest(toks) AS a, unnest(list_append(toks[2:], NULL)) AS b FROM t WHERE len(toks) > 0),
    bare AS (SELECT *, {_BARE('a')} AS ba, {_BARE('b')} AS bb FROM rows),
    types AS (
        SELECT {_WORD('ba')} AS word, count(*)::DOUBLE AS n, (count(*) FILTER (ends_with(ba, '.')))::DOUBLE AS n_stop,
               count(*) FILTER (regexp_matches(ba, '\A\p{{Lu}}') AND NOT first) AS n_upper, count(*) FILTER (regexp_matches(ba, '\A\p{{Ll}}')) AS n_lower
        FROM bare WHERE regexp_matches({_WORD('ba')}, '[\p{{L}}\p{{N}}]') GROUP BY 1
    ), total AS (SELECT sum(n) AS n, sum(n_stop) AS stops, greatest(2, ceil(sum(n_stop) * 1e-5)) AS least FROM types),
    sized AS (SELECT *, length(replace(word, '.', ''))::DOUBLE AS size, length(word) - length(replace(word, '.', '')) AS dots FROM types),
    abbr AS (
        SELECT word, w.n, 2 * ({_LIKELY('0.99', 'w.n_stop', 'w.n')} - {_LIKELY('(total.stops / total.n)', 'w.n_stop', 'w.n')})
               * exp(-size) * (dots + 1) * exp(-(w.n - w.n_stop) * ln(size)) AS score
        FROM sized w, total WHERE w.n_stop >= least AND regexp_matches(word, '\p{{L}}')
    ), short AS (SELECT * FROM abbr WHERE score >= 0.3),
    after AS (
        SELECT {_WORD('ba')} AS word, {_WORD('bb')} AS next, ends_with(ba, '.') AS stop, regexp_matches(bb, '\A\p{{Lu}}') AS upper
        FROM bare WHERE b IS NOT NULL AND regexp_matches(a, '[.!?][^\p{{L}}\p{{N}}.!?]*\z') AND regexp_matches({_WORD('bb')}, '[\p{{L}}\p{{N}}]')
    ), marked AS (SELECT *, stop AND (word IN (SELECT word FROM short) OR length(word) = 1) AS is_short FROM after),
    ends AS (SELECT count(*)::DOUBLE AS e FROM marked WHERE NOT is_short),
    started AS (SELECT next AS word, count(*)::DOUBLE AS n FROM marked WHERE NOT is_short GROUP BY 1),
    starters AS (
        SELECT s.word, s.n, {_together('e', 't.n', 's.n', 'total.n')} AS score FROM started s JOIN types t USING (word), total, ends
        WHERE s.n >= least AND s.n * total.n > e * t.n AND t.n < total.n
    ), held AS (SELECT word, next, count(*)::DOUBLE AS n FROM marked WHERE is_short OR (stop AND regexp_matches(word, '^[0-9]+$')) GROUP BY 1, 2),
    pairs AS (
        SELECT h.word, h.next, h.n, {_together('a.n_stop', 'b.n', 'h.n', 'total.n')} AS score
        FROM held h JOIN types a ON a.word = h.word JOIN types b ON b.word = h.next, total
        WHERE h.n >= least AND h.n * total.n > a.n_stop * b.n AND b.n < total.n AND h.next NOT IN (SELECT word FROM starters WHERE score >= 30)
    ), opened AS (
        SELECT o.word, o.n, t.n_lower::DOUBLE AS score FROM (SELECT next AS word, count(*)::DOUBLE AS n FROM marked WHERE upper GROUP BY 1) o
        JOIN types t USING (word), total WHERE o.n >= least AND n_lower > 0 AND n_upper = o.n
    )
    SELECT kind, word, next, n::BIGINT AS n, round(score, 5) AS score FROM (
        SELECT 'abbreviation' AS kind, word, NULL AS next, n, score FROM short UNION ALL SELECT 'starter', word, NULL, n, score FROM starters WHERE score >= 30
        UNION ALL SELECT 'collocation', word, next, n, score FROM pairs WHERE score >= 7.88 UNION ALL SELECT 'opener', word, NULL, n, score FROM opened)
    """,
)
def x5_trained(spark, sf):
    return sentence_statistics(table(spark, sf, "documents").select("text")).withColumn("score", F.round("score", 5))


# Every fifth word of a text gets an ending, so that there are contractions to cut.
_CONTRACTED = """regexp_replace(lower(text), '([a-z]+ [a-z]+ [a-z]+) ([a-z]+) ', '\\1n''t can''t \\2''ll CANNOT gonna ', 'g')"""


@query(
    "x6_contractions",
    rf"""
    WITH t AS (SELECT doc_id, {_CONTRACTED} AS text FROM documents),
    marked AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}])(n''t)', '\1' || chr(1) || '\2', 'g'),
        '([\p{{L}}\p{{N}}])(''(?:s|m|d|re|ve|ll))([^\p{{L}}\p{{N}}])', '\1' || chr(1) || '\2\3', 'g'), '(?i)(can)(not)|(gon)(na)', '\1\3' || chr(1) || '\2\4', 'g') AS m FROM t)
    SELECT doc_id AS row_id, array_to_string(regexp_extract_all(m, 'n''t|''(?:s|m|d|re|ve|ll)|[\p{{L}}\p{{N}}]+|[^\x01\s\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}\p{{L}}\p{{N}}]'), ' ') AS said, true AS whole FROM marked
    """,
)
def x6_contractions(spark, sf):
    """The words joined by blanks, and whether the pieces give the text back."""
    text = F.regexp_replace(F.lower("text"), "([a-z]+ [a-z]+ [a-z]+) ([a-z]+) ", "$1n't can't $2'll CANNOT gonna ")
    rows = documents(spark, sf).select("row_id", text.alias("text"))
    whole = F.array_join(X.contraction_pieces(F.col("text")), "") == F.col("text")
    return rows.select("row_id", X.join_words(X.contraction_words(F.col("text"))).alias("said"), whole.alias("whole"))
