"""Input transformations without a model, over whole documents."""

from pyspark.sql import functions as F

from driftline.functions.draws import KEY_SHIFT, seed_for
from driftline.functions.text import rows_of
from driftline.operators.local_edits import KEYBOARD, OCR
from driftline.operators.phrases import remove_phrases, replace_phrases
from driftline.operators.registry import TRANSFORMS
from driftline.operators.rewrites import Edit
from driftline.operators.spelling import spelling_index

from . import sqltext as S
from .registry import query
from .views import (
    documents,
    inference_rows,
    relation_rows,
    sentence_pool,
    table,
    text_rows,
    word_pool,
    word_values,
)

SEED = 42


def variant_texts(df, column="variants"):
    """(row_id, variant, place, text): the long, scalar form of an array of variants."""
    rows = df.select("row_id", rows_of(F.col(column)).alias("variant", "inputs")).where("variant IS NOT NULL")
    return (
        rows.select("row_id", F.col("variant").cast("bigint").alias("variant"), rows_of(F.col("inputs")).alias("place", "text"))
        .where("place IS NOT NULL")
        .withColumn("place", F.col("place").cast("bigint"))
    )


def edited(spark, sf, name, params=None, relation=0, **more):
    """The first changed input of every document."""
    edit = Edit(relation=relation, seed=SEED, **more)
    df = TRANSFORMS[name](text_rows(spark, sf), edit, params or {})
    return df.select("row_id", F.get(F.get("variants", F.lit(0)), F.lit(0)).alias("text"))


def per_document(expression: str) -> str:
    return f"SELECT doc_id AS row_id, {expression} AS text FROM documents"


# Fixed edits


@query("i1_no_change", per_document("text"))
def i1(spark, sf):
    return edited(spark, sf, "no_change", relation=49)


@query("i2_upper", per_document(S.upper("text")))
def i2(spark, sf):
    return edited(spark, sf, "upper", relation=102)


@query(
    "i3_exclaim",
    per_document("CASE WHEN replace(text, '.', '!') LIKE '%!' THEN replace(text, '.', '!') ELSE replace(text, '.', '!') || '!' END"),
)
def i3(spark, sf):
    return edited(spark, sf, "exclaim", relation=150)


def re_rows_sql() -> str:
    """Text, head and tail of every viable row, all of the table."""
    pick = f"labels[1 + {S.draw('row_id', '1', seed_for(SEED, salt=3))} % len(labels)]"
    named = (
        f"list_transform(names, lambda v, i: CASE WHEN {S.draw('row_id', 'i', seed_for(SEED, salt=2))} % 2 = 0 "
        f"THEN v ELSE {S.upper('v')} END)"
    )
    text = r"regexp_replace(array_to_string(flatten(sents), ' '), '\s+([,.!?;:])', '\1', 'g')"
    return (
        f"SELECT row_id, text, named[r.h + 1] AS head, named[r.t + 1] AS tail, r.r AS code FROM (SELECT row_id, {text} AS text, "
        f"{named} AS named, {pick} AS r FROM re_raw WHERE len(labels) > 0)"
    )


@query(
    "i4_permute",
    S.with_views("SELECT row_id, text, tail AS second, head AS third FROM re_rows", "re_raw", re_rows=re_rows_sql()),
)
def i4(spark, sf):
    rows = relation_rows(spark, sf)
    swapped = TRANSFORMS["permute"](rows, Edit(arity=3), {"permute_to": "[0,2,1]"})
    one = F.get("variants", F.lit(0))
    return swapped.select(
        "row_id", F.get(one, F.lit(0)).alias("text"), F.get(one, F.lit(1)).alias("second"), F.get(one, F.lit(2)).alias("third")
    )


@query("i5_append_constant", per_document("text || ' It is so.'"))
def i5(spark, sf):
    return edited(spark, sf, "append_constant", {"addition": "It is so."})


def pool_join(pool: str, index: str, expression: str) -> str:
    return S.with_views(
        f"SELECT row_id, {expression} AS text FROM (SELECT *, {index} AS pick FROM docs) d JOIN {pool} p ON p.idx = d.pick",
        "docs",
        pool,
    )


@query(
    "i6_append_random_sentence",
    pool_join(
        "sent_pool",
        f"{S.draw('row_id', '1', seed_for(SEED, 84, 0))} % (SELECT count(*) FROM sent_pool)",
        "d.text || ' ' || p.value",
    ),
)
def i6(spark, sf):
    return edited(spark, sf, "append_random_sentence", relation=84, sentences=sentence_pool(spark, sf))


@query("i7_shuffle_sentences", per_document(S.join(S.shuffled(S.sents("text"), "doc_id", seed_for(SEED, 19)))))
def i7(spark, sf):
    return edited(spark, sf, "shuffle_sentences", relation=19)


# Words change places


def _unnested(list_sql: str, name: str = "w") -> str:
    """(row_id, pos, item) with pos from 1."""
    return f"SELECT row_id, unnest(l) AS {name}, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id AS row_id, {list_sql} AS l FROM documents)"


IS_PUNCT = f"contains('{S.PUNCT}', w)"


@query(
    "i8_shuffle_words",
    f"""WITH tok AS ({_unnested(S.words('text'))}),
    ranked AS (SELECT *, {IS_PUNCT} AS punct, row_number() OVER (PARTITION BY row_id, {IS_PUNCT} ORDER BY pos) AS k FROM tok),
    drawn AS (SELECT row_id, w, row_number() OVER (PARTITION BY row_id ORDER BY {S.draw('row_id', 'k', seed_for(SEED))}, k) AS k
              FROM ranked WHERE NOT punct)
    SELECT r.row_id, string_agg(coalesce(d.w, r.w), ' ' ORDER BY r.pos) AS text
    FROM ranked r LEFT JOIN drawn d ON d.row_id = r.row_id AND d.k = r.k AND NOT r.punct GROUP BY r.row_id""",
)
def i8(spark, sf):
    return edited(spark, sf, "shuffle_words")


@query(
    "i9_shuffle_words_in_sentences",
    f"""WITH sent AS ({_unnested(S.sents('text'), 's')}),
    tok AS (SELECT row_id, spos, unnest(l) AS w, generate_subscripts(l, 1) AS pos
            FROM (SELECT row_id, pos - 1 AS spos, {S.words('s')} AS l FROM sent)),
    ranked AS (SELECT *, {IS_PUNCT} AS punct, row_number() OVER (PARTITION BY row_id, spos, {IS_PUNCT} ORDER BY pos) AS k FROM tok),
    drawn AS (SELECT row_id, spos, w, row_number() OVER (PARTITION BY row_id, spos
              ORDER BY {S.draw('(row_id * 1009 + spos)', 'k', seed_for(SEED))}, k) AS k FROM ranked WHERE NOT punct)
    SELECT row_id, string_agg(s, ' ' ORDER BY spos) AS text FROM (
      SELECT r.row_id, r.spos, string_agg(coalesce(d.w, r.w), ' ' ORDER BY r.pos) AS s
      FROM ranked r LEFT JOIN drawn d ON d.row_id = r.row_id AND d.spos = r.spos AND d.k = r.k AND NOT r.punct
      GROUP BY r.row_id, r.spos) GROUP BY row_id""",
)
def i9(spark, sf):
    return edited(spark, sf, "shuffle_words_in_sentences")


# Chosen characters


def chosen_items(list_sql: str, seed: int, count: str, eligible: str = "true") -> str:
    """CTEs ``item`` (row_id, w, pos) and ``pick`` with ``chosen`` per item."""
    return f"""item AS ({_unnested(list_sql)}),
    keyed AS (SELECT *, {eligible} AS ok, {S.draw('row_id', 'pos', seed)} AS h FROM item),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, ok ORDER BY h, pos) AS rk,
               count(*) FILTER (ok) OVER (PARTITION BY row_id) AS n FROM keyed),
    pick AS (SELECT *, ok AND rk <= {count} AS chosen FROM ranked)"""


FULL, ONE_LESS = "ceil(n * 0.1::DOUBLE)", "ceil((n - 1) * 0.1::DOUBLE)"
IS_LETTER = r"regexp_matches(w, '^\p{L}$')"


def char_oracle(relation: int, changed: str) -> str:
    chosen = chosen_items("string_split(text, '')", seed_for(SEED, relation), FULL, IS_LETTER)
    return f"WITH {chosen} SELECT row_id, string_agg(CASE WHEN chosen THEN {changed} ELSE w END, '' ORDER BY pos) AS text FROM pick GROUP BY row_id"


def random_letter(relation: int) -> str:
    return f"chr((97 + {S.draw('row_id', 'pos', seed_for(SEED, relation, 0, 1))} % 26)::INT)"


@query(
    "i10_chosen_words",
    f"WITH {chosen_items(S.words('text'), seed_for(SEED), ONE_LESS)} SELECT row_id, pos, w AS word FROM pick WHERE chosen",
)
def i10(spark, sf):
    from driftline.functions.draws import edit_chosen
    from driftline.functions.text import words
    from driftline.operators.local_edits import one_less_share

    marked = edit_chosen(
        F.transform(words(F.col("text")), lambda w: F.struct(w.alias("word"), F.lit(False).alias("chosen"))),
        F.col("row_id"), seed_for(SEED), one_less_share(0.1),
        lambda s, k: F.struct(s["word"].alias("word"), F.lit(True).alias("chosen")),
    )
    rows = documents(spark, sf).select("row_id", F.posexplode(marked).alias("pos", "s"))
    return rows.where("s.chosen").select("row_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "s.word")


@query(
    "i11_chosen_letters",
    f"""WITH {chosen_items("string_split(text, '')", seed_for(SEED), FULL, IS_LETTER)}
    SELECT row_id, count(*) FILTER (chosen) AS changed, sum(pos) FILTER (chosen)::BIGINT AS places,
    ceil(max(n) * 0.1::DOUBLE)::BIGINT AS expected FROM pick GROUP BY row_id HAVING max(n) > 0""",
)
def i11(spark, sf):
    """Places of the chosen letters: characters that an inserted space follows."""
    from driftline.operators.char_edits import edit_characters

    # U+0001 does not occur in the texts, so marks are told from spaces of the text.
    marked = edit_characters(F.replace("text", F.lit(" "), F.lit("\u0001")), F.col("row_id"), "space", seed_for(SEED), 0)
    docs = documents(spark, sf).withColumn("parts", F.split(marked, " "))
    lengths = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.length(p).cast("bigint"))
    total = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), (acc["sum"] + acc["at"] + n).alias("sum")),
    )
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return docs.where(letters > 0).select(
        "row_id",
        (F.size("parts") - 1).cast("bigint").alias("changed"),
        total["sum"].alias("places"),
        F.ceil(letters * F.lit(0.1)).alias("expected"),
    )


@query("i12_replace_characters", char_oracle(1, random_letter(1)))
def i12(spark, sf):
    return edited(spark, sf, "replace_characters", relation=1)


@query("i13_delete_characters", char_oracle(2, "''"))
def i13(spark, sf):
    return edited(spark, sf, "delete_characters", relation=2)


@query("i14_add_characters", char_oracle(4, f"w || {random_letter(4)}"))
def i14(spark, sf):
    return edited(spark, sf, "add_characters", relation=4)


@query("i15_leet", char_oracle(3, "translate(w, 'aeiot', '43107')"))
def i15(spark, sf):
    return edited(spark, sf, "leet", relation=3)


@query("i16_add_spaces", char_oracle(5, "w || ' '"))
def i16(spark, sf):
    return edited(spark, sf, "add_spaces", relation=5)


@query(
    "i17_swap_characters",
    f"""WITH {chosen_items("string_split(text, '')", seed_for(SEED, 6), FULL, IS_LETTER)},
    able AS (SELECT row_id, pos, w, chosen AND pos < count(*) OVER (PARTITION BY row_id) AS c FROM pick),
    runs AS (SELECT *, pos - row_number() OVER (PARTITION BY row_id, c ORDER BY pos) AS run,
             coalesce(lead(w) OVER o, '') AS following, coalesce(lag(c) OVER o, false) AS after FROM able WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
    heads AS (SELECT row_id, run, arg_min(w, pos) AS head, max(pos) AS last FROM runs WHERE c GROUP BY row_id, run)
    SELECT r.row_id, string_agg(CASE WHEN r.c THEN r.following WHEN r.after THEN h.head ELSE r.w END, '' ORDER BY r.pos) AS text
    FROM runs r LEFT JOIN heads h ON h.row_id = r.row_id AND h.last = r.pos - 1 GROUP BY r.row_id""",
)
def i17(spark, sf):
    return edited(spark, sf, "swap_characters", relation=6)


# Chosen words


def letters_of_chosen(inner: str, draw_row: str, seed: int) -> str:
    return S.shuffled(f"string_split({inner}, '')", draw_row, seed)


KEY = f"(h * {KEY_SHIFT} + pos - 1)"


@query(
    "i18_scramble_words",
    f"""WITH {chosen_items(S.words('text'), seed_for(SEED), ONE_LESS)}
    SELECT row_id, string_agg(CASE WHEN chosen THEN {S.join(letters_of_chosen('w', KEY, seed_for(SEED, 0, 0, 1)), '')} ELSE w END, ' ' ORDER BY pos) AS text
    FROM pick GROUP BY row_id""",
)
def i18(spark, sf):
    return edited(spark, sf, "scramble_words")


def _inside_tries() -> str:
    inner = "w[2:length(w) - 1]"
    tries = [S.join(letters_of_chosen(inner, f"({KEY} + {n})", seed_for(SEED, 7, 0, 1)), "") for n in range(10)]
    return f"w[1] || coalesce({', '.join(f'nullif({t}, {inner})' for t in tries)}, {inner}) || w[length(w)]"


@query(
    "i19_scramble_inside_words",
    f"""WITH {chosen_items(S.words('text'), seed_for(SEED, 7), FULL, 'length(w) >= 4')}
    SELECT row_id, string_agg(CASE WHEN chosen THEN {_inside_tries()} ELSE w END, ' ' ORDER BY pos) AS text
    FROM pick GROUP BY row_id""",
)
def i19(spark, sf):
    return edited(spark, sf, "scramble_inside_words", relation=7)


@query(
    "i20_insert_random_words",
    S.with_views(
        f"""SELECT row_id, string_agg(w || CASE WHEN chosen THEN ' ' || p.value ELSE '' END, ' ' ORDER BY pos) AS text
        FROM (SELECT *, CASE WHEN chosen THEN {S.draw('row_id', 'pos', seed_for(SEED, 0, 0, 1))} % (SELECT count(*) FROM word_pool) END AS i FROM pick) x
        LEFT JOIN word_pool p ON p.idx = x.i GROUP BY row_id""",
        "word_pool",
    ).replace("WITH ", f"WITH {chosen_items(S.words('text'), seed_for(SEED), ONE_LESS)},\n", 1),
)
def i20(spark, sf):
    return edited(spark, sf, "insert_random_words", words=word_pool(spark, sf))


# Chosen sentences


@query(
    "i21_delete_sentences",
    f"""WITH {chosen_items(S.sents('text'), seed_for(SEED), ONE_LESS)}
    SELECT row_id, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT chosen), '') AS text FROM pick GROUP BY row_id""",
)
def i21(spark, sf):
    return edited(spark, sf, "delete_sentences")


@query(
    "i22_replace_sentences",
    S.with_views(
        f"""SELECT row_id, string_agg(CASE WHEN chosen THEN p.value ELSE w END, ' ' ORDER BY pos) AS text
        FROM (SELECT *, {S.draw('row_id', '1', seed_for(SEED, 0, 0, 1))} % (SELECT count(*) FROM sent_pool) AS i FROM pick) x
        JOIN sent_pool p ON p.idx = x.i GROUP BY row_id""",
        "sent_pool",
    ).replace("WITH ", f"WITH {chosen_items(S.sents('text'), seed_for(SEED), ONE_LESS)},\n", 1),
)
def i22(spark, sf):
    return edited(spark, sf, "replace_sentences", sentences=sentence_pool(spark, sf))


# Typing errors, spelling


def typo_oracle(relation: int, table: dict[str, str]) -> str:
    known = "[" + "".join(table) + "]"
    plain = "".join(table)
    options = "[" + ", ".join(S.lit(v) for v in table.values()) + "]"
    seed = seed_for(SEED, relation, 0, 1)
    choice = f"{options}[instr('{plain}', c)]"
    return f"""WITH {chosen_items(S.pieces('text'), seed_for(SEED, relation), FULL, f"regexp_matches(w, '{known}')")},
    ch AS (SELECT row_id, pos, {KEY} AS key, unnest(string_split(w, '')) AS c, generate_subscripts(string_split(w, ''), 1) AS cpos
           FROM pick WHERE chosen),
    ck AS (SELECT *, regexp_matches(c, '{known}') AS cok, {S.draw('key', 'cpos', seed)} AS ch FROM ch),
    cr AS (SELECT *, row_number() OVER (PARTITION BY row_id, pos, cok ORDER BY ch, cpos) AS crk,
           count(*) FILTER (cok) OVER (PARTITION BY row_id, pos) AS cn FROM ck),
    ce AS (SELECT row_id, pos, cpos, CASE WHEN cok AND crk <= ceil(cn * 0.1::DOUBLE) THEN
             {choice}[1 + {S.draw(f'(ch * {KEY_SHIFT} + cpos - 1)', '1', seed)} % length({choice})] ELSE c END AS c FROM cr),
    cw AS (SELECT row_id, pos, string_agg(c, '' ORDER BY cpos) AS w FROM ce GROUP BY row_id, pos)
    SELECT p.row_id, string_agg(coalesce(cw.w, p.w), '' ORDER BY p.pos) AS text
    FROM pick p LEFT JOIN cw ON cw.row_id = p.row_id AND cw.pos = p.pos GROUP BY p.row_id"""


@query("i23_typos_keyboard", typo_oracle(126, KEYBOARD))
def i23a(spark, sf):
    return edited(spark, sf, "typos", {"kind": "keyboard"}, relation=126)


@query("i23_typos_ocr", typo_oracle(128, OCR))
def i23b(spark, sf):
    return edited(spark, sf, "typos", {"kind": "ocr"}, relation=128)


@query(
    "i23_misspell",
    rf"""WITH {chosen_items(S.pieces('text'), seed_for(SEED), FULL, r"regexp_matches(w, '^[\p{L}\p{N}]')")},
    dict AS (SELECT DISTINCT v AS word, v[2] || v[1] || v[3:] AS misspelling
             FROM (SELECT unnest({S.words('lower(text)')}) AS v FROM benchmark)
             WHERE length(v) BETWEEN 3 AND 8 AND regexp_full_match(v, '\p{{L}}+'))
    SELECT row_id, string_agg(CASE WHEN chosen THEN coalesce(d.misspelling, w) ELSE w END, '' ORDER BY pos) AS text
    FROM pick LEFT JOIN dict d ON d.word = lower(w) GROUP BY row_id""",
)
def i23c(spark, sf):
    """The table of misspellings: every word of the benchmark with its first two letters the other way round."""
    two = F.concat(F.substring("word", 2, 1), F.substring("word", 1, 1), F.substring("word", 3, 8))
    dictionary = word_values(spark, sf).distinct().select("word", two.alias("misspelling"))
    return edited(spark, sf, "misspell", extra={"dictionary": dictionary})


# Replacement and removal by rule

RULES = S.with_keywords("SELECT doc_id AS row_id, text FROM documents", "text", "f")


@query(
    "i23_spelling_index",
    r"""
    WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents),
    counts AS (SELECT w, count(*) AS n FROM words WHERE length(w) BETWEEN 4 AND 40 GROUP BY w),
    near AS (SELECT a.w AS word, b.w AS misspelling, a.n AS n_word, b.n AS n_misspelling FROM counts a JOIN counts b
             ON a.n >= 50 AND b.n <= 2 AND abs(length(a.w) - length(b.w)) <= 1 AND CASE length(a.w) - length(b.w)
             WHEN 0 THEN len(list_filter(range(1, length(a.w) + 1), lambda i: substr(a.w, i, 1) <> substr(b.w, i, 1))) = 1
             WHEN 1 THEN list_contains(list_transform(range(1, length(a.w) + 1), lambda i: substr(a.w, 1, i - 1) || substr(a.w, i + 1)), b.w)
             ELSE list_contains(list_transform(range(1, length(b.w) + 1), lambda i: substr(b.w, 1, i - 1) || substr(b.w, i + 1)), a.w) END)
    SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n_misspelling DESC, misspelling) = 1
    """,
)
def i23_index(spark, sf):
    return spelling_index(table(spark, sf, "documents"))


def _first_words(joined: str) -> str:
    """Three overlapping phrases of a text's own first words, the longest first, as one pattern."""
    take = lambda *places: f"array_to_string([w[i] FOR i IN [{', '.join(map(str, places))}]], '{joined}')"
    return f"{take(2, 3, 4)} || '|' || {take(1, 2)} || '|' || {take(1)}"


def _phrase_sql(replacement: str) -> str:
    return f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
    told AS (SELECT doc_id, '  ' || array_to_string(w, '  ') || '  ' AS text, {_first_words('  ')} AS pattern FROM t WHERE len(w) >= 4)
    SELECT doc_id AS row_id, trim(regexp_replace(regexp_replace(text, ' (' || pattern || ') ', '{replacement}', 'g'), ' +', ' ', 'g')) AS text FROM told
    """


def _phrase_rows(spark, sf):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), w.alias("w")).where("size(w) >= 4")
    part = lambda *places: F.array_join(F.array(*[F.get("w", F.lit(i)) for i in places]), " ")
    return rows.select("row_id", F.array_join("w", " ").alias("text"), F.array(part(0), part(0, 1), part(1, 2, 3)).alias("phrases"))


def _single_spaced(text):
    return F.trim(F.regexp_replace(text, " +", " ")).alias("text")


@query("i31_replace_phrases", _phrase_sql(r" [\1] "))
def i31_phrases(spark, sf):
    """Each text by rules of its own, which overlap: phrases of one, two and three of its first words."""
    rows = _phrase_rows(spark, sf)
    marked = F.transform("phrases", lambda p: F.concat(F.lit("["), p, F.lit("]")))
    return rows.select("row_id", _single_spaced(replace_phrases(F.col("text"), F.col("phrases"), marked)))


@query("i44_remove_phrases", _phrase_sql(" "))
def i44_phrases(spark, sf):
    return _phrase_rows(spark, sf).select("row_id", _single_spaced(remove_phrases(F.col("text"), F.col("phrases"))))


@query(
    "i31_replace_words",
    f"""WITH d AS ({RULES})
    SELECT row_id, array_to_string(list_transform({S.pieces('text')},
      lambda p: CASE WHEN list_contains(f, lower(p)) THEN reverse(lower(p)) ELSE p END), '') AS text FROM d""",
)
def i31(spark, sf):
    """The longest words of a document turned round."""
    from driftline.functions.text import parse_keywords
    from driftline.operators.local_edits import replace_words

    from .doubles import _longest_tokens

    docs = documents(spark, sf).withColumn("f", parse_keywords(_longest_tokens(F.col("text"))))
    return docs.select("row_id", replace_words(F.col("text"), F.col("f"), F.transform("f", F.reverse)).alias("text"))


@query(
    "i44_remove_words",
    f"""WITH d AS ({RULES})
    SELECT row_id, array_to_string(list_filter({S.pieces('text')}, lambda p: NOT list_contains(f, lower(p))), '') AS text FROM d""",
)
def i44(spark, sf):
    from driftline.functions.text import parse_keywords
    from driftline.operators.local_edits import remove_words

    from .doubles import _longest_tokens

    docs = documents(spark, sf).withColumn("f", parse_keywords(_longest_tokens(F.col("text"))))
    return docs.select("row_id", remove_words(F.col("text"), F.col("f")).alias("text"))


# P5: splicing of changed inputs into variants


@query(
    "p5_transform_input",
    S.with_views(
        f"""SELECT row_id, variant, place, CASE WHEN list_contains(s[variant + 1], place) THEN {S.upper('l[place + 1]')} ELSE l[place + 1] END AS text
        FROM (SELECT row_id, [premise, hypothesis] AS l, [[0], [1], [0, 1]] AS s, unnest(range(3)) AS variant FROM nli_raw), range(2) t(place)""",
        "nli_raw",
    ),
)
def p5(spark, sf):
    rows = inference_rows(spark, sf)
    edit = Edit(relation=102, indices=((0,), (1,), (0, 1)), arity=2)
    return variant_texts(TRANSFORMS["upper"](rows, edit, {}))
