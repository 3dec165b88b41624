"""SQL fragments for the oracle: the same definitions, written a second time for another engine."""

from __future__ import annotations

from driftline.functions.draws import KEY_SHIFT, MODULUS, seed_for

WHITE = r"[\s\x0B\x1c-\x1f\x85\pZ]"
WORD = r"[\p{L}\p{N}]+|[^\s\x0B\x1c-\x1f\x85\pZ\p{L}\p{N}]"
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '{PUNCT}', ''), '{WHITE}+', ' ', 'g'))"


def number(x: str) -> str:
    return rf"TRY_CAST(NULLIF(regexp_extract({x}, '([0-9]+\.?[0-9]*)', 1), '') AS DOUBLE)"


def subset(a: str, b: str) -> str:
    return f"(contains({clean(a)}, {clean(b)}) OR contains({clean(b)}, {clean(a)}))"


def sents(x: str) -> str:
    stripped = f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"
    marked = rf"regexp_replace({stripped}, '([.!?]){WHITE}+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s_: s_ <> '')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, '{PIECE}')"


def toks(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda t_: t_ <> '')"


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def join(x: str, sep: str = " ") -> str:
    return f"array_to_string({x}, '{sep}')"


def first(row: str, pos: str, seed: int) -> str:
    return f"(({row})::BIGINT % {MODULUS} * 69621 + ({pos})::BIGINT * 48271 + {seed}) % {MODULUS}"


def mix(h: str) -> str:
    return f"((({h}) * ({h}) + 11) % {MODULUS} * 48271 + ({h})) % {MODULUS}"


def draw(row: str, pos: str, seed: int) -> str:
    return mix(first(row, pos, seed))


def keys(items: str, row: str, seed: int) -> str:
    """The list of sortable keys of a list's items."""
    return f"list_transform({items}, lambda x_, i_: ({draw(row, 'i_', seed)}) * {KEY_SHIFT} + i_ - 1)"


def shuffled(items: str, row: str, seed: int) -> str:
    pairs = f"list_transform({items}, lambda x_, i_: {{'k': ({draw(row, 'i_', seed)}) * {KEY_SHIFT} + i_ - 1, 'x': x_}})"
    return f"list_transform(list_sort({pairs}), lambda p_: p_.x)"


def keywords(x: str) -> str:
    parts = rf"list_transform(regexp_split_to_array({x}, '[,\n]+\s*'), lambda k_: {clean('k_')})"
    return f"list_filter({parts}, lambda k_: k_ <> '')"


# Oracle of the test doubles


def answer_question(context: str, question: str) -> str:
    asked = toks(question)
    scored = (
        f"list_transform({sents(context)}, lambda s, i: "
        f"{{'n': len(list_distinct(list_intersect({toks('s')}, {asked}))), 'i': -i, 's': s}})"
    )
    best = f"list_sort({scored}, 'DESC')[1]"
    return f"CASE WHEN {best}.n > 0 THEN {best}.s ELSE 'unknown' END"


def infer(premise: str, hypothesis: str) -> str:
    h = f"list_distinct({toks(hypothesis)})"
    shared = f"len(list_distinct(list_intersect({toks(premise)}, {h})))"
    return (
        f"CASE WHEN len({h}) = 0 THEN 'neutral' WHEN {shared} * 2 >= len({h}) THEN 'entailment' "
        f"WHEN {shared} * 10 < len({h}) THEN 'neutral' ELSE 'contradiction' END"
    )


def rate(x: str) -> str:
    a = f"length(regexp_replace(lower({x}), '[^a-m]', '', 'g'))"
    n = f"length(regexp_replace(lower({x}), '[^a-z]', '', 'g'))"
    return f"CASE WHEN {n} = 0 THEN 'n/a' ELSE '0.' || lpad(least(99, {a} * 100 // {n})::VARCHAR, 2, '0') END"


def relate(text: str, head: str, tail: str) -> str:
    c = clean(text)
    h, t = f"instr({c}, {clean(head)})", f"instr({c}, {clean(tail)})"
    return (
        f"CASE WHEN {h} = 0 OR {t} = 0 THEN 'no relation' "
        f"WHEN ({h} * 2 <= length({c})) = ({t} * 2 <= length({c})) THEN 'sibling' ELSE 'works for' END"
    )


def with_keywords(source: str, text: str, out: str = "kw") -> str:
    """``source`` (a SELECT) with the helper's keywords of ``text``: distinct longest tokens in their order.

    Every list is a column of its own subquery: inside a lambda it would be computed again per element.
    """
    return f"""SELECT * EXCLUDE (t_l, most_l, long_l), list_filter(long_l, lambda w_, i_: list_position(long_l, w_) = i_) AS {out}
        FROM (SELECT *, list_filter(t_l, lambda w_: length(w_) = most_l) AS long_l
        FROM (SELECT *, list_max(list_transform(t_l, lambda w_: length(w_))) AS most_l
        FROM (SELECT *, {toks(text)} AS t_l FROM ({source}))))"""


def yes_no(*inputs: str) -> str:
    return f"CASE WHEN length({clean('concat_ws(' + chr(39) + ' ' + chr(39) + ', ' + ', '.join(inputs) + ')')}) % 2 = 0 THEN 'true' ELSE 'false' END"


def echo(name: str, *inputs: str) -> str:
    return f"'{name}: ' || concat_ws(' | ', {', '.join(inputs)})"


def vector(x: str) -> str:
    codes = f"list_transform({toks(x)}, lambda t_: (unicode(t_) * 7 + length(t_)) % 16)"
    return f"list_transform(range(16), lambda b_: len(list_filter({codes}, lambda c_: c_ = b_))::DOUBLE)"


def cosine(a: str, b: str) -> str:
    def dot(u: str, v: str) -> str:
        return f"list_sum(list_transform(list_zip({u}, {v}), lambda z_: z_[1] * z_[2]))"

    return f"({dot(a, b)} / NULLIF(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0))"


# Oracle of the views

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT doc_id AS row_id, text FROM documents"),
    "qa_raw": (
        (),
        f"""SELECT u.conv_id * 1000 + u.turn AS row_id, a.text AS context, u.text AS question,
            CASE WHEN len({sents('l.text')}) > 0 THEN [{sents('l.text')}[1]] ELSE []::VARCHAR[] END AS answers
            FROM conversations u
            JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
            LEFT JOIN conversations l ON l.conv_id = u.conv_id AND l.turn = u.turn + 3 AND l.role = 'assistant'
            WHERE u.role = 'user'""",
    ),
    "nli_raw": (
        (),
        f"""SELECT row_id, array_to_string(s[1:len(s) - 1], ' ') AS premise, s[len(s)] AS hypothesis, label
            FROM (SELECT d.doc_id AS row_id, {sents('d.text')} AS s, l.quality AS label
                  FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE len(s) >= 2""",
    ),
    "sst_raw": (
        (),
        "SELECT d.doc_id AS row_id, d.text AS sentence, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)",
    ),
    "re_raw": (
        (),
        f"""SELECT row_id, source, sents, names,
            list_transform(range(1, len(names)), lambda i: {{'h': i - 1, 't': i, 'r': source}}) AS labels
            FROM (SELECT row_id, source, sents, list_transform(sents, lambda s:
                    list_sort(list_transform(s, lambda t, i: {{'n': length(t), 'i': -i, 't': t}}), 'DESC')[1].t) AS names
                  FROM (SELECT doc_id AS row_id, source,
                        list_transform({sents('text')}, lambda s: {words('s')}) AS sents FROM documents))""",
    ),
    "rel_names": (
        (),
        "SELECT DISTINCT source AS code, 'relation ' || source[4] AS name FROM documents WHERE length(source) = 4",
    ),
    "sent_pool": (
        (),
        f"""SELECT row_number() OVER (ORDER BY md5(v), v) - 1 AS idx, v AS value
            FROM (SELECT DISTINCT unnest({sents('text')}) AS v FROM benchmark) WHERE v <> ''""",
    ),
    "word_pool": (
        (),
        rf"""SELECT row_number() OVER (ORDER BY md5(v), v) - 1 AS idx, v AS value
            FROM (SELECT DISTINCT unnest({words('lower(text)')}) AS v FROM benchmark)
            WHERE length(v) BETWEEN 3 AND 8 AND regexp_full_match(v, '\p{{L}}+')""",
    ),
    "prime": (
        ("word_pool",),
        """SELECT n, (SELECT min(p) FROM range((SELECT count(*) FROM word_pool), 2 * (SELECT count(*) FROM word_pool) + 2) t(p)
            WHERE NOT EXISTS (SELECT 1 FROM range(2, 5000) d(d) WHERE d * d <= p AND p % d = 0)) AS p
            FROM (SELECT count(*) AS n FROM word_pool)""",
    ),
}


def sampled(view: str, size: int = 1000, seed: int = 42, where: str = "true") -> str:
    return f"SELECT * FROM {view} WHERE {where} ORDER BY {draw('row_id', '1', seed_for(seed))}, row_id LIMIT {size}"


def with_views(body: str, *names: str, **ctes: str) -> str:
    """``body`` behind the named views (with what they need) and further CTEs."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = VIEWS[name]
        for need in needs:
            add(need)
        parts.setdefault(name, sql)

    for name in names:
        add(name)
    parts.update(ctes)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts.items()) + "\n" + body


def letter_counts(text: str) -> str:
    """How often each of the letters a to z is in a text, as a list of doubles."""
    return f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length({text}) - length(replace({text}, c, '')))::DOUBLE)"
