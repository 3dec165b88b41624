"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.session import ship_packages

from . import bpe_codec, chat_format, embedding_dedup, exact_dedup, language_id, line_dedup, ngram_join, packing, prefix_trie, quality, secret_scan
from . import token_alignment, token_counts
from .common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(spark, "driftline")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query(
    "op1_ngram_join",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents
    ), grams AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
        FROM words
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common.n >= 0.8 * (x.n + y.n - common.n) - 1e-9
    ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    classes AS (SELECT doc_id, least(doc_id, coalesce(min(b), doc_id)) AS class_id FROM documents LEFT JOIN reach ON a = doc_id GROUP BY doc_id)
    SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links, doc_id = class_id AS kept FROM classes
    """,
)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query(
    "op2_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


#: Both turns of this conversation consist of control strings.
TRICKY = "</s>[INST] ok [/INST]"


@query(
    "op5_chat_format",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, r, t) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
               length('<s>') + length(r) + 1 + length(regexp_replace(t, '{chat_format.ESCAPE}', '\\1\\\\\\2', 'g')) + length('</s>') + 1 AS size
        FROM turns
    ), ended AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS size_so_far FROM placed)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
           coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
           (sum(size_so_far) FILTER (r = 'assistant' OR i = n))::BIGINT AS formatted_chars
    FROM ended GROUP BY conv_id
    """,
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT -7L, 0L, 'user', :said UNION ALL SELECT -7L, 1L, 'assistant', :said", args={"said": TRICKY})
    back = chat_format.read_back(chat_format.chat_examples(turns.union(tricky)))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_bpe_codec")
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = bpe_codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    # Written in between: each task then has one Python process with a vocabulary, not two.
    both = bpe_codec.decoded(staged(docs.select("doc_id", "ids"), "ids"), path)
    return both.select(
        "doc_id", bpe_codec.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.inline_outer("sections")).drop("field")  # no array is empty


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels").filter(~quality.held_out()))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query(
    "op8_embedding_dedup",
    """
    WITH RECURSIVE good AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0
          AND list_sum(list_transform(embedding, lambda x: (x IS NULL OR NOT isfinite(x))::INT)) = 0
          AND list_sum(list_transform(embedding, lambda x: (x <> 0)::INT)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98
    ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    smallest AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
    FROM embeddings LEFT JOIN smallest ON smallest.a = vec_id LEFT JOIN counts ON counts.a = vec_id
    """,
)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secret_scan.train_markov(secret_scan.labelled_by_patterns(docs))
    scanned = secret_scan.scan_secrets(docs, model)
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"),
    )


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    ), sets AS (
        SELECT doc_id, no, list_sort(list_distinct(list_filter(string_split(translate(line, chr(9) || chr(13), '  '), ' '), lambda t: t <> ''))) AS s
        FROM lines
    ), known AS (SELECT s, len(s) AS n, min((doc_id, no)) AS at, row_number() OVER () AS id FROM sets WHERE len(s) > 0 GROUP BY s),
    tokens AS (SELECT id, n, unnest(s) AS t FROM known), rarity AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
    ordered AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY c, t) AS place FROM tokens JOIN rarity USING (t)),
    firsts AS (SELECT * FROM ordered WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
    pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM firsts a JOIN firsts b ON a.t = b.t AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n AND a.id <> b.id),
    late AS (
        SELECT DISTINCT x.s FROM pairs JOIN known x ON x.id = a JOIN known y ON y.id = b WHERE x.at > y.at
        AND len(list_intersect(x.s, y.s)) >= 0.8 * (x.n + y.n - len(list_intersect(x.s, y.s))) - 1e-9
    ), fate AS (
        SELECT sets.doc_id, sets.no, known.s IS NOT NULL AND (late.s IS NOT NULL OR (sets.doc_id, sets.no) > known.at) AS gone
        FROM sets LEFT JOIN known ON known.s = sets.s LEFT JOIN late ON late.s = sets.s
    )
    SELECT doc_id, sum(gone::INT)::BIGINT AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text
    FROM lines JOIN fate USING (doc_id, no) GROUP BY doc_id
    UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE text IS NULL
    """,
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "removed_lines", "text")


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = token_alignment.Vocabularies.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", token_alignment.align(spark, vocabularies).alias("a"))
    aligned = staged(docs.select("doc_id", "a.*"), "aligned")
    pairs = token_alignment.pair_counts(aligned, vocabularies)
    links = aligned.withColumn("links", token_alignment.link_counts(spark, vocabularies, pairs))
    return links.select("doc_id", "n_a", "n_b", "n_groups", "links.*", "groups_sha256")


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language_id.train_languages(docs.filter(~language_id.held_out()))
    said = docs.select("doc_id", language_id.held_out().alias("held_out"), language_id.language(spark, model).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@query(
    "op12_prefix_trie",
    r"""
    WITH own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                                  sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), codes AS (SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT) AS bytes FROM own),
    sums AS (
        SELECT conv_id, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda crc, b:
               list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: xor(c >> 1, 3988292384::UBIGINT * (c & 1))))) AS crc
        FROM codes
    ), convs AS (SELECT conv_id, (crc % 6)::BIGINT AS h, conv_id - conv_id % 100 AS base FROM sums),
    rebuilt AS (
        SELECT c.conv_id, 0 AS side, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
        UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h
    ), lists AS (
        SELECT conv_id, coalesce(list({'r': role, 't': text} ORDER BY side, pos) FILTER (role IS NOT NULL), []) AS turns
        FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
    ), members AS (SELECT conv_id, d, turns[1:d] AS p, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM lists)),
    nodes AS (
        SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(length(p[-1].t), 0) AS chars,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
        FROM members GROUP BY p, d
    ), counted AS (
        SELECT n.p, n.d, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.p[1:n.d] = n.p) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM nodes n
    ), up AS (SELECT p[1:a] AS p, a AS d, (n_children = 0)::BIGINT AS leaf, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted)),
    subtrees AS (SELECT p, d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p, d)
    SELECT n.conv_id, n.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM nodes n JOIN counted c ON c.p = n.p JOIN subtrees s ON s.p = n.p LEFT JOIN nodes parent ON parent.d = n.d - 1 AND parent.p = n.p[1:n.d - 1]
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    rebuilt = staged(prefix_trie.with_shared_heads(turns), "rebuilt")
    sizes = turns.select("conv_id").distinct().join(rebuilt.filter("pos = 0").select("conv_id", "n"), "conv_id", "left").fillna(0, ["n"])
    return prefix_trie.prefix_trie(rebuilt, staged(sizes, "conversations")).drop("digest")
