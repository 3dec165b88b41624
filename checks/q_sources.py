"""Sources, sampling and sinks."""

from pyspark.sql import functions as F

from driftline.functions.draws import seed_for
from driftline.session import work_folder
from driftline.sources import files, sampling, tasks as T

from . import sqltext as S
from .q_edits import re_rows_sql
from .registry import query
from .views import (
    documents,
    inference_raw,
    question_raw,
    relation_names,
    relation_once,
    relation_raw,
    sentiment_raw,
    staged,
    table,
    text_rows,
)

SEED = 42


def stored(spark, sf):
    """The raw relation data as a stored data set: its labels are a column, so a filter on them costs nothing more."""
    return staged(spark, relation_raw(spark, sf))


IN_FILE = 100


def as_json_files(spark, rows, name):
    """Files that each hold one JSON array with the texts of IN_FILE consecutive rows."""
    file = F.floor(F.col("row_id") / IN_FILE)
    arrays = rows.groupBy(file.alias("file")).agg(F.sort_array(F.collect_list(F.struct("row_id", "text"))).alias("rows"))
    path = work_folder(spark, name)
    lines = arrays.select(F.to_json(F.transform("rows", lambda r: r["text"])).alias("value"))
    lines.write.option("maxRecordsPerFile", 1).text(path)
    return path


def placed(inputs):
    """(file number, place in the file, text) of what was read."""
    return inputs.select(
        F.shiftright("row_id", 32).alias("file"), F.col("row_id").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), F.get("inputs", F.lit(0)).alias("text")
    )


@query("s1_read_inputs", f"SELECT doc_id % {IN_FILE} AS pos, text FROM documents")
def s1(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return placed(files.read_inputs(spark, as_json_files(spark, rows, "inputs"))).select("pos", "text")


@query("s1_read_input_lines", "SELECT 0::BIGINT AS pos, text FROM documents")
def s1_lines(spark, sf):
    path = work_folder(spark, "inputs")
    files.write_input_lines(text_rows(spark, sf), path)
    rows = files.read_input_lines(spark, path)
    return rows.select(F.col("pos").cast("bigint").alias("pos"), F.get("inputs", F.lit(0)).alias("text"))


SPLITS_SQL = """SELECT doc_id * 2 AS row_id, text FROM documents
    UNION ALL SELECT (conv_id * 1000 + turn) * 2 + 1 AS row_id, text FROM conversations"""


def both_splits(spark, sf):
    first = table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("row_id"), "text")
    turns = table(spark, sf, "conversations")
    second = turns.select(((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("row_id"), "text")
    return sampling.union_splits(first, second)


@query("s2_union_sample", S.with_views(S.sampled("splits"), splits=SPLITS_SQL))
def s2(spark, sf):
    return sampling.seeded_sample(both_splits(spark, sf), "row_id", size=sampling.SAMPLE_SIZE)


@query("s2_large_sample", S.with_views(S.sampled("splits", size=1400), splits=SPLITS_SQL))
def s2_large(spark, sf):
    return sampling.seeded_sample(both_splits(spark, sf), "row_id", size=1400)


@query("s2_keep_all", SPLITS_SQL)
def s2_all(spark, sf):
    return sampling.seeded_sample(both_splits(spark, sf), "row_id", size=None)


@query("s3_head_rows", "SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 100")
def s3(spark, sf):
    return sampling.head_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")


def two(df, *more):
    return df.select("row_id", F.get("inputs", F.lit(0)).alias("a"), F.get("inputs", F.lit(1)).alias("b"), *more)


@query("s4_question_answering", S.with_views(f"SELECT row_id, context AS a, question AS b FROM qa_raw", "qa_raw"))
def s4(spark, sf):
    return two(T.question_answering(question_raw(spark, sf)))


@query(
    "s5_question_answering_labelled",
    S.with_views(
        f"SELECT row_id, context AS a, question AS b, coalesce(answers[1], 'unknown') AS label FROM qa_raw", "qa_raw"
    ),
)
def s5(spark, sf):
    return two(T.question_answering_labelled(question_raw(spark, sf)), "label")


@query("s6_inference", S.with_views(f"SELECT row_id, premise AS a, hypothesis AS b FROM nli_raw", "nli_raw"))
def s6(spark, sf):
    return two(T.inference(inference_raw(spark, sf)))


@query(
    "s7_inference_labelled",
    S.with_views(f"SELECT row_id, premise AS a, hypothesis AS b, label::VARCHAR AS label FROM nli_raw", "nli_raw"),
)
def s7(spark, sf):
    return two(T.inference_labelled(inference_raw(spark, sf)), "label")


@query("s8_sentiment", S.with_views(f"SELECT row_id, sentence AS a FROM sst_raw", "sst_raw"))
def s8(spark, sf):
    return T.sentiment(sentiment_raw(spark, sf)).select("row_id", F.get("inputs", F.lit(0)).alias("a"))


@query(
    "s9_sentiment_labelled",
    S.with_views(f"SELECT row_id, sentence AS a, label::VARCHAR AS label FROM sst_raw", "sst_raw"),
)
def s9(spark, sf):
    return T.sentiment_labelled(sentiment_raw(spark, sf)).select("row_id", F.get("inputs", F.lit(0)).alias("a"), "label")


JOINED = "array_to_string(flatten(sents), ' ')"
CLEANED = rf"regexp_replace({JOINED}, '\s+([,.!?;:])', '\1', 'g')"


@query("s10_list_to_string", S.with_views(f"SELECT row_id, {JOINED} AS text FROM re_raw", "re_raw"))
def s10(spark, sf):
    return relation_raw(spark, sf).select("row_id", T.join_tokens(F.col("sents")).alias("text"))


@query("s11_list_to_string_cleaned", S.with_views(f"SELECT row_id, {CLEANED} AS text FROM re_raw", "re_raw"))
def s11(spark, sf):
    return relation_raw(spark, sf).select("row_id", T.join_tokens_cleaned(F.col("sents")).alias("text"))


@query(
    "s12_all_names",
    S.with_views(
        f"SELECT row_id, pos, name FROM (SELECT row_id, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos FROM "
        f"(SELECT row_id, flatten(list_transform(names, lambda v: [v, {S.upper('v')}])) AS l FROM re_raw))",
        "re_raw",
    ),
)
def s12(spark, sf):
    rows = relation_raw(spark, sf).select("row_id", F.posexplode(T.all_names(F.col("vertexSet"))).alias("pos", "name"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("s13_first_names", S.with_views("SELECT row_id, array_to_string(names, chr(10)) AS names FROM re_raw", "re_raw"))
def s13(spark, sf):
    return relation_raw(spark, sf).select("row_id", F.array_join(T.first_names(F.col("vertexSet")), "\n").alias("names"))


PAIR = S.shuffled("names", "row_id", seed_for(SEED, salt=1))


@query(
    "s14_random_pair",
    S.with_views(
        f"SELECT row_id, CASE WHEN len(names) >= 2 THEN p[1] END AS first, CASE WHEN len(names) >= 2 THEN p[2] END AS second "
        f"FROM (SELECT row_id, names, {PAIR} AS p FROM re_raw)",
        "re_raw",
    ),
)
def s14(spark, sf):
    pair = T.random_pair(T.first_names(F.col("vertexSet")), F.col("row_id"), seed_for(SEED, salt=1))
    drawn = relation_raw(spark, sf).select("row_id", pair.alias("p"))
    return drawn.select("row_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


def three(df, *more):
    return df.select(
        "row_id", *[F.get("inputs", F.lit(i)).alias(n) for i, n in enumerate(("text", "head", "tail"))], *more
    )


@query(
    "s15_entity_pairs",
    S.with_views(
        f"SELECT row_id, {CLEANED} AS text, CASE WHEN len(names) >= 2 THEN p[1] END AS head, CASE WHEN len(names) >= 2 THEN p[2] END AS tail "
        f"FROM (SELECT row_id, sents, names, {PAIR} AS p FROM ({S.sampled('re_raw')}))",
        "re_raw",
    ),
)
def s15(spark, sf):
    return three(T.entity_pairs(relation_raw(spark, sf), size=sampling.SAMPLE_SIZE))


@query(
    "s16_random_names",
    S.with_views(
        f"SELECT row_id, array_to_string(list_transform(names, lambda v, i: CASE WHEN "
        f"{S.draw('row_id', 'i', seed_for(SEED, salt=2))} % 2 = 0 THEN v ELSE {S.upper('v')} END), chr(10)) AS names FROM re_raw",
        "re_raw",
    ),
)
def s16(spark, sf):
    names = T.random_names(F.col("vertexSet"), F.col("row_id"), seed_for(SEED, salt=2))
    return relation_raw(spark, sf).select("row_id", F.array_join(names, "\n").alias("names"))


@query("s17_random_relation", S.with_views("SELECT row_id, text, head, tail FROM re_rows", "re_raw", re_rows=re_rows_sql()))
def s17(spark, sf):
    return three(T.relation_extraction(relation_once(spark, sf), size=None))


@query(
    "s18_files_in_order",
    f"""SELECT 0 AS argument, page_id % {IN_FILE} AS pos, url AS text FROM pages
    UNION ALL SELECT 1, doc_id % {IN_FILE}, text FROM documents""",
)
def s18(spark, sf):
    """Files are numbered in the order of the arguments, whatever their names; rows by their place in the file."""
    first = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("text"))
    second = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    paths = [as_json_files(spark, second, "a"), as_json_files(spark, first, "z")][::-1]
    n_first = len(spark.read.text(paths[0]).inputFiles())
    rows = placed(files.read_inputs(spark, *paths))
    return rows.select((F.col("file") >= n_first).cast("int").alias("argument"), "pos", "text")


@query("s18_json_files", SPLITS_SQL)
def s18_json(spark, sf):
    paths = []
    docs = table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("row_id"), "text")
    turns = table(spark, sf, "conversations").select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 2 + 1).alias("row_id"), "text"
    )
    for part in (docs, turns):
        paths.append(work_folder(spark, "json"))
        files.write_json(part, paths[-1])
    return files.read_json(spark, "row_id bigint, text string", *paths)


@query("s19_seeded_sample", S.with_views(S.sampled("turns"), turns="SELECT o_orderkey AS row_id, o_orderpriority AS priority FROM orders"))
def s19(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"))
    return sampling.seeded_sample(orders, "row_id", size=sampling.SAMPLE_SIZE)


SAMPLED_RE = S.with_views(
    f"SELECT row_id, text, head, tail FROM ({S.sampled('re_rows')})", "re_raw", re_rows=re_rows_sql()
)


@query("s20_relation_extraction", SAMPLED_RE)
def s20(spark, sf):
    return three(T.relation_extraction(stored(spark, sf), size=sampling.SAMPLE_SIZE))


def labelled_sql(view: str) -> str:
    return S.with_views(
        f"SELECT row_id, text, head, tail, n.name AS label FROM ({view}) r LEFT JOIN rel_names n ON n.code = r.code",
        "re_raw",
        "rel_names",
        re_rows=re_rows_sql(),
    )


@query("s21_relation_with_label", labelled_sql("SELECT * FROM re_rows"))
def s21(spark, sf):
    return three(T.relation_extraction_labelled(relation_once(spark, sf), relation_names(spark, sf), size=None), "label")


@query("s22_relation_extraction_labelled", labelled_sql(S.sampled("re_rows")))
def s22(spark, sf):
    return three(T.relation_extraction_labelled(stored(spark, sf), relation_names(spark, sf), size=sampling.SAMPLE_SIZE), "label")


@query(
    "s23_export_labelled",
    S.with_views(
        """SELECT dataset, row_id, label, array_to_string(inputs, chr(10)) AS inputs FROM (
        SELECT 'inference' AS dataset, row_id, label::VARCHAR AS label, [premise, hypothesis] AS inputs FROM nli_raw
        UNION ALL SELECT 'question_answering', row_id, coalesce(answers[1], 'unknown'), [context, question] FROM qa_raw
        UNION ALL SELECT 'sentiment', row_id, label::VARCHAR, [sentence] FROM sst_raw
        UNION ALL SELECT 'relation_extraction', row_id, n.name, [text, head, tail] FROM re_rows r LEFT JOIN rel_names n ON n.code = r.code)""",
        "nli_raw", "qa_raw", "sst_raw", "re_raw", "rel_names",
        re_rows=re_rows_sql(),
    ),
)
def s23(spark, sf):
    path = work_folder(spark, "labelled")
    sets = {
        "inference": T.inference_labelled(inference_raw(spark, sf), size=None),
        "question_answering": T.question_answering_labelled(question_raw(spark, sf), size=None),
        "sentiment": T.sentiment_labelled(sentiment_raw(spark, sf), size=None),
        # Far smaller than what it is made from, so it is written for both exports.
        "relation_extraction": staged(spark, T.relation_extraction_labelled(relation_once(spark, sf), relation_names(spark, sf), size=None)),
    }
    for _ in range(2):  # the second export replaces the first
        files.export_labelled(sets, path)
    back = spark.read.parquet(path)
    return back.select("dataset", "row_id", "label", F.array_join("inputs", "\n").alias("inputs"))


@query("s24_json_round_trip", "SELECT page_id AS row_id, url, html FROM pages")
def s24(spark, sf):
    path = work_folder(spark, "json")
    files.write_json(table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url", "html"), path)
    return files.read_json(spark, "row_id bigint, url string, html string", path)


@query("s25_csv_round_trip", "SELECT text, role, conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn FROM conversations")
def s25(spark, sf):
    path = work_folder(spark, "csv")
    files.write_csv(table(spark, sf, "conversations"), path, ["turn", "conv_id", "text", "role"])
    return files.read_csv(spark, path)


@query("s26_input_cache", S.with_views(f"SELECT row_id, context AS a, question AS b FROM qa_raw", "qa_raw"))
def s26(spark, sf):
    path = work_folder(spark, "source_inputs")

    def compute():
        return T.question_answering(question_raw(spark, sf))

    files.cached_inputs(spark, path, compute)

    def not_again():
        raise AssertionError("the stage table exists")

    return two(files.cached_inputs(spark, path, not_again))
