"""Task data derived from the given tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.functions.draws import let
from driftline.functions.text import rows_of, sentences, words
from driftline.operators.pools import Pool
from driftline.session import work_folder
from driftline.sources import tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """A parquet file of a few megabytes is one split, that is one task, while work per row is heavy here. A scan
    with fewer splits than the cluster has cores is spread first; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("row_id"), "text"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("row_id", F.array("text").alias("inputs"))


def question_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn, the assistant turn after it as context, and the start of the one after the next user turn."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    context = answers.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    later = answers.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("later"))
    joined = asked.join(context, ["conv_id", "turn"]).join(later, ["conv_id", "turn"], "left")
    first = F.get(sentences(F.col("later")), F.lit(0))
    texts = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first))
    return joined.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "context", "question", F.struct(texts.alias("text")).alias("answers")
    )


def inference_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sentence of a document as hypothesis, everything before it as premise."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = docs.select(F.col("doc_id").alias("row_id"), "text", F.col("quality").alias("label")).select(
        "row_id", "label", sentences(F.col("text")).alias("s")
    )
    return split.where(F.size("s") >= 2).select(
        "row_id",
        F.array_join(F.slice("s", 1, F.size("s") - 1), " ").alias("premise"),
        F.get("s", F.size("s") - 1).alias("hypothesis"),
        "label",
    )


def sentiment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"), F.col("quality").alias("label"))


def relation_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as token lists; one entity per sentence, its longest token, as written and in capitals; a
    relation from each entity to the next, its code the document's source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "source")

    def longest(sentence):
        # Numbers are compared by compiled code, and no struct is made for a token; the first of the longest counts.
        return let(F.transform(sentence, F.length), lambda n: F.get(sentence, (F.array_position(n, F.array_max(n)) - 1).cast("int")))

    def mentions(name):
        return F.array(F.struct(name.alias("name")), F.struct(F.upper(name).alias("name")))

    tokenised = spread(docs).select("row_id", "source", F.transform(sentences(F.col("text")), words).alias("sents"))
    entities = tokenised.withColumn("vertexSet", F.transform("sents", lambda s: let(longest(s), mentions)))
    pairs = F.transform(
        F.slice("vertexSet", 2, F.greatest(F.size("vertexSet") - 1, F.lit(0))),
        lambda v, i: F.struct(i.alias("h"), (i + 1).alias("t"), F.col("source").alias("r")),
    )
    return entities.select("row_id", "sents", "vertexSet", pairs.alias("labels"))


def relation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the codes of one digit only, so that some codes have none."""
    codes = table(spark, sf_dir, "documents").select(F.col("source").alias("code")).distinct()
    return codes.where(F.length("code") == 4).select("code", F.concat(F.lit("relation "), F.substring("code", 4, 1)).alias("name"))


def sentence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(sentences(F.col("text"))).alias("sentence"))


def word_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "benchmark").select(F.explode(words(F.lower("text"))).alias("word"))
    return split.where(F.length("word").between(3, 8) & F.col("word").rlike(r"^\p{L}+$"))


def sentence_pool(spark: SparkSession, sf_dir: str) -> Pool:
    return Pool.of(sentence_values(spark, sf_dir), "sentence")


def word_pool(spark: SparkSession, sf_dir: str) -> Pool:
    return Pool.of(word_values(spark, sf_dir), "word")


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows. A filter on the columns stays above them, while it would else work out a second time, at the scan, what
    they are computed from: conditions on what a generator makes are not pushed below it."""
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, rows_of(F.array(F.struct(*columns))).alias("_pos", "_made"))
    return made.select(*[F.col(c) if c in kept else F.col("_made")[c].alias(c) for c in df.columns])


def relation_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relation_raw`` for one pass: not written, as what it is made to is a fraction of its tokens and entities."""
    return computed_once(relation_raw(spark, sf_dir), "sents", "vertexSet", "labels")


def staged(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Source inputs as a run keeps them: written once, then read by every transformation.

    Expressions that derive inputs from raw data are costly and would be inlined wherever an input is used.
    """
    path = work_folder(spark, "source_inputs")
    df.write.option("compression", "zstd").parquet(path)
    return spread(spark.read.parquet(path))


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, tasks.question_answering(question_raw(spark, sf_dir), size=None))


def inference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, tasks.inference(inference_raw(spark, sf_dir), size=None))


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, tasks.relation_extraction(relation_once(spark, sf_dir), size=None))
