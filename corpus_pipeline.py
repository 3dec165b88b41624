"""From raw documents to packed training sequences: quality, repeated lines, near copies, secrets, packing.

Every stage works on all that the one before it kept. All but the last return the columns of `documents`; where a stage
changes texts, `n_chars` follows. Between stages the rows are written to the cluster's shared folder and read again.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm import line_dedup, ngram_join, packing, quality, secret_scan
from driftline.llm.common import staged, whole
from driftline.session import ship_packages

#: A document whose chance of being good is lower goes.
LEAST_QUALITY = 0.3


def stage(fn):
    """A stage that works wherever it is called: the executors get the package first."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_packages(spark, "driftline")
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the line field takes for good. It learns from four of five labelled documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out())
    model = quality.train_quality(docs, labels)
    return docs.withColumn("__score", quality.quality_score(model)).filter(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that are like an earlier one, however short they are. A document goes only if it had text and no line of it is left."""
    cut = line_dedup.line_dedup(docs, removed="__removed").filter((F.col("__removed") == 0) | (F.trim(F.col("text")) != ""))
    return _with_length(cut, docs)


@stage
def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, the one with the smallest identifier, null first.

    Of rows with one identifier, the one whose text has the smallest SHA-256 counts as smaller; a null text counts as
    empty. Of rows equal in both, the smallest stays in the order of the input's columns.
    """
    named = docs.withColumn("__id", F.struct("doc_id", F.sha2(whole("text"), 256).alias("sha")))
    kept = ngram_join.ngram_join(named.select("__id", "text"), id_col="__id").filter("kept").select("__id").distinct()
    rows, chosen = named.withColumn("__key", F.xxhash64("__id")).alias("d"), kept.withColumn("__key", F.xxhash64("__id")).alias("k").hint("merge")
    same = (F.col("d.__key") == F.col("k.__key")) & F.col("d.__id.doc_id").eqNullSafe(F.col("k.__id.doc_id")) & (F.col("d.__id.sha") == F.col("k.__id.sha"))
    left = rows.join(chosen, same, "left_semi")
    return left.groupBy("__id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


@stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret; no document goes."""
    model = secret_scan.train_markov(secret_scan.labelled_by_patterns(docs))
    scanned = secret_scan.scan_secrets(docs, model, base="__base", spans="__spans")
    masked = F.when(F.col("text").isNotNull(), secret_scan.redact(F.col("text"), F.col("__spans")))
    return _with_length(scanned.withColumn("text", masked), docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all documents in as few sequences as possible; one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _with_length(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length(whole("text")).cast("long")).select(*docs.columns)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: A trained field decides in the first stage, which SQL can't express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = staged(docs, f"stage-{place + 1}")
    return docs
