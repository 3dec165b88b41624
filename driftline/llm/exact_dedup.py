"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes one run of (short digest, verification, best identifier, rows), sorted by the digest.
Runs then meet in rounds: `fan_in` neighbouring runs become one, entries of the same text are merged and keep the
best identifier, until one run, dealt over all tasks by digest, is left. A text that a third of all rows share has at
most one entry per run, so no task ever gets more than `fan_in` entries of it in a round.

Entries meet on a 64-bit digest and are merged only where the SHA-256 and the length in bytes agree as well: this
verification is repeated at every level, so a clash of short digests never merges two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, whole

TEXT = ("digest", "sha", "n_bytes")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Column | None = None,
    fan_in: int = 16,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    `keep` is "smallest" or "largest" identifier; `normalise` is the text to compare, the text itself if none is given.
    A null text counts as empty. A null identifier never stays if its group has another one; in a group of nulls alone
    keep_id is null and all rows are kept, as nothing tells them apart. Repeated rows of the kept identifier are all kept.
    Other columns of the input play no part. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}")
    best = F.min if keep == "smallest" else F.max
    text = whole(text_col if normalise is None else normalise)
    rows = staged(
        docs.select(F.col(id_col).alias("id"), text.alias("text"), F.spark_partition_id().cast("long").alias("run")).select(
            "id", "run", F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"),
            F.octet_length("text").alias("n_bytes"),
        ).sortWithinPartitions("digest"),
        "digest-runs",
    )
    first = staged(
        rows.groupBy("run", *TEXT).agg(best("id").alias("best"), F.count(F.lit(1)).alias("n")).sortWithinPartitions("run", "digest"),
        "digest-level",
    )
    runs, level, rounds = (first.agg(F.max("run")).first()[0] or 0) + 1, first, 0
    while runs > 1:
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
        level = level.groupBy("run", *TEXT).agg(best("best").alias("best"), F.sum("n").alias("n"))
        runs, rounds = -(-runs // fan_in), rounds + 1
    root = level.select(*TEXT, F.col("best").alias("keep_id"), F.col("n").alias("group_size"))
    # Back down the tree: a text has one entry per run of the first level, and a run's entry serves the rows of that run.
    entries = first.select("run", *TEXT).join(root, list(TEXT))
    return rows.join(entries, ["run", *TEXT]).select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
