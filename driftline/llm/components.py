"""Connected components of a graph given as an edge table, and joins on keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached; only nodes that have an edge.

    Alternates large-star and small-star steps: each node points itself and its neighbours to the smallest one it knows.
    The number of edges never grows, and rounds grow with the logarithm of the longest path. Every round is written, so
    neither lineage nor memory grows; what comes to the driver is a count and a checksum.
    """

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = staged(df.filter("u > v").distinct(), "edges")
        return df, tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now, sign = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while sign[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.filter("u > v")
        small = lower.join(lower.groupBy("u").agg(F.min("v").alias("m")), "u")
        after, new_sign = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))))
        if new_sign == sign:
            break
        now, sign = after, new_sign
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def look_up(rows: DataFrame, found: DataFrame, *key: str, run: str = "run") -> DataFrame:
    """rows LEFT JOIN found USING (key), for a key that a third of all rows may share; found has one row per key.

    `run` tells which of many runs of a written table a row belongs to. Each run asks once for each of its keys, and the
    answer then meets the rows of that run only, so that no task gets more rows of a key than a run has.
    """
    asked = rows.select(run, *key).distinct().join(found, [*key])
    return rows.join(asked, [run, *key], "left")
