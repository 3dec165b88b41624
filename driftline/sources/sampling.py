"""Seeded sampling that does not depend on partitions or row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import KEY_SHIFT, draw, seed_for

#: The size that a run's options name; no reader samples unless it is told to.
SAMPLE_SIZE = 1000
HISTOGRAM_BITS = 16


def union_splits(*splits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, splits)


def head_rows(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    return df.orderBy(key).limit(n)


def sample_draw(key: Column, seed: int) -> Column:
    return draw(key, F.lit(1), seed_for(seed))


def seeded_sample(df: DataFrame, key: str, size: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``min(size, n)`` rows, the ones with the smallest draws; ``None`` keeps all.

    ``key`` is a distinct number per row. Only keys and draws are looked at: they are counted by the upper bits of the
    draw, whole bins below the cut are taken, and the one bin at the cut is ranked. The rows then meet the chosen keys.
    """
    if size is None:
        return df
    shift = KEY_SHIFT.bit_length() - 1 - HISTOGRAM_BITS
    drawn = df.select(F.col(key).alias("_key"), sample_draw(F.col(key), seed).alias("_draw"))
    drawn = drawn.withColumn("_bin", F.shiftright("_draw", shift))
    before = F.sum("n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # At most 2^16 bins pass through the ordered window and the broadcast.
    bins = (
        drawn.groupBy("_bin")
        .agg(F.count("*").alias("n"))
        .withColumn("_before", before)
        .where(F.col("_before") < size)
        .withColumn("_whole", F.col("_before") + F.col("n") <= size)
        .select("_bin", "_before", "_whole")
    )
    marked = drawn.join(F.broadcast(bins), "_bin")
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_draw", "_key"))
    at_cut = marked.where(~F.col("_whole")).withColumn("_rank", rank).where(F.col("_before") + F.col("_rank") <= size)
    chosen = marked.where("_whole").select("_key").unionByName(at_cut.select("_key"))
    return df.join(chosen, F.col(key) == F.col("_key"), "left_semi")
