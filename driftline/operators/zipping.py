"""Rows of two tables put together by their positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import work_folder


def numbered(df: DataFrame, *order, index: str = "idx") -> DataFrame:
    """Add a dense number from 0 in the given order, or in the order of the partitions where none is given.

    The rows are sorted over all partitions and written; each partition counts its own, and only the counts pass through one
    ordered window. Rows that are equal in the order are numbered in any order, but once and for all.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # The number of a row within its partition, and the partition, both of which the id holds.
    path = work_folder(df.sparkSession, "numbered")
    ordered.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the written table, as many as there were tasks.
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, place.alias(index))


def zip_rows(left: DataFrame, right: DataFrame, index: str = "idx") -> tuple[DataFrame, dict[str, int]]:
    """Numbered rows put together by number, as many as the shorter table has, and how many rows each table has."""
    sizes = {name: df.agg(F.coalesce(F.max(index) + 1, F.lit(0))).first()[0] for name, df in (("left", left), ("right", right))}
    return left.join(right, index), sizes
