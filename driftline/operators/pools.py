"""Pools of random words and sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import rows_of

# Up to this many entries a pool is read once and used as a constant of the plan; beyond it rows join it.
LITERAL_ENTRIES = 4096
LITERAL_CHARACTERS = 4_000_000


def indexed_pool(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with a dense index 0, 1, 2, ... in the order of their md5.

    The first three hex digits cut the values into 4,096 even buckets; only the 4,096 bucket counts
    pass through one ordered window, the values are numbered inside their bucket.
    """
    keyed = (
        values.select(F.col(column).alias("value"))
        .where("value IS NOT NULL AND value <> ''")
        .distinct()
        .withColumn("digest", F.md5("value"))
        .withColumn("bucket", F.substring("digest", 1, 3))
    )
    starts = (
        keyed.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .select(
            "bucket",
            (F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        )
    )
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "value"))
    return (
        keyed.withColumn("inside", inside)
        .join(starts, "bucket")
        .select((F.col("start") + F.col("inside") - 1).alias("idx"), "value")
    )


def next_prime(n: int) -> int:
    """The smallest prime that is at least n."""
    candidate = max(n, 2)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


_LITERALS: dict["Pool", Column] = {}


@dataclass(frozen=True, eq=False)
class Pool:
    """An indexed table (idx, value), its size, and its values as a constant when it is small."""

    table: DataFrame
    size: int
    constant: tuple[str, ...] | None

    @classmethod
    def of(cls, values: DataFrame, column: str, literal_entries: int = LITERAL_ENTRIES) -> "Pool":
        table = indexed_pool(values, column)
        few = table.limit(literal_entries + 1).collect()
        if not few:
            raise ValueError("a pool needs at least one value")
        if len(few) <= literal_entries and sum(len(r["value"]) for r in few) <= LITERAL_CHARACTERS:
            return cls(table, len(few), tuple(r["value"] for r in sorted(few)))
        return cls(table, table.count(), None)

    def fingerprint(self) -> str:
        """Tells pools with different values apart."""
        return str(tuple(self.table.agg(F.count("*"), F.bit_xor(F.xxhash64("idx", "value"))).first()))

    def values(self) -> Column:
        """The constant as an array column; built once, as it takes one literal per value."""
        if self not in _LITERALS:
            _LITERALS[self] = F.lit(list(self.constant))
        return _LITERALS[self]

    def pick(self, df: DataFrame, index: Column, out: str) -> DataFrame:
        """Add the value at ``index`` (a null index gives a null)."""
        if self.constant is not None:
            return df.withColumn(out, F.get(self.values(), index.cast("int")))
        taken = self.table.select(F.col("idx").alias("_idx"), F.col("value").alias(out))
        # Catalyst broadcasts the pool where its size allows; draws are even, so a shuffle has no hot key.
        return df.withColumn("_pick", index).join(taken, F.col("_pick") == F.col("_idx"), "left").drop("_pick", "_idx")

    def pick_many(self, df: DataFrame, indices: Column, out: str, key: str) -> DataFrame:
        """Add an array of values for an array of indices, in order. ``key`` names the row."""
        if self.constant is not None:
            values = self.values()
            return df.withColumn(out, F.transform(indices, lambda i: F.get(values, i.cast("int"))))
        taken = (
            df.select(key, rows_of(indices).alias("_pos", "_idx"))
            .where("_pos IS NOT NULL")
            .join(self.table.withColumnRenamed("idx", "_idx"), "_idx")
            .groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "value"))).alias("_taken"))
            .select(key, F.transform("_taken", lambda t: t["value"]).alias(out))
        )
        joined = df.join(taken, key, "left")
        return joined.withColumn(out, F.coalesce(F.col(out), F.lit([]).cast("array<string>")))
