"""Look-ups for keys that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Portions in which the rows of a key ask for its entry.
PORTIONS = 128


def join_in_portions(rows: DataFrame, entries: DataFrame, key: str, *row: str) -> DataFrame:
    """rows LEFT JOIN entries USING (key); ``entries`` has one row per key, and ``row`` are columns that tell rows apart.

    The rows of a key are dealt over PORTIONS portions. Each portion asks for its key once, so no task gets more than a
    portion of a frequent key's rows, whatever their number; rows without a key are dealt as well.
    """
    dealt = rows.withColumn("_portion", F.pmod(F.xxhash64(*row), F.lit(PORTIONS)))
    asked = dealt.where(F.col(key).isNotNull()).select(key, "_portion").distinct().join(entries, key)
    return dealt.join(asked, [key, "_portion"], "left").drop("_portion")
