"""Dense count vectors of many tasks, summed in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

PARTS = "key string, run long, counts binary"


def count_parts(df: DataFrame, counter: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> DataFrame:
    """(key, run, counts): what `counter` makes of each partition; counts are little-endian 64-bit integers."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for key, counts in counter(batches).items():
            yield pa.RecordBatch.from_pydict({"key": [key], "run": [run], "counts": [counts.astype("<i8").tobytes()]})

    return df.mapInArrow(parts, PARTS)


def blocks(counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """A long vector in blocks, without those that hold zeros only."""
    return {str(i // size): part for i in range(0, len(counts), size) if (part := counts[i : i + size]).any()}


def tree_sum(parts: DataFrame, runs: int, fan_in: int = 16) -> DataFrame:
    """(key, counts) of (key, run, counts): the vectors of each key, summed `fan_in` runs at a time until one is left.

    No task holds more than `fan_in` vectors of a key, however many runs there are. `runs` is a bound on the runs' numbers.
    """

    def add(rows: pa.Table) -> pa.Table:
        column = rows.column("counts").to_pylist()
        total = np.sum([np.frombuffer(c, "<i8") for c in column], axis=0)
        return pa.table({"key": rows.column("key")[:1], "run": rows.column("run")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    while True:
        parts = parts.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("key", "run").applyInArrow(add, PARTS)
        runs = -(-runs // fan_in)
        if runs <= 1:
            return parts.select("key", "counts")
