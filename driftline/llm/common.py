"""What several operators share: stage tables, document keys, broadcast vocabularies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftline.operators.batches import slices  # noqa: F401
from driftline.session import StageTable, work_folder  # noqa: F401


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the cluster's shared folder and read it back: lineage ends here, on all executors."""
    folder = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    # What was shuffled for this table goes when the driver next collects its garbage, which may be long in coming.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i] : starts[i] + lengths[i]] behind each other."""
    if not len(lengths):
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
