"""Source rows that arrive as files: every micro-batch runs the tests and appends to the result log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.model_calls import Model
from ..plans.catalog import Test
from ..plans.run import Resources, run_resumable
from ..sources.commits import read_results

SOURCE_SCHEMA = "row_id bigint, inputs array<string>"


def run_arrivals(
    spark: SparkSession, input_path: str, results_path: str, checkpoint_path: str, model: Model, task: str,
    tests: list[Test], res: Resources, max_files: int | None = None,
) -> DataFrame:
    """Process all files not seen before and stop (``availableNow``); call it again for later ones.

    All steps are stateless, so no watermark or state store is needed. A micro-batch that is repeated after a crash is known
    by its number if its first try was committed; otherwise it reads only parts of the log whose range of rows meets its own.
    """
    reader = spark.readStream.schema(SOURCE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        run_resumable(batch, model, task, tests, res, results_path, f"arrivals:{input_path}", batch=batch_id)

    query = (
        reader.parquet(input_path)
        .writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return read_results(spark, results_path)
