"""JSON, CSV and stage files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

INPUT_ROWS = "array<array<string>>"


def _parse_inputs(text):
    """A JSON array of rows; a row is an array of texts or one bare text."""
    as_rows = F.from_json(text, INPUT_ROWS)
    as_texts = F.transform(F.from_json(text, "array<string>"), lambda t: F.array(t))
    return F.when(F.get(F.from_json(text, "array<string>"), F.lit(0)).rlike(r"\A\s*\["), as_rows).otherwise(as_texts)


def read_inputs(spark: SparkSession, *paths: str) -> DataFrame:
    """Files that each hold one JSON array of inputs: (row_id, inputs), in the order of the
    arguments, of the file names within one, and of the array.

    A JSON array cannot be split, so one file is one task's work: large data belongs in many files,
    in lines (``read_input_lines``) or in parquet. ``row_id`` leaves room for 2^32 rows per file.
    """
    in_order = [file for path in paths for file in sorted(spark.read.text(path, wholetext=True).inputFiles())]
    files = spark.createDataFrame(list(enumerate(dict.fromkeys(in_order))), "file_no bigint, file string")
    rows = spark.read.text(list(paths), wholetext=True).withColumn("file", F.input_file_name()).join(files, "file")
    parsed = rows.select("file_no", F.posexplode(_parse_inputs(F.col("value"))).alias("pos", "inputs"))
    return parsed.select((F.shiftleft("file_no", 32) + F.col("pos")).alias("row_id"), "inputs")


def read_input_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Files in which every line is a JSON array of inputs; splittable. Gives ``inputs`` and the place in the line."""
    lines = spark.read.text(list(paths))
    return lines.select(F.posexplode(_parse_inputs(F.col("value"))).alias("pos", "inputs"))


def write_input_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.array("inputs")).alias("value")).write.text(path)


def read_json(spark: SparkSession, schema, *paths: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(list(paths), multiLine=multi_line)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """A header and text columns only, as written by ``write_csv``."""
    return spark.read.csv(
        list(paths), header=True, inferSchema=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, nullValue="\u0000", emptyValue="",
    )


def write_csv(df: DataFrame, path: str, fieldnames: list[str] | None = None) -> None:
    """The named columns in the given order, or all."""
    (df.select(*fieldnames) if fieldnames else df).write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, nullValue="\u0000", emptyValue="",
    )


MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_exists(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table, or None where there is none; a table that can't be read is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in MISSING:
            return None
        raise


def cached_inputs(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read the stage table at ``path``; compute and write it first where it is missing."""
    found = read_if_exists(spark, path)
    if found is None:
        compute().write.option("compression", "zstd").parquet(path)
        found = spark.read.parquet(path)
    return found


def existing_inputs(spark: SparkSession, path: str) -> DataFrame:
    """A table the user names: missing is an error."""
    found = read_if_exists(spark, path)
    if found is None:
        raise FileNotFoundError(f"no source inputs at {path}")
    return found


def export_labelled(datasets: dict[str, DataFrame], path: str) -> None:
    """All labelled data sets as one table partitioned by data set name; exporting a set again replaces it."""
    for name, df in datasets.items():
        df.select("row_id", "inputs", "label").write.mode("overwrite").parquet(f"{path}/dataset={name}")


#: Columns that name folders are given their types: a model called 007 is no number.
LOG_SCHEMA = (
    "row_id bigint, source_input array<string>, source_output string, followup_inputs array<array<string>>, "
    "followup_outputs array<string>, relations array<boolean>, verif_failure string, run_id string, part int, "
    "committed_at timestamp, llm string, task string, mr int"
)
