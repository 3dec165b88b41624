"""Tables that grow by committed parts.

A part is a folder of its own below ``parts``. It belongs to the table once a row in ``manifest`` names it, which is written
after the part is whole; what a crash leaves behind is a folder that nobody names. The manifest also holds each part's labels
and the range of its row identifiers, so readers open only the parts that can hold what they look for.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import LOG_SCHEMA, read_if_exists

MANIFEST = "name string, labels string, least bigint, most bigint, rows bigint, committed_at timestamp"


@dataclass(frozen=True)
class Part:
    """``least`` and ``most`` bound the row identifiers; both are None where the part has none, or none that are numbers."""

    name: str
    labels: dict
    least: int | None
    most: int | None
    rows: int
    committed_at: datetime

    def meets(self, least: int | None, most: int | None) -> bool:
        """Whether the part may hold a row of the range; None is no bound."""
        if not self.rows or self.least is None:
            return self.rows > 0
        return (least is None or self.most >= least) and (most is None or self.least <= most)

    def shares_chunk(self, chunks: int, chunk: int) -> bool:
        """Whether rows of chunk ``chunk`` of ``chunks`` may be here; a part without such labels may hold any.

        A chunk is a residue of a hash. Two residues have a number in common if they agree modulo the greatest common divisor.
        """
        own = self.labels.get("chunks")
        return own is None or (chunk - self.labels["chunk"]) % math.gcd(own, chunks) == 0


class PartTable:
    """The table at ``path``; ``partition_by`` are columns that name folders within a part."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: Iterable[str] = (), id_col: str = "row_id"):
        self.spark, self.path, self.schema, self.partition_by, self.id_col = spark, path.rstrip("/"), schema, tuple(partition_by), id_col

    def parts(self) -> list[Part]:
        """What is committed, oldest first: a row per part, as a listing of files would be."""
        found = read_if_exists(self.spark, f"{self.path}/manifest", MANIFEST)
        rows = [] if found is None else found.collect()
        parts = [Part(r["name"], json.loads(r["labels"]), r["least"], r["most"], r["rows"], r["committed_at"]) for r in rows]
        return sorted(parts, key=lambda p: (p.committed_at, p.name))

    def write_part(self, df: DataFrame | Iterable[DataFrame]) -> Callable[..., Part]:
        """Write a part without committing it; calling the result with its labels does.

        Several tables are written one after the other, so the disk holds what one of them shuffles at a time.
        """
        name = uuid.uuid4().hex
        folder = f"{self.path}/parts/commit={name}"
        for rows in [df] if isinstance(df, DataFrame) else df:
            rows.write.mode("append").option("compression", "zstd").partitionBy(*self.partition_by).parquet(folder)
            if rows is not df:
                self.spark.sparkContext._jvm.System.gc()  # what was shuffled for the table goes now

        def commit(**labels) -> Part:
            # Read from the written part's identifiers: an observation of the write would be lost where the plan is found empty.
            written = self.spark.read.schema(self.schema).parquet(folder)
            number = F.col(self.id_col) if dict(written.dtypes)[self.id_col] == "bigint" else F.lit(None).cast("bigint")
            ids = written.agg(F.min(number), F.max(number), F.count(F.lit(1)))
            row = (name, json.dumps(labels, sort_keys=True), *ids.first(), datetime.now(timezone.utc))
            self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
            return Part(name, labels, *row[2:])

        return commit

    def append(self, df: DataFrame | Iterable[DataFrame], **labels) -> Part:
        return self.write_part(df)(**labels)

    def read(self, parts: list[Part] | None = None) -> DataFrame | None:
        """The rows of the given parts, or of all; None where nothing was ever committed."""
        if parts is None and not (parts := self.parts()):
            return None
        chosen = [f"{self.path}/parts/commit={p.name}" for p in parts if p.rows]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/parts").parquet(*chosen).drop("commit")


def result_log(spark: SparkSession, path: str) -> PartTable:
    """The result log: within a part there is one folder for each (llm, task, mr)."""
    return PartTable(spark, path, LOG_SCHEMA, ("llm", "task", "mr"))


def append_results(results: DataFrame, path: str, run_id: str, part: int = 0, **labels) -> Part:
    """Commit records as one part of a run; runs number their parts, and a row says when its part was begun."""
    marks = {"run_id": F.lit(run_id), "part": F.lit(part), "committed_at": F.lit(datetime.now(timezone.utc))}
    return result_log(results.sparkSession, path).append(results.withColumns(marks), run_id=run_id, part=part, **labels)


def append_in_steps(spark: SparkSession, steps: Iterable[DataFrame], path: str, run_id: str, part: int = 0, **labels) -> Part:
    """As ``append_results`` for records that come as several tables, which are made and written one after the other."""
    marks = {"run_id": F.lit(run_id), "part": F.lit(part), "committed_at": F.lit(datetime.now(timezone.utc))}
    return result_log(spark, path).append((s.withColumns(marks) for s in steps), run_id=run_id, part=part, **labels)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    return result_log(spark, path).read()
