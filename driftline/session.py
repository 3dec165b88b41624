"""Session set-up and the shared folder for written stage tables."""

from __future__ import annotations

import importlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_DATABASES: dict[str, str] = {}
_OWN_FOLDERS: dict[str, str] = {}
_SHIPPED: set[tuple[str, str]] = set()


def build_session(app_name: str = "driftline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the package relies on; a cluster's own settings win over none."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Long texts: keep one Arrow batch to a few megabytes instead of 10,000 rows.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stage table, below the cluster's shared checkpoint folder.

    Only where the session names no such folder and runs on one machine, as tests do, a temporary one is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="driftline-")
        base = _OWN_FOLDERS[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a stage table that has done its service."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _stage_database(spark: SparkSession) -> str:
    """A database of this application whose tables lie in the cluster's shared folder, so that dropping one deletes its files."""
    app = spark.sparkContext.applicationId
    if app not in _DATABASES:
        name = f"driftline_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{work_folder(spark, 'tables')}'")
        _DATABASES[app] = name
    return _DATABASES[app]


class StageTable:
    """A stage table that is dropped, with its files, when it has done its service.

    With a `key` it is dealt by the hash of that column and joins on it without being moved again.
    """

    def __init__(self, df: DataFrame, name: str, key: str | None = None):
        self.spark = df.sparkSession
        self.name = f"{_stage_database(self.spark)}.{name}_{uuid.uuid4().hex}"
        if key is None:
            writer = df.write
        else:
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
        writer.format("parquet").option("compression", "zstd").saveAsTable(self.name)
        self.spark.sparkContext._jvm.System.gc()  # what was shuffled for the table goes now
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dealt(df: DataFrame, name: str = "dealt") -> DataFrame:
    """The rows as a stage table, each with a number of its own (``_at``) and dealt by it.

    What is joined by ``_at`` alone comes to the rows: long texts are moved this once and never again.
    """
    return StageTable(df.withColumn("_at", F.monotonically_increasing_id()), name, "_at").df


def ship_packages(spark: SparkSession, *names: str) -> None:
    """Send the given Python packages to the executors, once per application.

    Functions that run in Python workers are found by their module name there, wherever the driver was started.
    """
    context = spark.sparkContext
    for name in names or ("driftline",):
        if (context.applicationId, name) in _SHIPPED:
            continue
        folder = os.path.dirname(os.path.abspath(importlib.import_module(name).__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="driftline-ship-"), name)
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(folder), os.path.basename(folder)))
        _SHIPPED.add((context.applicationId, name))
