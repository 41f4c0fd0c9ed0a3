"""Session settings and tables written between the steps of a job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of text in an Arrow batch.
BATCH_ROWS = 500

_run_folders: dict[str, str] = {}
_shipped: set[str] = set()


def ship_code(spark: SparkSession, *packages: str) -> None:
    """Send the sources of this package, and of ``packages`` (folders beside it), to the executors, once a session.

    Python workers import the functions of a pandas UDF by name; they need the package even where it is not installed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="readloom-code-"), "readloom_code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for package in (here, *(os.path.join(root, p) for p in packages)):
            for folder, _, files in os.walk(package):
                for name in (f for f in files if f.endswith(".py")):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, unless they are smaller.

    Documents have thousands of characters and their tokens as many bytes again: at the default of 10,000 rows
    a batch with its results takes hundreds of megabytes in each Python worker and in the JVM.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder stands in only where nothing is set and Spark runs in
    local mode; on a cluster an executor could not read it back.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    app = spark.sparkContext.applicationId
    if app not in _run_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _run_folders[app] = tempfile.mkdtemp(prefix="readloom-")
    return _run_folders[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    The table stays in the shared folder until its owner clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/readloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote; anything else is left alone."""
    path = getattr(table, "_written_to", None)
    if path:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
