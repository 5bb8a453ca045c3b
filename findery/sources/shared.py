"""The folder that the driver and all executors share, for tables that are made on the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, which only a local master may, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="findery-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession, folder: str) -> Iterator[None]:
    """Within, a query's shuffle files go as it ends, and not when the driver collects its garbage; at the end the folder goes."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, True)
    try:
        yield
    finally:
        spark.conf.set(key, before)
        discard(spark, folder)


#: Rows of text in an Arrow batch, unless the session says otherwise.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows where the session has Spark's default: a worker holds a batch of texts several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
