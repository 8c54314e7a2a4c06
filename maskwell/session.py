"""Getting the package to where tasks run, and the folder that they share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, as `--py-files` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not where the package is a shipped file itself
        path = os.path.join(tempfile.mkdtemp(prefix="maskwell-"), "maskwell.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
    _shipped.add(context.applicationId)


#: Used only where the session names no spark.checkpoint.dir and its master is this machine, as in tests.
LOCAL_SHARED_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/maskwell-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


_scratch: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except (Py4JError, AttributeError, OSError):  # the session has been stopped
            return


#: How much of a table one task gets, and how many tasks there are at most.
TASK_BYTES, MOST_TASKS = 2 << 20, 4096
#: Spark's word for a size that it doesn't know is far above this.
KNOWN_BYTES = 1 << 50


def spread(rows: DataFrame, most: int = KNOWN_BYTES, by: tuple[str, ...] = ()) -> DataFrame:
    """rows dealt out (by columns) over all cores, in tasks of about TASK_BYTES, if they are at most so many bytes.

    A table can be few row groups of one file however many rows it has, and so few long tasks. What
    follows costs each row far more than this shuffle. Streams and rows of unknown size stay as they are.
    """
    size = 0 if rows.isStreaming else int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if rows.isStreaming or size > most:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * max(1, min(-(-size // (TASK_BYTES * cores)), MOST_TASKS // cores)), *by)
