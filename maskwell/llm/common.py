"""Shared helpers: tables in the cluster's shared folder, row numbers and safe column names."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir, spread

#: A group with more rows than this share of them all (and than LARGE_ROWS) meets its rows by broadcast.
LARGE_ROWS, LARGE_GROUPS = 100_000, 100_000
#: Decisions about single rows that are broadcast at most.
FEW_ROWS = 1_000_000

#: A table of at most so many bytes is dealt out over all cores, as it may be one row group of one file.
SMALL_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, path: str) -> DataFrame:
    """The table in a Parquet file or folder."""
    return spread(spark.read.parquet(path), SMALL_BYTES)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of files, and row numbers that were assigned while
    writing stay what they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwell-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_release_all)
    _written.append((spark, path))
    # Not Snappy: its buffers lie outside the heap until a collection of the old generation.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for release(): how many tables there are by now."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what materialise() has written since a mark, but for the table that keep reads.

    Results that still read such tables must be written by then. What is never released goes when
    the process ends.
    """
    kept = [] if keep is None else keep.inputFiles()
    stay = []
    for session, path in _written[since:]:
        if any(f"{path.split(':')[-1]}/" in f for f in kept):
            stay.append((session, path))
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _written[since:] = stay


def _release_all() -> None:
    while _written:
        spark = _written[-1][0]
        try:
            release(spark, len(_written) - 1)
        except (Py4JError, AttributeError, OSError):  # the session has been stopped
            return


def handing_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at its end the worker, which lives on, hands its free memory back."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (f"{stem}{'_' * k}" for k in range(len(taken) + 1)) if name.lower() not in taken)


def _list(values) -> list:
    return [values.apply(k) for k in range(values.size())]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells all its rows apart, for good; and the column's name.

    Rows of a file scan are numbered by file (a 64-bit hash of its path) and position, which costs
    nothing; anything else is written to the shared folder with numbers first.
    """
    name = unused(docs, "maskwell_row")
    own = [F.col(f"`{c}`") for c in docs.columns]
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "Project" and all(x.getClass().getSimpleName() == "AttributeReference" for x in _list(plan.projectList())):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in {c.lower() for c in docs.columns}:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select(*own, place.alias(name)), name
    place = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return materialise(docs.select(*own, place.alias(name)), "numbered"), name


def meets(docs: DataFrame, row: str, decided: DataFrame, how: str) -> DataFrame:
    """docs, which numbered() has given the column row, joined to a written table of decisions on that column.

    Decisions go to the texts by broadcast if there are at most FEW_ROWS of them (about 80 bytes
    each), so no text moves; more meet them by shuffle.
    """
    few = decided.count() <= FEW_ROWS
    return docs.join(F.broadcast(decided) if few else decided.hint("merge"), row, how)


def without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows in dropped, and without the column row."""
    return meets(docs, row, dropped, "left_anti").drop(row)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of their group; groups holds one row a key, and in n how many rows have it.

    A group that is large goes to its rows by broadcast, so no task gets all of them; there can't be
    more than LARGE_GROUPS such groups. The rest meet by shuffle.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    bound = max(LARGE_ROWS, total // LARGE_GROUPS)
    large = F.broadcast(groups.filter(F.col(n) > bound))
    rest = rows.join(large.select(key), key, "left_anti").join(groups.filter(F.col(n) <= bound), key)
    return rows.join(large, key).unionByName(rest)


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with rank, from 0, in this order, without sorting all rows in one task."""
    sorted_rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = sorted_rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr("sum(_n) over (order by _part rows between unbounded preceding and 1 preceding)")  # a row for each partition
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = sorted_rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return placed.withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*df.columns, "rank")
