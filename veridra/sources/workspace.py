"""Where jobs may write: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below `spark.checkpoint.dir` or the context's checkpoint folder; below a temporary folder only in a local session without
    either (tests). On a cluster that is an error, as executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veridra-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame written as Parquet and read back: what builds on it several times scans it, joins know its size, and a lost executor costs
    no more than its own tasks."""
    path = new_path(df.sparkSession, name)
    if _KEPT:
        _KEPT[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: dict[tuple[str, str, str], str] = {}


def made_once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], by: str, order: list[str], buckets: Callable[[], int] | None = None) -> DataFrame:
    """A table that many jobs of a session share, made at its first use: stored in buckets of `by`, sorted by `order`, so that joins and groupings by that column
    find their rows together. It stands for the `source` folder as that was at first use; `forget` has it made anew."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _TABLES:
        parts = buckets() if buckets else int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex}"
        # a task per bucket, so a bucket is one file
        writer = make().repartition(parts, by).write.bucketBy(parts, by).sortBy(*order)
        writer.option("path", new_path(spark, name)).saveAsTable(table)
        _TABLES[key] = table
    return spark.table(_TABLES[key])


#: rows that a task sorts or groups at a time, and bytes of text; more tasks are made of larger tables, so that a task's memory does not grow with them
TASK_ROWS, TASK_TEXT = 1_000_000, 4 << 20


def tasks(spark: SparkSession, size: int, most: int) -> int:
    """Into how many tasks to deal so many rows or bytes: the session's number, or more where one would get more than `most`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))


def forget(spark: SparkSession) -> None:
    """Drop the session's shared tables and their files."""
    for key in [k for k in _TABLES if k[0] == spark.sparkContext.applicationId]:
        remove(spark, _location(spark, _TABLES[key]))
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(key)}")


def _location(spark: SparkSession, table: str) -> str:
    return next(r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r.col_name == "Location")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path by whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What `stored` writes inside the block is deleted at its end: for jobs whose result has been written or collected by then."""
    _KEPT.append([])
    try:
        yield
    finally:
        for path in _KEPT.pop():
            remove(spark, path)


_KEPT: list[list[str]] = []
