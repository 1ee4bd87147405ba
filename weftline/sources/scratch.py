"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset on one machine, as in tests, under one of our own.
    A cluster must name it: other machines don't see a folder of the driver's."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if not sc.getCheckpointDir():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        base = sc.getCheckpointDir()
    return f"{base}/weftline-{uuid.uuid4().hex}"


#: What Spark multiplies sizes of files by before it broadcasts a table. Rows of few users and items, sorted by user, take some
#: fifty times less in a file than in memory, so a file of 9 MB may be half a gigabyte at the driver.
SIZE_FACTOR = ("spark.sql.sources.fileCompressionFactor", "20")


def materialise(df: DataFrame) -> DataFrame:
    """Write and read back: lineage ends there. Sets ``SIZE_FACTOR`` for the session unless it is set; small tables are still
    broadcast once their rows have been counted."""
    path = shared_path(df.sparkSession)
    if df.sparkSession.conf.get(SIZE_FACTOR[0], None) is None:
        df.sparkSession.conf.set(*SIZE_FACTOR)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``table``, which nothing may read any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if re.fullmatch(r"weftline-[0-9a-f]{32}", path.getName()):
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession, every: float = 20.0) -> Iterator[None]:
    """Inside, files of past shuffles go early. Spark deletes them once the driver's JVM has collected what refers to them, which
    with little work at the driver may be after the job; it is asked to every ``every`` seconds."""
    done = threading.Event()

    def collect() -> None:
        while not done.wait(every):
            spark._jvm.System.gc()

    asking = threading.Thread(target=collect, daemon=True)
    asking.start()
    try:
        yield
    finally:
        done.set()
        asking.join()


#: Deletes a statement's shuffles when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written_only(spark: SparkSession):
    """Inside, each statement's shuffles are deleted when it has ended; only tables that ``materialise`` wrote are read again."""
    return _set(spark, CLEANUP, "true")


def by_some_keys(spark: SparkSession):
    """Inside, tables that are dealt by some of a join's keys alike meet as they are, without another shuffle by all of them."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
