"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of the runs that are open, the innermost last.
_RUNS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set a local session, as in tests, sets one beside the warehouse; others may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in that folder, or in that of the open run."""
    return f"{_RUNS[-1] if _RUNS else shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def run(spark: SparkSession) -> Iterator[str]:
    """While it is open intermediate tables go to a folder of their own, which is deleted at its end, also after a failure.

    What a query returns reads them, so it is written somewhere else before: ``with run(spark): query(...).write...``
    """
    folder = shared_path(spark, "run")
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written as a table in that folder and read again: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """make(), written as by ``written``; the intermediate tables that it made on the way are deleted then."""
    path = shared_path(spark, what)
    with run(spark):
        df = make()
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
