"""Cutting the plan where a result feeds several branches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    A local session without one gets a folder of its own, as in tests; on a
    cluster a missing folder is an error, because no folder of one machine would do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and go on from the files.

    The files are in the shared folder, so lost executors read them again from there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write an intermediate result as Parquet in the shared folder and read it back.

    Takes less room than a checkpoint, keeps a table's statistics, and lets Spark drop the
    shuffle files that led to it as soon as it is written; readers can prune ``partition_by``.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _written(df, path, *partition_by)
    return _found(df.sparkSession, df.schema, path)


def rewritten(table: DataFrame, column: str, values: list, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table that ``stored`` partitioned by ``column``, changed part by part; ``change`` keeps the column.

    A part is deleted as soon as it is written anew, so the table is on disk once and not twice.
    """
    spark = table.sparkSession
    path, schema = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", change(table).schema
    for value in values:
        _written(change(table.where(F.col(column) == value)), path, column)
        _deleted(spark, f"{table.stored_at}/{column}={value}")
    forget(table)
    return _found(spark, schema, path) if values else stored(spark.createDataFrame([], schema), column)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing is computed from them any more."""
    for table in tables:
        _deleted(table.sparkSession, table.stored_at)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are deleted as soon as it is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _written(df: DataFrame, path: str, *partition_by: str) -> None:
    with shuffles_dropped(df.sparkSession):
        df.write.mode("append").partitionBy(*partition_by).parquet(path)


def _found(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    found.stored_at = path
    return found


def _deleted(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
