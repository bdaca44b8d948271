"""Results that are written out between rounds, so that no round computes the ones before it again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> None:
    """A checkpoint folder for sessions of one process; elsewhere spark.checkpoint.dir must be set."""
    if not spark.sparkContext.getCheckpointDir() and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pointfold-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder; later steps start from there."""
    shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def by_column(df: DataFrame, column: str) -> tuple[DataFrame, Callable[[], None]]:
    """df, written to the shared folder in a part for each value of the column, so that a filter on it reads that part only; and what removes it."""
    spark = df.sparkSession
    path = folder(spark, column)
    df.repartition(column).write.partitionBy(column).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    drop = lambda: there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return spark.read.schema(df.schema).parquet(path), drop
