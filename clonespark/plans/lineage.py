"""Cutting lineage with tables in the folder that driver and executors share.

Tables lie in a folder of the application. A result reads them when it is run, so they stay until ``clean`` removes them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a local session has a folder of our own, and others raise ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + os.path.abspath("spark-warehouse/shared")
    return folder.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application, when none of its results is needed any more."""
    remove(spark, _own(spark))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and the table's path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no plan needs any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
