"""Scratch space shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, deleted when the driver's JVM ends.

    Where the setting is missing, a session whose executors are threads of the driver
    (master local or local[n], as in tests) gets a temporary folder; any other session is refused,
    because its executors would not see each other's files.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base.rstrip('/')}/scoreloom-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregate that several later steps read, and continue from the file.

    Without it each reader prunes the columns differently, no exchange is shared, and
    the joins below the aggregate run once per reader. The file also survives lost
    executors.
    """
    return materialise(df, scratch_dir(df.sparkSession) + "/table")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage by writing a table and reading it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
