"""Cut a DataFrame from its lineage by writing it where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this application, in local mode only, where all tasks share the driver's disk."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (known or f"file://{tempfile.gettempdir()}/weft-{spark.sparkContext.applicationId}").rstrip("/")


def until_exit(spark: SparkSession, path: str) -> str:
    """path, to be deleted when the application ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; the copy is deleted when the application ends.

    It does not depend on any executor, and downstream joins see plain scans, whose skewed
    partitions adaptive execution can split.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(until_exit(df.sparkSession, path))
