"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a temporary folder; a
    cluster session is refused, as its executors share no local disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="spark-modlark-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def job_folder(spark: SparkSession, job: str) -> str:
    """A new folder there for one job's tables, deleted when the application ends."""
    root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


def written(df: DataFrame, job: str) -> DataFrame:
    """``df`` as written to a `job_folder`: what is read from it several times is computed once."""
    path = f"{job_folder(df.sparkSession, job)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
