"""Tables written to the folder that the whole cluster shares.

Jobs that need an intermediate result twice, or that iterate, write it as
Parquet below ``spark.checkpoint.dir`` and read it back: lineage ends there and
a lost executor costs nothing but its running tasks.  What a result still
reads is deleted when the application ends, the rest as soon as it is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modlark.sources.shared import job_folder


class Scratch:
    """The intermediate tables of one job."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = job_folder(spark, job)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return what was written."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
