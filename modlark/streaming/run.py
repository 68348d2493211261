"""Run a stream to the end of its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from modlark.sources.shared import job_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_table(out: DataFrame, mode: str = "append", root: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write all that is available to Parquet, batch by batch, and read it.

    A batch that runs again replaces its own files; in ``complete`` mode the
    last batch is the result.  With ``root`` the stream goes on from where it
    ended there before, and all its batches are read.  ``each`` is applied to
    every micro-batch as a table; what it reads is as it is at that time."""
    spark = out.sparkSession
    kept, root = root is not None, root or job_folder(spark, "stream")
    numbers: list[int] = []
    schemas = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        result = each(batch) if each else batch
        result.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        schemas[:] = [result.schema]
        if batch_id not in numbers:
            numbers.append(batch_id)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    if not numbers:
        return spark.createDataFrame([], out.schema)
    if kept:
        return spark.read.schema(schemas[0]).parquet(f"{root}/out").drop("batch")
    used = numbers[-1:] if mode == "complete" else numbers
    return spark.read.schema(schemas[0]).parquet(*(f"{root}/out/batch={n}" for n in used))


def stored_state(spark, root: str, variable: str, operator: int = 0) -> DataFrame:
    """What a stream that ended in ``root`` keeps in a state variable: ``key``,
    and its value or, of lists, a row for each element."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", variable).load(f"{root}/state")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
