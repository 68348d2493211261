"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.config import KEYWORDS, PATTERNS
from modlark.operators.tables import last_write
from modlark.sources.shared import written

MESSAGE = (
    "message_id long, chat_id long, ts timestamp, user_id long, username string, chat_username string, text string, caption string, is_forwarded boolean, sender_chat_type string, reply_to_user_id long"
)
EVENT_DATE = "event_date"


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``(message, label)`` of a CSV with a header; rows whose label is no number are skipped."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="message string, label string")
    return raw.select("message", F.col("label").try_cast("int").alias("label")).where("message is not null and label is not null")


def dataset_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows and size in KiB of a labelled CSV."""
    rows = read_labelled(spark, path).agg(F.count("*").alias("rows"))
    files = spark.read.format("binaryFile").load(path).select("path", "length").agg(F.floor(F.sum("length") / 1024).alias("kib"))
    return rows.crossJoin(files)


def write_labelled(samples: DataFrame, path: str, mode: str = "append") -> None:
    samples.select("message", "label").write.mode(mode).csv(path, header=True, quote='"', escape='"')


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(kind, ord, term)`` of a JSON lexicon, or of the default one."""
    if path is None:
        rows = [("keyword", i, t) for i, t in enumerate(KEYWORDS)] + [("pattern", i, t) for i, t in enumerate(PATTERNS)]
        return spark.createDataFrame(rows, "kind string, ord int, term string")
    raw = spark.read.json(path, multiLine=True, schema="keywords array<string>, patterns array<string>")
    part = lambda kind, col: raw.select(F.lit(kind).alias("kind"), F.posexplode(col).alias("ord", "term"))
    return part("keyword", "keywords").unionByName(part("pattern", "patterns"))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Word lists ``(name, term)`` from JSON lines; lines without a term are left out."""
    return spark.read.json(path, schema="name string, term string").where("name is not null and term <> ''")


def messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path)


def write_lexicon(spark: SparkSession, keywords: tuple[str, ...], patterns: tuple[str, ...], path: str) -> None:
    """A lexicon as one JSON document."""
    spark.createDataFrame([(list(keywords), list(patterns))], "keywords array<string>, patterns array<string>").coalesce(1).write.json(path)


def message_stream(spark: SparkSession, path: str, source: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """An unbounded feed: files by default, or ``source="kafka"`` with JSON values."""
    if source != "kafka":
        return spark.readStream.format(source).schema(MESSAGE).options(**(options or {})).load(path)
    return decode_messages(spark.readStream.format("kafka").options(**(options or {})).load())


def decode_messages(raw: DataFrame) -> DataFrame:
    """Messages from the binary JSON ``value`` of a topic's records; tombstones
    and records that are no JSON objects with an id of a message are left out."""
    told = raw.where(F.col("value").isNotNull()).select(F.from_json(F.col("value").cast("string"), MESSAGE).alias("m"))
    return told.select("m.*").where("message_id is not null")


def append_events(events: DataFrame, path: str) -> None:
    """Add to the event log, which is partitioned by day."""
    events.withColumn(EVENT_DATE, F.to_date("created_at")).write.mode("append").partitionBy(EVENT_DATE).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_actions(actions: DataFrame, path: str) -> None:
    actions.write.mode("append").parquet(path)


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """A sink for `foreachBatch`: a batch that is repeated replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def save_artefacts(centroids: DataFrame, prototypes: DataFrame, model, path: str) -> None:
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    prototypes.write.mode("overwrite").parquet(f"{path}/prototypes")
    model.write().overwrite().save(f"{path}/model")


def load_artefacts(spark: SparkSession, path: str):
    """Centroids, prototypes and the logistic model."""
    from pyspark.ml.classification import LogisticRegressionModel

    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/prototypes"), LogisticRegressionModel.load(f"{path}/model")


def cached_scores(spark: SparkSession, path: str, n: int) -> DataFrame | None:
    """Cached scores, unless they are of another number of rows."""
    found = spark.read.parquet(path)
    return found if found.count() == n else None


def upsert(rows: DataFrame, path: str, keys: list[str], at: str, version: str = "version") -> None:
    """Put rows into a stored table: of each key the row of the highest version stays.

    The table is partitioned by the day of ``at``, one of its keys; days that
    no row touches keep their files.  A batch that comes again, or late, changes
    nothing.  The new partitions are written elsewhere first, so a job that fails
    leaves the table as it was or as it will be, day by day."""
    spark = rows.sparkSession
    new = written(rows.withColumn("day", F.date_format(at, "yyyy-MM-dd")), "upsert")
    both = new
    try:
        both = spark.read.schema(new.schema).parquet(path).join(F.broadcast(new.select("day").distinct()), "day", "left_semi").select(*new.columns).unionByName(new)  # days of a batch
    except AnalysisException:  # the first batch
        pass
    merged = written(last_write(both, [*keys, "day"], version), "upsert")
    merged.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")
