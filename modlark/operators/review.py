"""The review queue, moderators' verdicts, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(events: DataFrame, actions: DataFrame, keep: int = 200) -> DataFrame:
    """Events to review that no verdict has met; the newest stay."""
    open_events = events.where(F.col("action") == "notify").join(actions.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")
    return open_events.orderBy(F.desc("created_at"), F.desc("id")).limit(keep)


def parse_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Split ``action:chat:message[:event]``; malformed rows are dropped."""
    part = F.split(F.col(col), ":")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("long")
    out = df.where(F.size(part) >= 3).select("*", part[0].alias("verdict"), number(2).alias("chat_id"), number(3).alias("message_id"), F.try_element_at(part, F.lit(4)).alias("_e"), number(4).alias("payload_event"))
    good = F.col("chat_id").isNotNull() & F.col("message_id").isNotNull() & (F.col("_e").isNull() | F.col("payload_event").isNotNull())
    return out.where(good).drop("_e")


def resolve(verdicts: DataFrame, queue: DataFrame) -> DataFrame:
    """Add ``event_id`` (the payload's, 0 being none, or else the queue's) and
    ``took_ms`` since the message was queued."""
    waiting = queue.select("chat_id", "message_id", F.col("id").alias("_event"), F.col("created_at").alias("_since"))
    met = verdicts.join(waiting, ["chat_id", "message_id"], "left")
    took = F.unix_millis("performed_at") - F.unix_millis("_since")
    return met.withColumn("event_id", F.coalesce(F.nullif("payload_event", F.lit(0).cast("long")), "_event")).withColumn("took_ms", took).drop("_event", "_since")


def to_samples(verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """Labelled samples: kick 1, ham 0, where the text is known; no others."""
    label = F.when(F.col("decision") == "kick", 1).when(F.col("decision") == "ham", 0)
    return verdicts.join(texts, "event_id").where(F.col("message").isNotNull()).select("event_id", "message", label.alias("label")).where("label is not null")


def reaction_times(events: DataFrame, actions: DataFrame) -> DataFrame:
    """Mean time to a verdict and the share judged ham, per chat and in all."""
    met = events.where(F.col("action") == "notify").select(F.col("id").alias("event_id"), "chat_id").join(actions, "event_id")
    mean, share = F.avg("took_ms"), F.avg(F.when(F.col("decision") == "ham", 1.0).otherwise(0.0))
    return met.rollup("chat_id").agg(F.grouping_id().cast("int").alias("all_chats"), F.count("*").alias("verdicts"), mean.alias("avg_took_ms"), share.alias("ham_share"))


def action_mix(events: DataFrame) -> DataFrame:
    """Events of each kind per chat and day, with totals."""
    return events.withColumn("day", F.date_format("created_at", "yyyy-MM-dd")).rollup("chat_id", "day", "action").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def exact_mean(col: str, digits: int = 6) -> Column:
    """A mean of numbers with so many digits, summed as decimals: the order of
    rows doesn't change it."""
    return F.sum(F.col(col).cast(f"decimal(18,{digits})")).cast("double") / F.count(col)


def snapshots(events: DataFrame, actions: DataFrame, period: str = "1 hour") -> DataFrame:
    """Per period: events that were not approved, verdicts ham, mean score and failed vectors."""
    ham = actions.where(F.col("decision") == "ham").groupBy("event_id").agg(F.count("*").alias("ham"))
    each = events.join(ham, events["id"] == ham["event_id"], "left")
    out = each.groupBy(F.window("created_at", period)["start"].alias("period_start")).agg(
        F.count(F.when(F.col("action") != "approve", 1)).alias("spam_detected"), F.coalesce(F.sum("ham"), F.lit(0)).alias("manual_overrides"),
        exact_mean("action_confidence").alias("avg_spam_score"), F.count(F.when(F.col("filter_embedding_score").isNull(), 1)).alias("embed_failures"),
    )
    return out.withColumn("period", F.lit(period))
