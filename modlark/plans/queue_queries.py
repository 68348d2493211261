"""Queries over the review queue as time goes on."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlark.operators import review, review_queue
from modlark.plans.registry import query
from modlark.sources import fixtures as fx

#: An event's place in the queue at each later arrival, counted from the newest that waits.
_EVICTED = """q AS (SELECT id, chat_id, message_id, created_at FROM log WHERE action = 'notify'), v AS (SELECT event_id, min(performed_at) AS gone FROM told GROUP BY event_id),
    waits AS (SELECT q.*, gone FROM q LEFT JOIN v ON v.event_id = q.id),
    evicted AS (SELECT DISTINCT id FROM (SELECT i.id, row_number() OVER (PARTITION BY j.id ORDER BY i.created_at DESC, i.id DESC) AS place
        FROM waits i JOIN waits j ON (i.created_at < j.created_at OR i.created_at = j.created_at AND i.id <= j.id) AND (i.gone IS NULL OR i.gone >= j.created_at)) WHERE place > 200)"""


@query(fx.with_tables("actions", "").rstrip() + f", told AS (SELECT * FROM actions), {_EVICTED} SELECT id, chat_id, id IN (SELECT id FROM evicted) AS evicted, gone IS NULL AND id NOT IN (SELECT id FROM evicted) AS waiting FROM waits")
def q_pending_evicted(spark, sf_dir):
    """Every event to review: whether the queue of 200 evicted it, and whether it still waits."""
    q, a = fx.events(spark, sf_dir).where("action = 'notify'").select("id", "chat_id", "created_at"), fx.actions(spark, sf_dir)
    out = review_queue.evicted(q, a).select("id", F.lit(True).alias("evicted"))
    waits = review_queue.pending_after(q, a).select("id", F.lit(True).alias("waiting"))
    met = q.join(out, "id", "left").join(waits, "id", "left")
    return met.select("id", "chat_id", F.coalesce("evicted", F.lit(False)).alias("evicted"), F.coalesce("waiting", F.lit(False)).alias("waiting"))


_LATE = "told AS (SELECT id AS event_id, created_at + to_seconds(id % 97 * 7200) AS performed_at FROM log WHERE action = 'notify' AND id % 3 <> 0)"


@query(fx.with_tables("log", "").rstrip() + f", {_LATE}, {_EVICTED}, e AS (SELECT id AS gone_id FROM evicted) SELECT id, CASE WHEN id % 4 = 1 THEN id WHEN gone_id IS NULL THEN id END AS event_id, CASE WHEN gone_id IS NULL THEN 7200000::BIGINT * (id % 97) END AS took_ms FROM q LEFT JOIN e ON gone_id = id WHERE id % 3 <> 0")
def q_resolved_after_eviction(spark, sf_dir):
    """Verdicts that come days late: the queue knows nothing of evicted events."""
    q = fx.events(spark, sf_dir).where("action = 'notify'")
    late = q.where("id % 3 <> 0").withColumn("performed_at", F.timestamp_micros(F.unix_micros("created_at") + F.col("id") % 97 * 7_200_000_000))
    payload = F.concat_ws(":", F.lit("ham"), "chat_id", "message_id", F.when(F.col("id") % 4 == 1, F.col("id")))
    verdicts = late.select("id", payload.alias("payload"), "performed_at")
    told = late.select(F.col("id").alias("event_id"), "performed_at")
    return review_queue.resolve_waiting(review.parse_payload(verdicts), q, told).select("id", "event_id", "took_ms")
