"""Queries of streams whose state, settings and time-outs matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.config import USER_HISTORY
from modlark.plans.registry import query
from modlark.plans.table_queries import _DECIDED, _EFFECTIVE, _EXACT, _ROW, _decide, _message_stream, _stream, _user_stream
from modlark.sources import fixtures as fx
from modlark.sources.shared import job_folder
from modlark.streaming import jobs
from modlark.streaming.run import run_to_table, stored_state


def _feed(df: DataFrame, path: str, at: str) -> DataFrame:
    """A table as a stream of two files: its rows, and then one of ten days later, which closes all that was open."""
    df.write.parquet(f"{path}/1")
    last = df.agg(F.max(at).alias("at"))
    none = (F.lit(-1 if t == "bigint" else None).cast(t).alias(c) if c != at else (F.col("at") + F.expr("interval 10 days")).alias(c) for c, t in df.dtypes)
    last.select(*none).write.parquet(f"{path}/2")
    spark = df.sparkSession
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 200).option("recursiveFileLookup", "true").parquet(path)


def _feeds(spark, sf_dir, actions=fx.actions):
    folder = job_folder(spark, "feeds")
    return _feed(fx.events(spark, sf_dir), f"{folder}/events", "created_at"), _feed(actions(spark, sf_dir), f"{folder}/actions", "performed_at")


_LOG = fx.with_tables("log", "")
_ACT = fx.with_tables("actions", "")


@query(_ACT + f"""SELECT epoch_ms(time_bucket(INTERVAL 1 hour, created_at)) AS period_ms, count(*) FILTER (WHERE action <> 'approve') AS spam_detected, count(*) FILTER (WHERE decision = 'ham') AS manual_overrides,
    {_EXACT} AS avg_spam_score, count(*) FILTER (WHERE filter_embedding_score IS NULL) AS embed_failures FROM log l LEFT JOIN actions a ON a.event_id = l.id GROUP BY 1""")
def q_stream_snapshots(spark, sf_dir):
    """Whole snapshots of closed periods: an outer join in time, then windows."""
    events, actions = _feeds(spark, sf_dir)
    out = run_to_table(jobs.stream_whole_snapshots(events, actions))
    return out.select(F.unix_millis("period_start").alias("period_ms"), "spam_detected", "manual_overrides", "avg_spam_score", "embed_failures")


@query(_LOG + "SELECT id, chat_id, CASE WHEN id % 3 <> 0 AND id % 120 <= 60 THEN CASE WHEN id % 3 = 1 THEN 'kick' ELSE 'ham' END END AS decision, NOT (id % 3 <> 0 AND id % 120 <= 60) AS timed_out FROM log WHERE action = 'notify'")
def q_stream_reviews(spark, sf_dir):
    """Events to review with the verdict of a minute, or timed out."""
    events, actions = _feeds(spark, sf_dir)
    out = run_to_table(jobs.stream_reviews(events.where("action = 'notify' or action is null"), actions, within="1 minute", late="10 minutes"))
    return out.where("id <> -1")


def _batch_sql(b: int) -> str:
    part = "* 3 // (SELECT max(event_id) + 1 FROM events)"
    seen = f", settings_seen AS (SELECT * FROM settings_log WHERE version {part} <= {b})"
    return "SELECT * FROM (" + fx.with_tables("scores settings_log", "").rstrip() + seen + _EFFECTIVE.replace("FROM settings_log", "FROM settings_seen") + _ROW + f", ruled AS (SELECT * FROM scores CROSS JOIN row WHERE id {part} = {b})" + _DECIDED + ")"


@query(" UNION ALL ".join(map(_batch_sql, range(3))))
def q_stream_settings(spark, sf_dir):
    """Decisions of a stream in three batches, between which settings change."""
    folder = job_folder(spark, "settings")
    n = fx.events(spark, sf_dir).agg(F.max("id") + 1).first()[0] or 1
    part = lambda df, i, b: df.where(F.floor(F.col(i) * 3 / n) == b)
    scores, log = fx.scores(spark, sf_dir), fx.settings_log(spark, sf_dir)
    out = None
    for b in range(3):
        part(log, "version", b).write.mode("append").parquet(f"{folder}/log")
        part(scores, "id", b).write.mode("append").parquet(f"{folder}/scores")
        feed = spark.readStream.schema(scores.schema).parquet(f"{folder}/scores")
        out = run_to_table(feed, root=f"{folder}/run", each=jobs.under_settings(_decide, f"{folder}/log"))
    return out


@query("""WITH m AS (SELECT conv_id * 10 + turn AS message_id, conv_id % 25 AS chat_id, 1000 + (conv_id * 10 + turn) % 40 AS user_id FROM conversations)
    SELECT (SELECT count(DISTINCT chat_id) FROM m) AS chats, (SELECT CAST(sum(least(n, 12)) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY chat_id)) AS buffered,
        (SELECT count(DISTINCT user_id) FROM m) AS users, (SELECT CAST(sum(least(n, 10)) AS BIGINT) FROM (SELECT count(*) AS n FROM m GROUP BY user_id)) AS user_texts""")
def q_stream_history_stats(spark, sf_dir):
    """How much the history streams hold, read out of their state."""
    folder = job_folder(spark, "history")
    run_to_table(jobs.stream_history(_stream(spark, sf_dir, "conversations", _message_stream)), "update", f"{folder}/chats")
    run_to_table(jobs.stream_history(_stream(spark, sf_dir, "conversations", _user_stream), USER_HISTORY, key="user_id"), "update", f"{folder}/users")
    chats = stored_state(spark, f"{folder}/chats", "texts").agg(F.countDistinct("key.chat_id").alias("chats"), F.sum(F.lit(1)).alias("buffered"))
    users = stored_state(spark, f"{folder}/users", "texts").agg(F.countDistinct("key.user_id").alias("users"), F.sum(F.lit(1)).alias("user_texts"))
    return chats.crossJoin(F.broadcast(users))  # one row each


def _digits(texts: list[str]) -> list[list[float]]:
    """Eight numbers of a text: the digits of its hash."""
    return [[float(int(c, 16)) for c in t[:8]] for t in texts]


@query("""WITH RECURSIVE m AS (SELECT conv_id * 10 + turn AS message_id, 1000 + (conv_id * 10 + turn) % 40 AS user_id, md5(text) AS norm FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY message_id) AS k FROM m),
    r AS (SELECT user_id, k, message_id, message_id AS since, true AS fresh, 'unknown' AS why, norm FROM n WHERE k = 1
          UNION ALL SELECT n.user_id, n.k, n.message_id, CASE WHEN n.message_id - r.since > 600 THEN n.message_id ELSE r.since END, n.message_id - r.since > 600, CASE WHEN n.message_id - r.since > 600 THEN 'expired' END,
              CASE WHEN n.message_id - r.since > 600 THEN n.norm ELSE r.norm END FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
    SELECT user_id, message_id, fresh, why, left(norm, 8) AS vec FROM r""")
def q_stream_user_vectors(spark, sf_dir):
    """Users' vectors (of the digits of a hash): each is used again for ten hours."""
    out = jobs.stream_user_vectors(_stream(spark, sf_dir, "conversations", _user_stream), reuse_seconds=36_000, encoder=_digits)
    digits = F.array_join(F.transform("vec", lambda x: F.lower(F.hex(x.cast("long")))), "")
    return run_to_table(out, "update").select("user_id", "message_id", "fresh", "why", digits.alias("vec"))
