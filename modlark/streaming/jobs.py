"""Streaming jobs; batch code is shared, only state and time are handled here."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from modlark.config import CHAT_CONTEXT, CHAT_HISTORY
from modlark.operators import settings, tables
from modlark.operators.review import exact_mean
from modlark.operators.vectors import Encoder, hashed_encoder


def _joined(texts: list[str | None]) -> str | None:
    """As SQL joins an array: without nulls, and null if there is nothing else."""
    some = [t for t in texts if t is not None]
    return "|".join(some) if some or not texts else None


class _History(StatefulProcessor):
    """The last texts of a chat or user, as a list state of bounded length."""

    def __init__(self, key: str, rows: int, shown: int, idle_ms: int | None):
        self.key, self.rows, self.shown, self.idle_ms = key, rows, shown, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", "text string", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat([part[["ts", "message_id", "norm"]] for part in rows]).sort_values(["ts", "message_id", "norm"])
        held = [t[0] for t in self.texts.get()]
        out = []
        for message_id, text in zip(batch["message_id"], batch["norm"]):
            out.append((key[0], message_id, len(held), _joined(held[::-1][: self.shown])))
            held = [*held, text][-self.rows :]
        self.texts.put([(t,) for t in held])
        yield pd.DataFrame(out, columns=[self.key, "message_id", "history_size", "last_texts"])

    def close(self) -> None:
        pass


def stream_history(messages: DataFrame, rows: int = CHAT_HISTORY, idle_ms: int | None = None, key: str = "chat_id", shown: int = CHAT_CONTEXT) -> DataFrame:
    """For each message, how much history its chat or user (``key``) has, and
    the newest ``shown`` texts of it.

    Rows of a micro-batch are ordered by time, id and text, so that the result
    is one for any arrival, ids that come twice included.  One worker holds times,
    ids and texts of a key's rows in one micro-batch, which the source's options
    (such as ``maxFilesPerTrigger``) bound.  With ``idle_ms`` the state of
    keys that are idle for so long expires, by the clock; such a stream never
    runs out of batches, so it is for continuous triggers.  Needs the RocksDB
    state store."""
    schema = f"{key} long, message_id long, history_size int, last_texts string"
    return messages.groupBy(key).transformWithStateInPandas(_History(key, rows, shown, idle_ms), schema, "Update", "None" if idle_ms is None else "ProcessingTime")


class _UserVectors(StatefulProcessor):
    """Vectors of the users of a key range, the last used at the end."""

    def __init__(self, reuse_seconds: float, most: int, encoder: Encoder):
        self.reuse_seconds, self.most, self.encoder = reuse_seconds, most, encoder

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vectors = handle.getMapState("vectors", "user_id long", "since double, used long, vec array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat([part[["ts", "message_id", "user_id", "norm"]] for part in rows]).sort_values(["ts", "message_id", "user_id", "norm"])
        held = OrderedDict(sorted(((k[0], v) for k, v in self.vectors.iterator()), key=lambda x: x[1][1]))
        before, turn, out = dict(held), max((v[1] for v in held.values()), default=0), []
        for ts, message_id, user, text in zip(batch["ts"], batch["message_id"], batch["user_id"].tolist(), batch["norm"]):
            now, turn = ts.timestamp(), turn + 1
            known = held.pop(user, None)
            why = None if known and now - known[0] <= self.reuse_seconds else "expired" if known else "unknown"
            if why and not known and len(held) >= self.most:
                held.popitem(last=False)
            since, vec = (now, self.encoder([text])[0]) if why else (known[0], known[2])
            held[user] = (since, turn, vec)
            out.append((user, message_id, why is not None, why, vec))
        last = batch["ts"].max().timestamp()
        for user in [u for u, v in held.items() if last - v[0] > self.reuse_seconds]:
            del held[user]
        for user in before.keys() - held.keys():
            self.vectors.removeKey((user,))
        for user, value in held.items():
            if before.get(user) != value:
                self.vectors.updateValue((user,), value)
        yield pd.DataFrame(out, columns=["user_id", "message_id", "fresh", "why", "vec"])

    def close(self) -> None:
        pass


def stream_user_vectors(messages: DataFrame, reuse_seconds: float = 600, encoder: Encoder | None = None, ranges: int = 64, most: int = 1000) -> DataFrame:
    """For each message its user's vector, whether it was computed anew, and
    ``why``: the user is unknown, or what was known has expired.

    A vector is used again for ``reuse_seconds`` after it was computed, by the
    messages' own times; the state gives up those that have expired.  Users are
    dealt into ``ranges`` by a hash, and each keeps ``most`` users at most: the
    one used longest ago is given up, and encoded anew if it comes again.  So
    the state has ``ranges * most`` rows at most, for any number of users.
    With one range this is one cache for all."""
    dealt = messages.withColumn("_range", F.pmod(F.xxhash64("user_id"), F.lit(ranges)).cast("int"))
    return dealt.groupBy("_range").transformWithStateInPandas(_UserVectors(reuse_seconds, most, encoder or hashed_encoder()), "user_id long, message_id long, fresh boolean, why string, vec array<double>", "Update", "None")


def stream_snapshots(events: DataFrame, late: str = "2 hours", period: str = "1 hour") -> DataFrame:
    """Snapshot counts per period; rows later than the watermark are left out."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", period)["start"].alias("period_start")).agg(
        F.count(F.when(F.col("action") != "approve", 1)).alias("spam_detected"), F.count(F.when(F.col("filter_embedding_score").isNull(), 1)).alias("embed_failures")
    )


def _followed(events: DataFrame, actions: DataFrame, within: str, late: str, how: str) -> DataFrame:
    e = events.withWatermark("created_at", late)
    a = actions.select("event_id", "performed_at", "decision").withWatermark("performed_at", late)
    return e.join(a, F.expr(f"id = event_id and performed_at >= created_at and performed_at <= created_at + interval {within}"), how)


def stream_whole_snapshots(events: DataFrame, actions: DataFrame, within: str = "1 hour", late: str = "2 hours", period: str = "1 hour") -> DataFrame:
    """Snapshots of periods that are closed: events that were not approved, verdicts
    ham that follow ``within`` some time, mean score and failed vectors.

    Events wait for a verdict until the watermark has passed ``within``, then
    they are counted; a period comes out once, when nothing can be added to it.
    An event has one such verdict at most.  Verdicts of all kinds move the watermark."""
    counted = _followed(events, actions, within, late, "left_outer").groupBy(F.window("created_at", period).alias("_period")).agg(
        F.count(F.when(F.col("action") != "approve", 1)).alias("spam_detected"), F.count(F.when(F.col("decision") == "ham", 1)).alias("manual_overrides"),
        exact_mean("action_confidence").alias("avg_spam_score"), F.count(F.when(F.col("filter_embedding_score").isNull(), 1)).alias("embed_failures"),
    )
    return counted.select(F.col("_period.start").alias("period_start"), "spam_detected", "manual_overrides", "avg_spam_score", "embed_failures")


def stream_verdicts(events: DataFrame, actions: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events joined with verdicts that follow within some time."""
    return _followed(events.select("id", "created_at", "chat_id"), actions, within, late, "inner").select("id", "chat_id", "decision")


def stream_reviews(events: DataFrame, actions: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events with the verdict that follows within some time, and those whose time
    is over: with ``timed_out`` and no verdict, when the watermark has passed it."""
    met = _followed(events.select("id", "created_at", "chat_id"), actions, within, late, "left_outer")
    return met.select("id", "chat_id", "decision", F.col("event_id").isNull().alias("timed_out"))


def under_settings(decide: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame], DataFrame]:
    """For `run.run_to_table`: ``decide`` gets the rows of a micro-batch with a
    column for every setting, as they are in force when the batch begins.

    The log of changes in ``path`` is read again for every micro-batch, so a
    change reaches a running stream with the next one; without a log the
    defaults hold."""

    def each(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        try:
            log = spark.read.parquet(path)
        except AnalysisException:  # nothing has been changed yet
            log = spark.createDataFrame([], "key string, value string, deleted boolean, version long")
        now = settings.effective(tables.settings_state(log), settings.defaults(spark))
        return decide(batch.crossJoin(F.broadcast(settings.policy_row(now))))  # one row

    return each


def stream_distinct(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages without those delivered again within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["chat_id", "message_id"])
