"""Chat and user history before each message, and the capsules built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlark import config
from modlark.functions.text import normalize


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def _before(messages: DataFrame, key: str, entry: Column, rows: int, name: str, bucket_seconds: int) -> DataFrame:
    """Add ``name``: the entries of the key's ``rows`` messages before each one, oldest first.

    A key's messages are cut by time; each bucket is ordered by itself and gets
    the last entries of those before it, so no task orders all that a busy chat
    or user ever wrote."""
    order, cut = ("ts", "message_id"), messages.withColumn("_bucket", F.floor(F.unix_seconds("ts") / bucket_seconds))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    own = cut.withColumn("_own", F.collect_list(entry).over(inside.rowsBetween(-rows, -1)))
    newest = Window.partitionBy(key, "_bucket").orderBy(*(F.desc(c) for c in order))
    ends = cut.select(key, "_bucket", *order, entry.alias("_entry"), F.row_number().over(newest).alias("_n")).where(F.col("_n") <= rows)
    tails = ends.groupBy(key, "_bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_entry"))), lambda x: x["_entry"]).alias("_tail"))  # `rows` entries
    past = Window.partitionBy(key).orderBy("_bucket").rowsBetween(-rows, -1)  # one row per bucket, each with an entry at least
    carried = tails.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), _last(F.flatten(F.collect_list("_tail").over(past)), rows).alias("_carried"))
    met = own.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_at")), "left")
    return met.withColumn(name, _last(F.concat("_carried", "_own"), rows)).drop("_bucket", "_own", "_key", "_at", "_carried")


def with_history(messages: DataFrame, chat_rows: int = config.CHAT_HISTORY, user_rows: int = config.USER_HISTORY, bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``chat_history`` (user and text of the chat's last messages) and
    ``user_history`` (texts of the user's last ones, in all chats), oldest
    first, the message itself not included.

    Frames are bounded, so what a window holds does not grow with a chat; the
    texts are normalised once per message, before they are collected.
    """
    chat = _before(messages, "chat_id", F.struct(F.col("user_id").alias("user"), F.col("norm").alias("text")), chat_rows, "chat_history", bucket_seconds)
    return _before(chat, "user_id", F.col("norm"), user_rows, "user_history", bucket_seconds)


def normalized(messages: DataFrame, text_col: str = "body", compose: bool = True) -> DataFrame:
    return messages.withColumn("norm", normalize(F.col(text_col), compose))


def chat_context(history: Column, user: Column, n: int = config.CHAT_CONTEXT) -> Column:
    """The last ``n`` texts of others, newest first: users are told apart after the frame is cut."""
    others = F.filter(F.reverse(history), lambda h: h["user"] != user)
    return F.slice(F.transform(others, lambda h: h["text"]), 1, n)


def user_context(history: Column, n: int = config.USER_CONTEXT) -> Column:
    return F.slice(F.reverse(history), 1, n)


def _fitting(texts: Column, room: Column, first_free: bool) -> Column:
    """The leading texts that fit, each with a separator of 5 characters before
    it (``first_free``: but not the first)."""
    start = F.struct(room.cast("long").alias("room"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def add(state: Column, text: Column) -> Column:
        cost = F.length(text) + (F.when(F.size(state["kept"]) == 0, 0).otherwise(5) if first_free else F.lit(5))
        fits = state["open"] & (state["room"] >= cost)
        return F.struct(
            F.when(fits, state["room"] - cost).otherwise(state["room"]).cast("long").alias("room"),
            F.when(fits, F.concat(state["kept"], F.array(text))).otherwise(state["kept"]).alias("kept"),
            fits.alias("open"),
        )

    return F.aggregate(texts, start, add)["kept"]


def context_capsule(norm: Column, context: Column, flags: dict[str, Column], max_chars: int = config.CONTEXT_CHARS) -> Column:
    """A header with flags, the message, and as much context as fits.

    ``n`` counts the context before it is cut; a message that alone is too
    long is cut and goes without context, with n = 0."""
    names = ("reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement")
    marks = F.concat(*(F.concat(F.lit(f"[{k}="), F.coalesce(flags[k], F.lit(False)).cast("int").cast("string"), F.lit("]")) for k in names), F.lit("\n"))
    head = F.concat(F.lit("passage:\n[CTX:n="), F.size(context).cast("string"), F.lit("]"), marks, norm)
    room = F.lit(max_chars) - F.length(head)
    short = F.concat(F.lit("passage:\n[CTX:n=0]"), marks, F.substring(norm, 1, max_chars - 200))
    kept = _fitting(context, room, first_free=False)
    return F.when(room <= 0, short).otherwise(F.concat(head, F.concat_ws("", F.transform(kept, lambda t: F.concat(F.lit("\n---\n"), t)))))


def user_capsule(context: Column, max_chars: int = config.USER_CHARS, each: int = config.USER_MESSAGE_CHARS) -> Column:
    """A header and the user's last texts, each cut, as many as fit."""
    head = F.concat(F.lit("passage:\n[USER:k="), F.size(context).cast("string"), F.lit("]\n"))
    cut = F.transform(context, lambda t: F.substring(t, 1, each))
    return F.concat(head, F.concat_ws("\n---\n", _fitting(cut, F.lit(max_chars) - F.length(head), first_free=True)))


def history_stats(messages: DataFrame, rows: int = config.CHAT_HISTORY) -> DataFrame:
    """Chats, users, and messages that the chats' histories hold."""
    chats = messages.groupBy("chat_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("chats"), F.coalesce(F.sum(F.least("n", F.lit(rows))), F.lit(0)).cast("long").alias("buffered"))
    return chats.crossJoin(messages.agg(F.countDistinct("user_id").alias("users")))
