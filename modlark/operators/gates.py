"""Gates that messages pass before they are scored, and flags from their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.functions.text import effective_text


def gate(messages: DataFrame, whitelist: DataFrame, moderator_chat: int | None = None) -> DataFrame:
    """Messages with a sender and a text, not from the moderators' chat nor from
    whitelisted users (with a ``chat_id`` in ``whitelist``: each in that chat
    only); adds ``body``, the text or caption.

    The gates read raw columns, so they reach the scan before any text is
    normalised.
    """
    kept = messages.where(F.col("user_id").isNotNull())
    if moderator_chat is not None:
        kept = kept.where(~F.col("chat_id").eqNullSafe(F.lit(moderator_chat)))
    kept = kept.withColumn("body", effective_text(F.col("text"), F.col("caption"))).where("body <> ''")
    keys = ["chat_id", "user_id"] if "chat_id" in whitelist.columns else ["user_id"]
    return kept.join(whitelist.select(*keys).distinct(), keys, "left_anti")


def metadata_flags(messages: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Add the five flags of a message's metadata and its sender's name.

    A missing sender is user 0, ``Unknown``; a missing time is second 0.
    """
    staff = whitelist.select(F.col("user_id").alias("_staff")).distinct()
    target = staff.select(F.col("_staff").alias("_target"), F.lit(True).alias("_to_staff"))
    author = staff.select(F.col("_staff").alias("_author"), F.lit(True).alias("_is_admin"))
    met = messages.join(target, F.col("reply_to_user_id") == F.col("_target"), "left").join(author, F.col("user_id") == F.col("_author"), "left")
    return met.select(
        *(c for c in messages.columns if c not in ("user_id", "username", "is_forwarded", "is_reply", "reply_to_staff", "author_is_admin", "is_channel_announcement")),
        F.coalesce("user_id", F.lit(0)).alias("user_id"),
        F.when(F.col("user_id").isNull(), "Unknown").otherwise(F.col("username")).alias("username"),
        F.col("reply_to_user_id").isNotNull().alias("is_reply"),
        F.coalesce("_to_staff", F.lit(False)).alias("reply_to_staff"),
        F.coalesce("is_forwarded", F.lit(False)).alias("is_forwarded"),
        F.coalesce("_is_admin", F.lit(False)).alias("author_is_admin"),
        F.coalesce(F.col("sender_chat_type") == "channel", F.lit(False)).alias("is_channel_announcement"),
    )
