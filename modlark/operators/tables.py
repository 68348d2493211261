"""The tables around scoring: samples, events, users, snapshots and settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_samples(existing: DataFrame, given: DataFrame) -> DataFrame:
    """Samples with a label 0 or 1 whose pair is not there yet, once each."""
    valid = given.where(F.col("message").isNotNull() & F.col("label").isin(0, 1)).select("message", "label").distinct()
    return valid.join(existing.select("message", "label"), ["message", "label"], "left_anti")


def recent(df: DataFrame, time_col: str, id_col: str, n: int) -> DataFrame:
    """The newest rows, ties by id."""
    return df.orderBy(F.desc(time_col), F.desc(id_col)).limit(n)


def actions_for(actions: DataFrame, events: DataFrame) -> DataFrame:
    """The verdicts on some events (column ``id``), each with its ``place`` in time."""
    mine = actions.join(events.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi")
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy("performed_at", "id")))


def user_profiles(messages: DataFrame) -> DataFrame:
    """First and last time of each user, the name of the last message (null
    included) and the last flags that were given, or false."""
    by = F.struct("ts", "message_id")
    flag = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)), F.lit(False)).alias(c) if c in messages.columns else F.lit(False).alias(c)
    last = F.max(F.struct(F.col("ts"), F.col("message_id"), F.col("username").alias("u")))
    return messages.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), last["u"].alias("username"), flag("is_whitelisted"), flag("is_banned"))


def merge_profiles(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Stored profiles after an update: the first time is kept, names and times are the update's."""
    s, u = stored.alias("s"), update.alias("u")
    met = s.join(u, F.col("s.user_id") == F.col("u.user_id"), "full_outer")
    known = F.col("u.user_id").isNotNull()
    return met.select(
        F.coalesce("s.user_id", "u.user_id").alias("user_id"), F.least("s.first_seen_at", "u.first_seen_at").alias("first_seen_at"), F.greatest("s.last_seen_at", "u.last_seen_at").alias("last_seen_at"),
        F.when(known, F.col("u.username")).otherwise(F.col("s.username")).alias("username"), F.coalesce("u.is_whitelisted", "s.is_whitelisted").alias("is_whitelisted"), F.coalesce("u.is_banned", "s.is_banned").alias("is_banned"),
    )


def touch(profiles: DataFrame, messages: DataFrame) -> DataFrame:
    """Known users' last time raised to that of newer messages; no new users."""
    last = messages.groupBy("user_id").agg(F.max("ts").alias("_ts"))
    return profiles.join(last, "user_id", "left").withColumn("last_seen_at", F.greatest("last_seen_at", "_ts")).select(*profiles.columns)


def lookup(profiles: DataFrame, ids: DataFrame) -> DataFrame:
    return profiles.join(ids.select("user_id").distinct(), "user_id", "left_semi")


def last_write(df: DataFrame, keys: list[str], version: Column | str) -> DataFrame:
    """One row for each key: that of the highest version.  Tasks reduce their
    rows before the shuffle, so a key that is written often is no hot one."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_last"))
    return last.select(*keys, *(F.col("_last")[c].alias(c) for c in rest)).select(*df.columns)


def settings_state(log: DataFrame) -> DataFrame:
    """``(key, value)`` after all changes; removed keys are gone."""
    return last_write(log, ["key"], "version").where("not deleted").select("key", "value")


def incidents(events: DataFrame, keep: int = 500) -> DataFrame:
    """Events that were not approved, numbered in order from 1; the newest stay."""
    found = events.where(F.col("action") != "approve")
    day = F.to_date("created_at")
    days = found.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per day
    base = days.select("_day", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_day").orderBy("created_at", "id")) + F.col("_before")
    numbered = found.withColumn("_day", day).join(F.broadcast(base), "_day").withColumn("spam_id", number.cast("long")).drop("_day", "_before")
    return numbered.orderBy(F.desc("spam_id")).limit(keep)


def incident_lookup(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The records of the numbers asked for (column ``spam_id``), null where
    there is none, and the range of numbers that there are."""
    span = found.agg(F.min("spam_id").alias("least"), F.max("spam_id").alias("most"))
    return asked.select("spam_id").distinct().join(found, "spam_id", "left").crossJoin(F.broadcast(span))  # one row


def preview(text: Column, n: int = 150) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


_TITLES = {"approve": "Approved", "notify": "Needs review", "delete": "Deleted", "kick": "Banned"}


def incident_report(scored: DataFrame) -> DataFrame:
    """What a reviewer sees: the score used, its label and titles."""
    has = F.col("p_adjusted").isNotNull()
    title = F.create_map(*(F.lit(x) for kv in _TITLES.items() for x in kv))
    return scored.select(
        "id", F.when(has, F.col("p_adjusted")).otherwise(F.col("average")).alias("score"), F.when(has, "p_spam").otherwise("average").alias("score_label"), preview(F.col("body")).alias("preview"),
        F.element_at(title, F.col("action")).alias("action_title"), F.coalesce(F.initcap("trigger"), F.lit("None")).alias("trigger_title"),
    )


def compact(events: DataFrame) -> DataFrame:
    """Without what only the analysis needs: capsules, vectors and their details."""
    bulky = re.compile(r"(^|_)(capsule|vec|vector|embedding|features|history)(_|$|s$)")
    return events.select(*(c for c in events.columns if not bulky.search(c)))


def debug_report(rows: DataFrame, flags: list[str], fired: list[str], contributions: Column, top: int = 3) -> DataFrame:
    """A message's active flags, its first five patterns, the names of its top
    contributions, the whitelist's three counts, and both probabilities if they
    differ by over 0.001."""
    names = lambda cols: F.array_compact(F.array(*(F.when(F.col(c).cast("int") == 1, F.lit(c)) for c in cols)))
    shown = lambda c: F.format_string("%.3f", F.floor(F.col(c) * 1000 + 0.5) / 1000)
    both = F.when(F.abs(F.col("p_original") - F.col("p_adjusted")) > 0.001, F.concat(shown("p_original"), F.lit(" -> "), shown("p_adjusted"))).otherwise(shown("p_adjusted"))
    whitelist = F.concat_ws("/", *(F.col(f"whitelist_hits_{k}").cast("string") for k in ("store", "order", "brand")))
    return rows.select(
        "id", preview(F.col("body"), 200).alias("preview"), F.concat_ws(",", names(flags)).alias("flags"), F.concat_ws(",", F.slice(names(fired), 1, 5)).alias("patterns"),
        F.concat_ws(",", F.transform(F.slice(contributions, 1, top), lambda x: x["name"])).alias("top"), whitelist.alias("whitelist"), both.alias("probability"),
    )
