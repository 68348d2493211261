"""Score combination and the action policy, as column functions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlark.config import Policy

APPROVE, NOTIFY, DELETE, KICK = "approve", "notify", "delete", "kick"


def policy_of(prefix: str = "", base: Policy = Policy()) -> Policy:
    """A policy whose overridable parts are the columns of `settings.policy_row`."""
    col = lambda name: F.col(prefix + name)
    return replace(
        base, mode=col("policy_mode"), notify=col("meta_notify"), delete=col("meta_delete"), kick=col("meta_kick"),
        announcement=col("meta_downweight_announcement"), reply_to_staff=col("meta_downweight_reply_to_staff"), whitelist=col("meta_downweight_whitelist"),
    )


def meta_probability(p: Column, vec: Column, ready: bool | Column = True) -> Column:
    """The model's probability where the model is ready and the message has a vector, else null."""
    return F.when(F.lit(ready) & vec.isNotNull(), p)


def has_vector_score(score: Column, confidence: Column) -> Column:
    return F.coalesce((score != 0.5) & (confidence > 0), F.lit(False))


def average_score(keyword: Column, tfidf: Column, vector: Column, confidence: Column) -> Column:
    both = 0.5 * vector + 0.3 * tfidf + 0.2 * keyword
    return F.when(has_vector_score(vector, confidence), both).otherwise(0.6 * tfidf + 0.4 * keyword)


def max_score(*scores: Column) -> Column:
    return F.greatest(*scores)


def all_high(keyword: Column, tfidf: Column, vector: Column, level: float = 0.7) -> Column:
    return (keyword >= level) & (tfidf >= level) & F.coalesce(vector >= level, F.lit(True))


def event_confidence(adjusted: Column, original: Column, preview: Column, meta: Column, average: Column) -> Column:
    return F.coalesce(adjusted, original, preview, meta, average)


def downweights(announcement: Column, reply_to_staff: Column, store: Column, order: Column, brand: Column, policy: Policy = Policy()) -> Column:
    """The multipliers that apply, in order: an array of (type, multiplier)."""
    hits = store + order + brand
    rules = (("is_channel_announcement", announcement, policy.announcement), ("reply_to_staff", reply_to_staff, policy.reply_to_staff), ("whitelist_hits", hits > 0, policy.whitelist), ("brand_hits", brand > 0, policy.brand))
    return F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("type"), F.lit(m).cast("double").alias("multiplier"))) for name, holds, m in rules)))


def adjusted(p: Column, applied: Column) -> Column:
    return F.aggregate(applied, p, lambda x, d: x * d["multiplier"])


def notify_threshold(degraded: Column, policy: Policy = Policy()) -> Column:
    """A little higher where the context could not be encoded."""
    return F.lit(policy.notify) + F.when(F.coalesce(degraded, F.lit(False)), policy.degraded_step).otherwise(0.0)


def select_action(p: Column, mode: Column, notify: Column, delete: Column, kick: Column) -> Column:
    """The first rung reached; modes without a rung skip it, unknown modes are manual."""
    may_delete, may_kick = mode.isin("semi-auto", "auto"), mode == "auto"
    return F.when(may_kick & (p >= kick), KICK).when(may_delete & (p >= delete), DELETE).when(p >= notify, NOTIFY).otherwise(APPROVE)


def legacy_trigger(keyword: Column, tfidf: Column, policy: Policy = Policy()) -> Column:
    """The filter whose threshold is reached, keywords first; null if none."""
    return F.when(F.coalesce(keyword, F.lit(0.0)) >= policy.legacy_keyword, "keyword").when(F.coalesce(tfidf, F.lit(0.0)) >= policy.legacy_tfidf, "tfidf")


def decide(mode: Column, p: Column, keyword: Column, tfidf: Column, applied: Column, degraded: Column, policy: Policy = Policy()) -> Column:
    """A decision as a struct; ``mode`` is a column, so that chats may differ.

    Legacy mode goes by the filters' thresholds and adds what the automatic
    ladder would do; other modes without a probability fall back on it.
    """
    degraded = F.coalesce(degraded, F.lit(False))
    legacy = mode == "legacy-manual"
    fallback = ~legacy & p.isNull()
    ladder = ~legacy & p.isNotNull()
    trigger = legacy_trigger(keyword, tfidf, policy)
    p_adjusted = F.when(ladder, adjusted(p, applied)).otherwise(p)
    notify = F.when(ladder, notify_threshold(degraded, policy)).otherwise(F.lit(policy.notify))
    delete, kick = F.lit(policy.delete), F.lit(policy.kick)
    action = F.when(ladder, select_action(p_adjusted, mode, notify, delete, kick)).otherwise(F.when(trigger.isNotNull(), NOTIFY).otherwise(APPROVE))
    preview = F.when(~ladder & p.isNotNull(), select_action(p, F.lit("auto"), F.lit(policy.notify), delete, kick))
    none = F.array().cast("array<struct<type:string,multiplier:double>>")
    return F.struct(
        action.alias("action"), p.alias("p_original"), p_adjusted.alias("p_adjusted"), F.when(ladder, applied).otherwise(none).alias("applied"), notify.alias("notify"), delete.alias("delete"), kick.alias("kick"),
        legacy.alias("legacy_mode"), fallback.alias("fallback_meta"), F.when(~ladder, trigger).alias("trigger"), preview.alias("preview_action"), degraded.alias("degraded_ctx"),
    )


_BASE = {KICK: "Critical spam (p=%s). Banned.", DELETE: "Evident spam (p=%s). Deleted.", NOTIFY: "Suspicious message (p=%s). Needs review.", APPROVE: "Legitimate message (p=%s)."}


def explain(action: Column, p: Column, applied: Column) -> Column:
    """A sentence for the action, with the probability in per cent, and the multipliers used."""
    hundredths = F.floor(p * 10000 + 0.5)
    percent = F.format_string("%d.%02d%%", F.floor(hundredths / 100), hundredths % 100)
    base = F.lit(None).cast("string")
    for name, text in _BASE.items():
        base = F.when(action == name, F.concat(F.lit(text.split("%s")[0]), percent, F.lit(text.split("%s")[1]))).otherwise(base)
    used = F.array_join(F.transform(applied, lambda d: F.concat(d["type"], F.lit(" (×"), d["multiplier"].cast("string"), F.lit(")"))), ", ")
    return F.when(F.size(applied) > 0, F.concat(base, F.lit(" Downweights: "), used, F.lit("."))).otherwise(base)
