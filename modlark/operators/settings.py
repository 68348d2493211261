"""Run-time settings: defaults overlaid with valid overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.config import MODES, SETTINGS, Policy


def defaults(spark: SparkSession, values: dict[str, object] = SETTINGS) -> DataFrame:
    """``(key, kind, text, number)``."""
    rows = [(k, "mode", v, None) if isinstance(v, str) else (k, "number", None, float(v)) for k, v in values.items()]
    return spark.createDataFrame(rows, "key string, kind string, text string, number double")


def mode_name(raw: Column) -> Column:
    """A mode as it may be written: any case, blanks around it, ``_`` for ``-``."""
    return F.regexp_replace(F.lower(F.trim(raw)), "_", "-")


def checked(state: DataFrame, base: DataFrame) -> DataFrame:
    """Known keys of a settings state with their decoded value and a ``verdict``:
    ok, undecodable or rejected."""
    known = state.join(F.broadcast(base), "key")  # the fixed list of settings
    plain = F.trim(F.regexp_replace("value", '^\\s*"(.*)"\\s*$', "$1"))
    quoted = F.col("value").rlike('^\\s*".*"\\s*$')
    text = F.when((F.col("kind") == "mode") & quoted, mode_name(plain))
    number = F.when(F.col("kind") == "number", F.col("value").try_cast("double"))
    decoded = F.when(F.col("kind") == "mode", text.isNotNull()).otherwise(number.isNotNull())
    valid = F.when(F.col("kind") == "mode", text.isin(*MODES)).otherwise(number.between(0.0, 1.0))
    verdict = F.when(~decoded, "undecodable").when(~valid, "rejected").otherwise("ok")
    return known.select("key", "kind", text.alias("new_text"), number.alias("new_number"), F.col("text").alias("old_text"), F.col("number").alias("old_number"), verdict.alias("verdict"))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def is_default(c: DataFrame) -> Column:
    """Whether a checked override equals its default."""
    return F.when(F.col("kind") == "mode", F.col("new_text") == F.col("old_text")).otherwise(_close(F.col("new_number"), F.col("old_number")))


def overrides(state: DataFrame, base: DataFrame) -> DataFrame:
    """Valid overrides that differ from their defaults."""
    found = checked(state, base).where("verdict = 'ok'")
    return found.where(~is_default(found)).select("key", F.col("new_text").alias("text"), F.col("new_number").alias("number"))


def effective(state: DataFrame, base: DataFrame) -> DataFrame:
    """Every setting with its value in force and whether that is an override."""
    new = overrides(state, base).select("key", F.col("text").alias("_t"), F.col("number").alias("_n"))
    met = base.join(new, "key", "left")
    return met.select("key", F.coalesce("_t", "text").alias("text"), F.coalesce("_n", "number").alias("number"), (F.col("_t").isNotNull() | F.col("_n").isNotNull()).alias("overridden"))


def policy_row(effective_settings: DataFrame) -> DataFrame:
    """One row with a column for every setting, for `policy.policy_of`."""
    value = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c))).alias(k)
    return effective_settings.agg(*(value(k, "text" if isinstance(v, str) else "number") for k, v in SETTINGS.items()))


def changes(asked: DataFrame, state: DataFrame, base: DataFrame) -> DataFrame:
    """What becomes of asked settings (key, value): ``(key, outcome)``.

    ``unknown``, ``undecodable`` or ``rejected``; ``unchanged`` if the value is in
    force already, which writes nothing; ``removed`` if it is the default, which
    takes an override away; else ``set``.  One value for each key is asked."""
    told = checked(asked, base)
    now = effective(state, base).select("key", F.col("text").alias("_text"), F.col("number").alias("_number"))
    same = F.when(F.col("kind") == "mode", F.col("new_text") == F.col("_text")).otherwise(_close(F.col("new_number"), F.col("_number")))
    outcome = F.when(F.col("verdict") != "ok", F.col("verdict")).when(same, "unchanged").when(is_default(told), "removed").otherwise("set")
    known = told.join(F.broadcast(now), "key").select("key", outcome.alias("outcome"))  # a row for each setting
    return asked.select("key").join(F.broadcast(known), "key", "left").select("key", F.coalesce("outcome", F.lit("unknown")).alias("outcome"))


def threshold_view(effective_settings: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``(name, value, overridden)``: mode, thresholds and weights in force,
    with those that can't be overridden."""
    shown = F.coalesce("text", F.format_string("%.4f", "number"))
    fixed = {"meta_downweight_brand": policy.brand, "degraded_step": policy.degraded_step, "legacy_keyword": policy.legacy_keyword, "legacy_tfidf": policy.legacy_tfidf}
    rows = effective_settings.sparkSession.createDataFrame([(k, f"{v:.4f}", False) for k, v in fixed.items()], "name string, value string, overridden boolean")
    return effective_settings.select(F.col("key").alias("name"), shown.alias("value"), "overridden").unionByName(rows)


def chat_policies(chats: DataFrame, effective_settings: DataFrame) -> DataFrame:
    """Each chat's row of `policy_row`: its own mode and thresholds (columns
    named as settings, null or absent: none) over the settings in force."""
    base = policy_row(effective_settings).select(*(F.col(k).alias(f"_{k}") for k in SETTINGS))
    met = chats.crossJoin(F.broadcast(base))  # one row
    own = lambda k: F.coalesce(F.when(F.col(k).isin(*MODES), F.col(k)) if k == "policy_mode" else F.when(F.col(k).between(0.0, 1.0), F.col(k)), F.col(f"_{k}")) if k in chats.columns else F.col(f"_{k}")
    return met.select("chat_id", *(own(k).alias(k) for k in SETTINGS))


def reset(state: DataFrame, version: Column) -> DataFrame:
    """Changes that remove every override."""
    return state.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"), version.alias("version"))


def int_list(raw: Column) -> Column:
    """``1, 2;x`` as [1, 2]: numbers between commas, others left out."""
    return F.filter(F.transform(F.split(raw, ","), lambda s: F.trim(s).try_cast("long")), lambda n: n.isNotNull())


def truth(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin("1", "true", "yes", "on")
