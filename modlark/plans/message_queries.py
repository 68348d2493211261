"""Queries over messages: gates, keywords, text features, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.config import BRAND_TERMS, KEYWORDS, ORDER_TERMS, PATTERNS, STORE_TERMS
from modlark.functions import text as T
from modlark.functions.policy import legacy_trigger
from modlark.operators import gates, history, keywords
from modlark.plans.registry import query
from modlark.sources import fixtures as fx


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(fx.messages(spark, sf_dir), fx.whitelist(spark), fx.MODERATOR_CHAT)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(expr: str, pattern: str, tag: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, {_q(tag)}, '{flags}')"


def sql_normalize(expr: str, money: Sequence[str] = T.MONEY) -> str:
    out = _replace(expr, r"https?://[^\s]+|www\.[^\s]+", "<URL>", "gi")
    out = _replace(_replace(out, r"t\.me/[a-zA-Z0-9_]+", "<TG>", "gi"), T.HANDLE, "<TG>")
    out = _replace(_replace(out, T.PHONE, "<PHONE>"), T.LONG_PHONE, "<PHONE>")
    out = _replace(out, T.EMAIL, "<EMAIL>", "gi")
    for m in money:
        out = _replace(out, m, "<MONEY>", "gi")
    return f"trim({_replace(_replace(out, T.AGE, '<AGE>', 'gi'), chr(92) + 's+', ' ')})"


@query(fx.with_tables("gated", "SELECT message_id, chat_id, user_id, body FROM gated"))
def q_gated_messages(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", "chat_id", "user_id", "body")


@query(fx.with_tables("messages", """
    SELECT message_id, coalesce(user_id, 0) AS user_id, CASE WHEN user_id IS NULL THEN 'Unknown' ELSE username END AS username, reply_to_user_id IS NOT NULL AS is_reply,
           coalesce(reply_to_user_id IN (1, 2, 3), false) AS reply_to_staff, is_forwarded, coalesce(user_id IN (1, 2, 3), false) AS author_is_admin, coalesce(sender_chat_type = 'channel', false) AS is_channel_announcement FROM messages"""))  # fmt: skip
def q_metadata_flags(spark, sf_dir):
    out = gates.metadata_flags(fx.messages(spark, sf_dir), fx.whitelist(spark))
    return out.select("message_id", "user_id", "username", "is_reply", "reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement")


_KW = "[k FOR k IN " + fx._sql_list(KEYWORDS) + " IF contains(lower(body), lower(k))]"
_PT = "[p FOR p IN [" + ", ".join(f"CASE WHEN regexp_matches(body, {_q(p)}, 'i') THEN {_q(p)} END" for p in PATTERNS) + "] IF p IS NOT NULL]"
_SCORED = f"scored AS (SELECT *, CAST(len(kw) + len(pt) AS INTEGER) AS total FROM (SELECT *, {_KW} AS kw, {_PT} AS pt FROM gated))"
_LADDER = "CASE total WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.6 WHEN 3 THEN 0.8 ELSE 0.95 END::DOUBLE"


def scored(spark, sf_dir):
    return keywords.keyword_filter(gated(spark, sf_dir))


@query(fx.with_tables("gated", "").rstrip() + f", {_SCORED} SELECT message_id, array_to_string(kw, ',') AS keywords, array_to_string(pt, ' ') AS patterns, total AS total_matches, {_LADDER} AS keyword_score FROM scored")
def q_keyword_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("message_id", F.concat_ws(",", "matched_keywords").alias("keywords"), F.concat_ws(" ", "matched_patterns").alias("patterns"), "total_matches", "keyword_score")


@query(fx.with_tables("gated", "").rstrip() + f", {_SCORED} SELECT term, count(*) AS hits FROM (SELECT unnest(list_concat(kw, pt)) AS term FROM scored) GROUP BY term")
def q_keyword_freq(spark, sf_dir):
    return keywords.term_frequency(scored(spark, sf_dir))


@query(fx.with_tables("gated", "").rstrip() + f""", {_SCORED}, decided AS (SELECT chat_id, CASE WHEN {_LADDER} >= 0.6 THEN 'keyword' END AS trigger FROM scored)
    SELECT chat_id, CASE WHEN trigger IS NULL THEN 'approve' ELSE 'notify' END AS action, coalesce(trigger, 'none') AS trigger, count(*) AS n FROM decided GROUP BY ALL""")
def q_legacy_decisions(spark, sf_dir):
    trigger = legacy_trigger(F.col("keyword_score"), F.lit(0.0))
    out = scored(spark, sf_dir).select("chat_id", trigger.alias("trigger"))
    return out.groupBy("chat_id", F.when(F.col("trigger").isNull(), "approve").otherwise("notify").alias("action"), F.coalesce("trigger", F.lit("none")).alias("trigger")).agg(F.count("*").alias("n"))


@query(fx.with_tables("gated", f"SELECT message_id, {sql_normalize('body')} AS norm FROM gated"))
def q_normalize(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", T.normalize(F.col("body")).alias("norm"))


@query(fx.with_tables("gated", f"SELECT message_id, 'passage: ' || {sql_normalize('body')} AS capsule FROM gated"))
def q_capsule_msg(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", T.message_capsule(F.col("body")).alias("capsule"))


@query(fx.with_tables("gated", f"SELECT message_id, 'passage: ' || {sql_normalize('body', T.ENCODER_MONEY)} AS prepared FROM gated"))
def q_prepare(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", T.encoder_text(F.col("body")).alias("prepared"))


@query(f"SELECT doc_id, {sql_normalize('text')} AS norm FROM documents")
def q_normalize_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query("SELECT event_id, 'fi ' || event_id || ' Abc' AS composed FROM events")
def q_compose(spark, sf_dir):
    """Ligatures, full-width digits and letters of another form are the plain ones."""
    wide = F.translate(F.col("event_id").cast("string"), "0123456789", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19")
    text = F.concat(F.lit("\ufb01 "), wide, F.lit(" \uff21b\U0001d41c"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.nfkc(text).alias("composed"))


def _has(pattern: str, expr: str = "lower(body)", flags: str = "") -> str:
    return f"regexp_matches({expr}, {_q(pattern)}" + (f", '{flags}')" if flags else ")")


_DM = r"(^|[^\p{L}\p{N}_])(?:лс|личк[аеу]|в\s+личные)([^\p{L}\p{N}_]|$)"
_PATTERN_SQL = {
    "has_phone": _has(f"{T.PHONE}|{T.LONG_PHONE}", "body"), "has_url": _has(r"https?://|www\.", "body", "i"), "has_email": _has(T.EMAIL, "body", "i"), "has_money": f"len(regexp_extract_all(lower(body), {_q(T.COUNTED_MONEY)})) > 0",
    "money_count": f"CAST(len(regexp_extract_all(lower(body), {_q(T.COUNTED_MONEY)})) AS INTEGER)", "has_age": _has(T.AGE), "has_cta_plus": _has("|".join(T.CALL)), "has_dm": _has(_DM),
    "has_contact": f"({_has(f'{T.PHONE}|{T.LONG_PHONE}', 'body')} OR {_has(r'https?://|www[.]', 'body', 'i')} OR {_has(T.EMAIL, 'body', 'i')} OR {_has(r't[.]me/|' + T.HANDLE, 'body')})",
    "has_remote": _has(T.REMOTE), "has_legal": _has("|".join(T.LEGAL)), "has_casino": _has("|".join(T.CASINO)),
}
_WORDS = r"regexp_extract_all(body, '[\p{L}\p{N}_]+')"
_ODD = f"[w FOR w IN {_WORDS} IF (regexp_matches(w, '[а-яА-ЯёЁ]') AND regexp_matches(w, '[a-zA-Z]')) OR regexp_matches(w, '[а-яА-ЯёЁa-zA-Z]+\\d+[а-яА-ЯёЁa-zA-Z]+')]"


@query(fx.with_tables("gated", "SELECT message_id, " + ", ".join(f"{e} AS {k}" for k, e in _PATTERN_SQL.items()) + " FROM gated"))
def q_patterns(spark, sf_dir):
    found = T.patterns(F.col("body"))
    return gated(spark, sf_dir).select("message_id", *(found[k].alias(k) for k in _PATTERN_SQL))


@query(fx.with_tables("gated", f"SELECT message_id, round(len({_ODD})::DOUBLE / greatest(len({_WORDS}), 1), 6) AS obfuscation_ratio FROM gated"))
def q_obfuscation(spark, sf_dir):
    return gated(spark, sf_dir).select("message_id", F.round(T.obfuscation_ratio(F.col("body")), 6).alias("obfuscation_ratio"))


def _hits(terms: Sequence[str]) -> str:
    return f"CAST(len([t FOR t IN {fx._sql_list(terms)} IF contains(lower(body), t)]) AS INTEGER)"


@query(fx.with_tables("gated", f"SELECT message_id, {_hits(STORE_TERMS)} AS store, {_hits(ORDER_TERMS)} AS orders, {_hits(BRAND_TERMS)} AS brand FROM gated"))
def q_whitelist_hits(spark, sf_dir):
    p = T.patterns(F.col("body"))
    return gated(spark, sf_dir).select("message_id", p["whitelist_hits_store"].alias("store"), p["whitelist_hits_order"].alias("orders"), p["whitelist_hits_brand"].alias("brand"))


@query(fx.with_tables("messages", """
    SELECT message_id, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS text_length,
           CASE WHEN chat_username IS NOT NULL THEN 'https://t.me/' || chat_username || '/' || message_id ELSE 'https://t.me/c/' || abs(chat_id) || '/' || message_id END AS link FROM messages"""))  # fmt: skip
def q_hash_link(spark, sf_dir):
    m = fx.messages(spark, sf_dir)
    return m.select("message_id", T.text_hash(F.col("text")).alias("text_hash"), F.length("text").alias("text_length"), T.message_link(F.col("chat_username"), F.col("chat_id"), F.col("message_id")).alias("link"))


def with_history(spark, sf_dir, texts: bool = True):
    """Gated messages with their history; without ``texts`` each text in it is empty, for those who only count them."""
    rows = gates.metadata_flags(gated(spark, sf_dir), fx.whitelist(spark))
    return history.with_history(history.normalized(rows) if texts else rows.withColumn("norm", F.lit("")))


_NORM = f"normed AS (SELECT *, {sql_normalize('body')} AS norm FROM gated)"
_HIST = """hist AS (SELECT *, coalesce(list({'u': user_id, 't': norm}) OVER (PARTITION BY chat_id ORDER BY ts, message_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), []) AS ch,
    coalesce(list(norm) OVER (PARTITION BY user_id ORDER BY ts, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS uh FROM normed),
    ctx AS (SELECT *, [y.t FOR y IN list_reverse([x FOR x IN ch IF x.u <> user_id])[1:4]] AS cc, list_reverse(uh)[1:5] AS uc FROM hist)"""
_CTX = fx.with_tables("gated", "").rstrip() + f", {_NORM}, {_HIST} "


@query(_CTX + "SELECT message_id, CAST(len(ch) AS INTEGER) AS history, CAST(len(cc) AS INTEGER) AS n, array_to_string(cc, '|') AS context FROM ctx")
def q_chat_context(spark, sf_dir):
    h = with_history(spark, sf_dir)
    c = history.chat_context(F.col("chat_history"), F.col("user_id"))
    return h.select("message_id", F.size("chat_history").alias("history"), F.size(c).alias("n"), F.concat_ws("|", c).alias("context"))


@query(_CTX + "SELECT message_id, CAST(len(uc) AS INTEGER) AS n, array_to_string(uc, '|') AS context FROM ctx")
def q_user_context(spark, sf_dir):
    h = with_history(spark, sf_dir)
    c = history.user_context(F.col("user_history"))
    return h.select("message_id", F.size(c).alias("n"), F.concat_ws("|", c).alias("context"))


_MARKS = "'[reply_to_staff=' || CAST(coalesce(reply_to_user_id IN (1, 2, 3), false) AS INTEGER) || '][is_forwarded=' || CAST(is_forwarded AS INTEGER) || '][author_is_admin=0][is_channel_announcement=' || CAST(coalesce(sender_chat_type = 'channel', false) AS INTEGER) || ']' || chr(10)"
_SEP = "chr(10) || '---' || chr(10)"


@query(_CTX + f""", head AS (SELECT *, {_MARKS} AS marks, 'passage:' || chr(10) || '[CTX:n=' || len(cc) || ']' || {_MARKS} || norm AS h FROM ctx),
    fit AS (SELECT *, [i FOR i IN range(1, len(cc) + 1) IF list_sum([5 + length(x) FOR x IN cc[1:i]]) <= 2048 - length(h)] AS ok FROM head)
    SELECT message_id, CASE WHEN length(h) >= 2048 THEN 'passage:' || chr(10) || '[CTX:n=0]' || marks || left(norm, 1848) ELSE h || array_to_string([{_SEP} || x FOR x IN cc[1:len(ok)]], '') END AS capsule FROM fit""")
def q_ctx_capsule(spark, sf_dir):
    h = with_history(spark, sf_dir).withColumn("context", history.chat_context(F.col("chat_history"), F.col("user_id")))
    flags = {k: F.col(k) for k in ("reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement")}
    return h.select("message_id", history.context_capsule(F.col("norm"), F.col("context"), flags).alias("capsule"))


@query(_CTX + f""", head AS (SELECT *, 'passage:' || chr(10) || '[USER:k=' || len(uc) || ']' || chr(10) AS h, [left(x, 100) FOR x IN uc] AS cut FROM ctx),
    fit AS (SELECT *, [i FOR i IN range(1, len(cut) + 1) IF list_sum([5 + length(x) FOR x IN cut[1:i]]) - 5 <= 512 - length(h)] AS ok FROM head)
    SELECT message_id, h || array_to_string(cut[1:len(ok)], {_SEP}) AS capsule FROM fit""")
def q_user_capsule(spark, sf_dir):
    h = with_history(spark, sf_dir).withColumn("context", history.user_context(F.col("user_history")))
    return h.select("message_id", history.user_capsule(F.col("context")).alias("capsule"))


@query(fx.with_tables("gated", "SELECT count(DISTINCT chat_id) AS chats, (SELECT CAST(sum(least(n, 12)) AS BIGINT) FROM (SELECT count(*) AS n FROM gated GROUP BY chat_id)) AS buffered, count(DISTINCT user_id) AS users FROM gated"))
def q_history_stats(spark, sf_dir):
    return history.history_stats(gated(spark, sf_dir))
