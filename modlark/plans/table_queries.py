"""Queries over the event log, the review queue, settings, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.config import KEYWORDS, PATTERNS, SETTINGS, USER_CONTEXT, USER_HISTORY
from modlark.functions import policy as P
from modlark.operators import gates, history, lexicon, review, settings, tables, training, vectors
from modlark.plans.message_queries import _CTX, gated, with_history
from modlark.plans.registry import query
from modlark.sources import fixtures as fx
from modlark.sources import io
from modlark.sources.shared import job_folder, written
from modlark.streaming import jobs
from modlark.streaming.run import run_to_table

_LOG = fx.with_tables("log", "")
_ACT = fx.with_tables("actions", "")
_SET = fx.with_tables("settings_log", "")


@query(_LOG + "SELECT id, action, chat_id, action_confidence FROM log ORDER BY created_at DESC, id DESC LIMIT 100")
def q_recent_events(spark, sf_dir):
    return tables.recent(fx.events(spark, sf_dir), "created_at", "id", 100).select("id", "action", "chat_id", "action_confidence")


@query(fx.with_tables("messages", """SELECT user_id, epoch_ms(min(ts)) AS first_ms, epoch_ms(max(ts)) AS last_ms, last(username ORDER BY ts, message_id) AS username, false AS is_whitelisted, false AS is_banned
    FROM messages WHERE user_id IS NOT NULL GROUP BY user_id"""))
def q_user_profiles(spark, sf_dir):
    p = tables.user_profiles(fx.messages(spark, sf_dir))
    return p.select("user_id", F.unix_millis("first_seen_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), "username", "is_whitelisted", "is_banned")


@query(_LOG + ", u AS (SELECT user_id, min(created_at) AS a, max(created_at) AS b FROM log WHERE id % 2 = 0 GROUP BY user_id), t AS (SELECT user_id, max(created_at) AS c FROM log GROUP BY user_id) SELECT user_id, epoch_us(a) AS first_us, epoch_us(greatest(b, c)) AS last_us FROM u LEFT JOIN t USING (user_id)")
def q_touch_users(spark, sf_dir):
    e = fx.events(spark, sf_dir).withColumn("ts", F.col("created_at"))
    known = tables.user_profiles(e.where("id % 2 = 0"))
    return tables.touch(known, e).select("user_id", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"))


@query(_LOG + "SELECT id, row_number() OVER (ORDER BY created_at, id) AS spam_id, action FROM log WHERE action <> 'approve' ORDER BY spam_id DESC LIMIT 500")
def q_incidents(spark, sf_dir):
    return tables.incidents(fx.events(spark, sf_dir)).select("id", "spam_id", "action")


@query(_LOG + ", i AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS spam_id FROM log WHERE action <> 'approve' ORDER BY spam_id DESC LIMIT 500) SELECT min(spam_id) AS least, max(spam_id) AS most, count(*) AS n FROM i")
def q_incident_range(spark, sf_dir):
    found = tables.incidents(fx.events(spark, sf_dir))
    return found.agg(F.min("spam_id").alias("least"), F.max("spam_id").alias("most"), F.count("*").alias("n"))


@query(fx.with_tables("gated", """SELECT message_id AS id, round(message_id % 100 / 100.0, 6)::DOUBLE AS score, CASE WHEN message_id % 4 = 0 THEN 'average' ELSE 'p_spam' END AS score_label,
    CASE WHEN length(body) > 150 THEN left(body, 150) || '…' ELSE body END AS preview, CASE WHEN message_id % 2 = 0 THEN 'Needs review' ELSE 'Approved' END AS action_title, CASE WHEN message_id % 2 = 0 THEN 'Keyword' ELSE 'None' END AS trigger_title FROM gated"""))
def q_incident_report(spark, sf_dir):
    i, even = F.col("message_id"), F.col("message_id") % 2 == 0
    value = F.round(i % 100 / 100.0, 6)
    rows = gated(spark, sf_dir).select(
        i.alias("id"), F.when(i % 4 != 0, value).alias("p_adjusted"), value.alias("average"), "body", F.when(even, "notify").otherwise("approve").alias("action"), F.when(even, "keyword").alias("trigger")
    )
    return tables.incident_report(rows)


@query(fx.with_tables("messages log", "").rstrip() + """, m AS (SELECT user_id, min(ts) AS a, max(ts) AS b, last(username ORDER BY ts, message_id) AS username FROM messages WHERE user_id IS NOT NULL GROUP BY user_id),
    asked AS (SELECT DISTINCT 1000 + user_id % 60 AS user_id FROM log WHERE action = 'kick'), seen AS (SELECT 1000 + user_id % 60 AS user_id, max(created_at) AS c FROM log GROUP BY 1)
    SELECT user_id, username, epoch_us(a) AS first_us, epoch_us(greatest(b, c)) AS last_us FROM m SEMI JOIN asked USING (user_id) LEFT JOIN seen USING (user_id)""")
def q_user_lookup(spark, sf_dir):
    """Profiles of users that were kicked, their last time raised to that of the log; users without one are none."""
    e = fx.events(spark, sf_dir).select((1000 + F.col("user_id") % 60).alias("user_id"), F.col("created_at").alias("ts"), "action")
    profiles = tables.touch(tables.user_profiles(fx.messages(spark, sf_dir)), e)
    return tables.lookup(profiles, e.where("action = 'kick'")).select("user_id", "username", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"))


@query(fx.with_tables("messages", "SELECT message_id, chat_id, user_id, epoch_ms(ts) AS ms, sha256(coalesce(text, '')) AS text_hash FROM messages"))
def q_topic_messages(spark, sf_dir):
    """Messages from the values of a topic's records: binary JSON, among it tombstones and what is no message."""
    m = fx.messages(spark, sf_dir)
    values = m.select(F.to_json(F.struct(*(c.split()[0] for c in io.MESSAGE.split(", ")))).cast("binary").alias("value"))
    noise = m.select(F.when(F.col("message_id") % 2 == 0, F.lit("no json")).cast("binary").alias("value"))
    return io.decode_messages(values.unionByName(noise)).select("message_id", "chat_id", "user_id", F.unix_millis("ts").alias("ms"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query(_ACT + "SELECT l.id, l.chat_id, l.message_id FROM log l ANTI JOIN actions a ON a.event_id = l.id WHERE action = 'notify' ORDER BY created_at DESC, l.id DESC LIMIT 200")
def q_pending(spark, sf_dir):
    return review.pending(fx.events(spark, sf_dir), fx.actions(spark, sf_dir)).select("id", "chat_id", "message_id")


@query(_ACT + "SELECT event_id, 'text ' || event_id AS message, CASE decision WHEN 'kick' THEN 1 ELSE 0 END AS label FROM actions")
def q_verdict_samples(spark, sf_dir):
    e, a = fx.events(spark, sf_dir), fx.actions(spark, sf_dir)
    texts = e.select(F.col("id").alias("event_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("message"))
    return review.to_samples(a, texts)


_PAYLOAD = "CASE WHEN id % 5 = 0 THEN 'kick:' || chat_id ELSE 'ham:' || chat_id || ':' || message_id || CASE WHEN id % 4 = 0 THEN ':0' WHEN id % 4 = 1 THEN ':' || id WHEN id % 4 = 2 THEN ':x' ELSE '' END END"


@query(_LOG + f", q AS (SELECT * FROM log WHERE action = 'notify'), p AS (SELECT id, {_PAYLOAD} AS payload FROM q) SELECT p.id, 'ham' AS verdict, q.id AS event_id, 1000::BIGINT * (p.id % 60) AS took_ms FROM p JOIN q USING (id) WHERE p.id % 5 <> 0 AND p.id % 4 <> 2")
def q_resolved_verdicts(spark, sf_dir):
    q = fx.events(spark, sf_dir).where("action = 'notify'")
    i = F.col("id")
    tail = F.when(i % 4 == 0, ":0").when(i % 4 == 1, F.concat(F.lit(":"), i.cast("string"))).when(i % 4 == 2, ":x").otherwise("")
    payload = F.when(i % 5 == 0, F.concat(F.lit("kick:"), F.col("chat_id").cast("string"))).otherwise(F.concat(F.lit("ham:"), F.col("chat_id").cast("string"), F.lit(":"), F.col("message_id").cast("string"), tail))
    verdicts = q.select(i.alias("id"), payload.alias("payload"), F.timestamp_micros(F.unix_micros("created_at") + i % 60 * 1_000_000).alias("performed_at"))
    out = review.resolve(review.parse_payload(verdicts), q)
    return out.select("id", "verdict", "event_id", "took_ms")


@query(_ACT + """SELECT l.chat_id, CAST(grouping(l.chat_id) AS INTEGER) AS all_chats, count(*) AS verdicts, avg(took_ms) AS avg_took_ms, avg(CASE WHEN decision = 'ham' THEN 1.0::DOUBLE ELSE 0 END) AS ham_share
    FROM log l JOIN actions a ON a.event_id = l.id WHERE action = 'notify' GROUP BY ROLLUP (l.chat_id)""")
def q_reaction_time(spark, sf_dir):
    out = review.reaction_times(fx.events(spark, sf_dir), fx.actions(spark, sf_dir))
    return out.select("chat_id", "all_chats", "verdicts", "avg_took_ms", "ham_share")


_EXACT = "sum(action_confidence::DECIMAL(18, 6))::DOUBLE / count(action_confidence)"


@query(_ACT + f"""SELECT epoch_ms(time_bucket(INTERVAL 1 hour, created_at)) AS period_ms, count(*) FILTER (WHERE action <> 'approve') AS spam_detected, count(*) FILTER (WHERE decision = 'ham') AS manual_overrides,
    {_EXACT} AS avg_spam_score, count(*) FILTER (WHERE filter_embedding_score IS NULL) AS embed_failures FROM log l LEFT JOIN actions a ON a.event_id = l.id GROUP BY 1""")
def q_metrics_hourly(spark, sf_dir):
    out = review.snapshots(fx.events(spark, sf_dir), fx.actions(spark, sf_dir))
    return out.select(F.unix_millis("period_start").alias("period_ms"), "spam_detected", "manual_overrides", "avg_spam_score", "embed_failures")


def _periods(spark, sf_dir) -> DataFrame:
    """Snapshots by hour and by day, each hour's once more from half of its events, as an earlier version."""
    e, a = fx.events(spark, sf_dir), fx.actions(spark, sf_dir)
    early = review.snapshots(e.where("id % 2 = 0"), a).withColumn("version", F.lit(1))
    return early.unionByName(review.snapshots(e, a).withColumn("version", F.lit(2))).unionByName(review.snapshots(e, a, "1 day").withColumn("version", F.lit(3)))


_SNAPSHOTS = f"""snaps AS (SELECT time_bucket(INTERVAL 1 hour, created_at) AS period_start, '1 hour' AS period, count(*) FILTER (WHERE action <> 'approve') AS spam_detected, count(*) FILTER (WHERE decision = 'ham') AS manual_overrides, {_EXACT} AS avg_spam_score, 2 AS version
    FROM log l LEFT JOIN actions a ON a.event_id = l.id GROUP BY 1 UNION ALL SELECT time_bucket(INTERVAL 1 day, created_at), '1 day', count(*) FILTER (WHERE action <> 'approve'), count(*) FILTER (WHERE decision = 'ham'), {_EXACT}, 3 FROM log l LEFT JOIN actions a ON a.event_id = l.id GROUP BY 1)"""


@query(_ACT.rstrip() + f", {_SNAPSHOTS} SELECT epoch_ms(period_start) AS period_ms, period, spam_detected, manual_overrides, avg_spam_score, version FROM snaps")
def q_metrics_upsert(spark, sf_dir):
    out = tables.last_write(_periods(spark, sf_dir), ["period_start", "period"], "version")
    return out.select(F.unix_millis("period_start").alias("period_ms"), "period", "spam_detected", "manual_overrides", "avg_spam_score", "version")


@query(_ACT.rstrip() + f", {_SNAPSHOTS} SELECT epoch_ms(period_start) AS period_ms, period, spam_detected, manual_overrides, avg_spam_score, version FROM snaps")
def q_metrics_stored(spark, sf_dir):
    """Snapshots put into a stored table by batches: the final ones, these again, and earlier ones that come late."""
    path, p = f"{_folder(spark, sf_dir)}/metrics", _periods(spark, sf_dir)
    for batch in ("version = 2", "version = 2 and period = '1 hour'", "version = 1", "true"):
        io.upsert(p.where(batch), path, ["period_start", "period"], "period_start")
    return io.read_upserted(spark, path).select(F.unix_millis("period_start").alias("period_ms"), "period", "spam_detected", "manual_overrides", "avg_spam_score", "version")


@query(_ACT.rstrip() + f", {_SNAPSHOTS} SELECT epoch_ms(period_start) AS period_ms, spam_detected, avg_spam_score FROM snaps WHERE period = '1 hour' ORDER BY period_start DESC LIMIT 30")
def q_recent_snapshots(spark, sf_dir):
    hours = tables.last_write(_periods(spark, sf_dir), ["period_start", "period"], "version").where("period = '1 hour'")
    return tables.recent(hours, "period_start", "version", 30).select(F.unix_millis("period_start").alias("period_ms"), "spam_detected", "avg_spam_score")


@query(_LOG + "SELECT chat_id, strftime(created_at, '%Y-%m-%d') AS day, action, CAST(grouping(chat_id, strftime(created_at, '%Y-%m-%d'), action) AS INTEGER) AS level, count(*) AS n FROM log GROUP BY ROLLUP (chat_id, strftime(created_at, '%Y-%m-%d'), action)")
def q_action_rollup(spark, sf_dir):
    return review.action_mix(fx.events(spark, sf_dir))


@query(_SET + "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM settings_log) WHERE n = 1 AND NOT deleted")
def q_settings_state(spark, sf_dir):
    return tables.settings_state(fx.settings_log(spark, sf_dir))


_EFFECTIVE = """, state AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM settings_log) WHERE n = 1 AND NOT deleted),
    base AS (SELECT * FROM (VALUES ('policy_mode', 'semi-auto', NULL), ('meta_notify', NULL, 0.65::DOUBLE), ('meta_delete', NULL, 0.85), ('meta_kick', NULL, 0.95), ('meta_downweight_announcement', NULL, 0.85), ('meta_downweight_reply_to_staff', NULL, 0.9), ('meta_downweight_whitelist', NULL, 0.85)) t(key, text, number)),
    new AS (SELECT base.key, CASE WHEN base.text IS NOT NULL AND value LIKE '"%"' THEN replace(lower(trim(trim(value, '"'))), '_', '-') END AS t, CASE WHEN base.text IS NULL THEN TRY_CAST(value AS DOUBLE) END AS n, base.text AS bt, base.number AS bn FROM state JOIN base USING (key)),
    checked AS (SELECT *, CASE WHEN t IS NULL AND n IS NULL THEN 'undecodable' WHEN t IN ('manual', 'semi-auto', 'auto', 'legacy-manual') OR n BETWEEN 0 AND 1 THEN 'ok' ELSE 'rejected' END AS verdict, coalesce(t = bt, abs(n - bn) <= greatest(1e-6 * greatest(abs(n), abs(bn)), 1e-9)) AS is_default FROM new),
    ok AS (SELECT * FROM checked WHERE verdict = 'ok' AND NOT is_default),
    eff AS (SELECT base.key, coalesce(ok.t, base.text) AS text, coalesce(ok.n, base.number) AS number, ok.key IS NOT NULL AS overridden FROM base LEFT JOIN ok USING (key))"""


def _settings(spark, sf_dir) -> DataFrame:
    return settings.effective(tables.settings_state(fx.settings_log(spark, sf_dir)), settings.defaults(spark))


@query(_SET.rstrip() + _EFFECTIVE + " SELECT * FROM eff")
def q_effective_config(spark, sf_dir):
    return _settings(spark, sf_dir)


@query(_SET.rstrip() + _EFFECTIVE + " SELECT key, verdict, CASE WHEN verdict = 'ok' THEN is_default END AS is_default FROM checked")
def q_setting_overrides(spark, sf_dir):
    """Every override of a known setting: what becomes of it, and whether it only repeats the default."""
    found = settings.checked(tables.settings_state(fx.settings_log(spark, sf_dir)), settings.defaults(spark))
    return found.select("key", "verdict", F.when(F.col("verdict") == "ok", settings.is_default(found)).alias("is_default"))


@query(fx.with_tables("settings_log", "").rstrip() + _EFFECTIVE + " SELECT (SELECT count(*) FROM state) AS removed, 0::BIGINT AS left_over, (SELECT count(*) FROM base) AS at_default")
def q_settings_reset(spark, sf_dir):
    """Every override removed by changes that follow all others."""
    log = fx.settings_log(spark, sf_dir)
    gone = settings.reset(tables.settings_state(log), F.lit(1 << 60))
    after = tables.settings_state(log.unionByName(gone))
    now = settings.effective(after, settings.defaults(spark))
    counts = gone.agg(F.count("*").alias("removed")), after.agg(F.count("*").alias("left_over")), now.agg(F.count(F.when(~F.col("overridden"), 1)).alias("at_default"))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query(_SET.rstrip() + _EFFECTIVE + """, early AS (SELECT key, value, CASE WHEN base.key IS NULL THEN 'unknown' END AS unknown FROM (SELECT key, arg_max(value, version) AS value FROM settings_log WHERE version % 5 = 0 AND value IS NOT NULL GROUP BY key) LEFT JOIN base USING (key)),
    told AS (SELECT e.key, unknown, b.text AS bt, b.number AS bn, CASE WHEN b.text IS NOT NULL AND value LIKE '"%"' THEN replace(lower(trim(trim(value, '"'))), '_', '-') END AS t, CASE WHEN b.text IS NULL THEN TRY_CAST(value AS DOUBLE) END AS n FROM early e LEFT JOIN base b USING (key))
    SELECT key, CASE WHEN unknown IS NOT NULL THEN unknown WHEN t IS NULL AND n IS NULL THEN 'undecodable' WHEN NOT coalesce(t IN ('manual', 'semi-auto', 'auto', 'legacy-manual'), n BETWEEN 0 AND 1) THEN 'rejected'
        WHEN coalesce(t = eff.text, abs(n - eff.number) <= 1e-9) THEN 'unchanged' WHEN coalesce(t = bt, abs(n - bn) <= 1e-9) THEN 'removed' ELSE 'set' END AS outcome FROM told LEFT JOIN eff USING (key)""")
def q_setting_changes(spark, sf_dir):
    """What becomes of the last value of each setting among every fifth change, if it is asked for now."""
    log = fx.settings_log(spark, sf_dir)
    asked = log.where("version % 5 = 0 and value is not null").groupBy("key").agg(F.max_by("value", "version").alias("value"))
    return settings.changes(asked, tables.settings_state(log), settings.defaults(spark))


@query(_SET.rstrip() + _EFFECTIVE + """ SELECT key AS name, coalesce(text, printf('%.4f', number)) AS value, overridden FROM eff
    UNION ALL SELECT * FROM (VALUES ('meta_downweight_brand', '0.7000', false), ('degraded_step', '0.0500', false), ('legacy_keyword', '0.6000', false), ('legacy_tfidf', '0.6500', false))""")
def q_thresholds(spark, sf_dir):
    return settings.threshold_view(_settings(spark, sf_dir))


@query(_LOG + "SELECT id, array_to_string([x::VARCHAR FOR x IN [user_id, id % 10] IF x > 3], ',') AS ids, id % 5 IN (0, 1, 2) AS truth FROM log")
def q_parsed_defaults(spark, sf_dir):
    """Lists of numbers and truth words, as they may be written in a configuration."""
    i = F.col("id")
    number = lambda c: F.when(c > 3, c.cast("string")).otherwise("x")
    raw = F.concat(number(F.col("user_id")), F.lit(" , "), number(i % 10), F.lit(",;"))
    word = F.element_at(F.array(*map(F.lit, (" YES", "1", "On ", "no", ""))), (i % 5 + 1).cast("int"))
    return fx.events(spark, sf_dir).select("id", F.array_join(settings.int_list(raw).cast("array<string>"), ",").alias("ids"), settings.truth(word).alias("truth"))


_DECIDED = """, adjusted AS (SELECT *, meta_proba * (CASE WHEN has_metadata AND is_channel_announcement THEN meta_downweight_announcement ELSE 1 END) * (CASE WHEN has_metadata AND reply_to_staff THEN meta_downweight_reply_to_staff ELSE 1 END)
    * (CASE WHEN has_metadata AND hits_store + hits_order + hits_brand > 0 THEN meta_downweight_whitelist ELSE 1 END) * (CASE WHEN has_metadata AND hits_brand > 0 THEN 0.7::DOUBLE ELSE 1 END) AS p,
    meta_notify + CASE WHEN degraded_ctx THEN 0.05::DOUBLE ELSE 0 END AS notify, kw_score >= 0.6 OR tfidf_score >= 0.65 AS old FROM ruled)
    SELECT id, policy_mode AS mode, CASE WHEN policy_mode = 'legacy-manual' OR meta_proba IS NULL THEN CASE WHEN old THEN 'notify' ELSE 'approve' END WHEN policy_mode = 'auto' AND p >= meta_kick THEN 'kick' WHEN policy_mode IN ('semi-auto', 'auto') AND p >= meta_delete THEN 'delete'
    WHEN p >= notify THEN 'notify' ELSE 'approve' END AS action, round(CASE WHEN policy_mode <> 'legacy-manual' THEN p ELSE meta_proba END, 9) AS p_adjusted FROM adjusted"""
_ROW = ", row AS (SELECT " + ", ".join(f"max({'text' if k == 'policy_mode' else 'number'}) FILTER (WHERE key = '{k}') AS {k}" for k in SETTINGS) + " FROM eff)"


def _decide(rows: DataFrame) -> DataFrame:
    """Decisions of scores that have the columns of a policy row."""
    rules = P.policy_of()
    seen = lambda c, none: F.when(F.col("has_metadata"), F.col(c)).otherwise(none)
    applied = P.downweights(*(seen(c, F.lit(False)) for c in ("is_channel_announcement", "reply_to_staff")), *(seen(c, F.lit(0)) for c in ("hits_store", "hits_order", "hits_brand")), rules)
    d = P.decide(rules.mode, F.col("meta_proba"), F.col("kw_score"), F.col("tfidf_score"), applied, F.col("degraded_ctx"), rules)
    return rows.withColumn("d", d).select("id", F.col("policy_mode").alias("mode"), F.col("d.action").alias("action"), F.round("d.p_adjusted", 9).alias("p_adjusted"))


@query(fx.with_tables("scores settings_log", "").rstrip() + _EFFECTIVE + _ROW + ", ruled AS (SELECT * FROM scores CROSS JOIN row)" + _DECIDED)
def q_policy_in_force(spark, sf_dir):
    """Decisions under the settings in force."""
    row = settings.policy_row(_settings(spark, sf_dir))
    return _decide(fx.scores(spark, sf_dir).crossJoin(F.broadcast(row)))  # one row


@query(fx.with_tables("scores settings_log chats", "").rstrip() + _EFFECTIVE + _ROW + """, own AS (SELECT c.chat_id, CASE WHEN c.policy_mode IN ('manual', 'semi-auto', 'auto', 'legacy-manual') THEN c.policy_mode ELSE r.policy_mode END AS policy_mode, coalesce(c.meta_notify, r.meta_notify) AS meta_notify,
    CASE WHEN c.meta_delete BETWEEN 0 AND 1 THEN c.meta_delete ELSE r.meta_delete END AS meta_delete, meta_kick, meta_downweight_announcement, meta_downweight_reply_to_staff, meta_downweight_whitelist FROM chats c CROSS JOIN row r),
    ruled AS (SELECT * FROM scores JOIN own ON own.chat_id = scores.id % 8)""" + _DECIDED)
def q_chat_policies(spark, sf_dir):
    """Decisions under each chat's own settings over those in force."""
    own = settings.chat_policies(fx.chats(spark, sf_dir), _settings(spark, sf_dir))
    return _decide(fx.scores(spark, sf_dir).withColumn("chat_id", F.col("id") % 8).join(own, "chat_id"))


@query(fx.with_tables("messages log", "").rstrip() + """, kept AS (SELECT message_id, chat_id, user_id, chat_id % 8 AS c, trim(coalesce(nullif(text, ''), caption, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS body FROM messages WHERE user_id IS NOT NULL AND chat_id <> 24),
    trusted AS (SELECT DISTINCT chat_id, 1000 + user_id % 40 AS user_id FROM log WHERE action = 'approve' AND id % 50 = 0) SELECT message_id, chat_id, user_id FROM kept k WHERE body <> '' AND NOT EXISTS (SELECT 1 FROM trusted t WHERE t.chat_id = k.chat_id AND t.user_id = k.user_id)""")
def q_chat_whitelists(spark, sf_dir):
    """Messages that pass gates whose whitelist is each chat's own."""
    trusted = fx.events(spark, sf_dir).where("action = 'approve' and id % 50 = 0").select("chat_id", (1000 + F.col("user_id") % 40).alias("user_id")).distinct()
    return gates.gate(fx.messages(spark, sf_dir), trusted, fx.MODERATOR_CHAT).select("message_id", "chat_id", "user_id")


# tables on disk: written, and read again
def _folder(spark: SparkSession, sf_dir: str) -> str:
    return job_folder(spark, "tables")


@query(fx.with_tables("labelled", "SELECT sha256(message) AS message_hash, label FROM labelled"))
def q_read_labelled(spark, sf_dir):
    path = f"{_folder(spark, sf_dir)}/samples"
    io.write_labelled(fx.labelled(spark, sf_dir), path)
    return io.read_labelled(spark, path).select(F.sha2("message", 256).alias("message_hash"), "label")


@query(fx.with_tables("labelled", "SELECT count(*) AS rows, true AS has_size FROM labelled"))
def q_dataset_stats(spark, sf_dir):
    path = f"{_folder(spark, sf_dir)}/samples"
    io.write_labelled(fx.labelled(spark, sf_dir), path)
    return io.dataset_stats(spark, path).select("rows", (F.col("kib") >= 0).alias("has_size"))


@query(fx.with_tables("gated", "").rstrip() + f", terms AS (SELECT unnest({fx._sql_list(KEYWORDS)}) AS term) SELECT term, count(*) AS messages FROM gated JOIN terms ON contains(lower(body), lower(term)) GROUP BY term")
def q_lexicon(spark, sf_dir):
    """Messages of each keyword of a lexicon file."""
    path = f"{_folder(spark, sf_dir)}/lexicon"
    io.write_lexicon(spark, KEYWORDS, PATTERNS, path)
    terms = io.read_lexicon(spark, path).where("kind = 'keyword'")
    return lexicon.term_counts(gated(spark, sf_dir), lexicon.terms_of(terms), "message_id", "body").withColumnRenamed("hits", "messages")


@query(fx.with_tables("gated", "SELECT message_id, sha256(body) AS body_hash FROM gated"))
def q_message_source(spark, sf_dir):
    """Messages read as they come from a feed of files, in a stream, then gated."""
    path = f"{_folder(spark, sf_dir)}/messages"
    fx.messages(spark, sf_dir).write.parquet(path)
    fed = run_to_table(io.message_stream(spark, path))
    return gates.gate(fed, fx.whitelist(spark), fx.MODERATOR_CHAT).select("message_id", F.sha2("body", 256).alias("body_hash"))


@query(_LOG + "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE action = 'approve') AS approved FROM log GROUP BY 1")
def q_event_sink(spark, sf_dir):
    """The log after two appends, and after a micro-batch that came twice."""
    folder, e = _folder(spark, sf_dir), fx.events(spark, sf_dir)
    for k in (0, 1):
        io.append_events(e.where(F.col("id") % 3 == k), f"{folder}/log")
    for _ in range(2):
        io.write_once(e.where("id % 3 = 2"), 7, f"{folder}/batches")
    both = io.read_events(spark, f"{folder}/log").select("id", "created_at", "action").unionByName(spark.read.parquet(f"{folder}/batches").select("id", "created_at", "action"))
    return both.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count(F.when(F.col("action") == "approve", 1)).alias("approved"))


@query(_ACT + "SELECT event_id, decision, CAST(row_number() OVER (PARTITION BY event_id ORDER BY performed_at, id) AS INTEGER) AS place FROM (SELECT * FROM actions UNION ALL SELECT id + 1000000000, event_id, moderator_id, 'delete', performed_at - INTERVAL 1 second, took_ms FROM actions WHERE id % 5 = 0) JOIN (SELECT id AS event_id FROM log WHERE chat_id = 3) USING (event_id)")
def q_verdict_log(spark, sf_dir):
    """All verdicts on one chat's events, unknown ones included, in order, from a log of two appends."""
    path, a = f"{_folder(spark, sf_dir)}/actions", fx.actions(spark, sf_dir)
    io.append_actions(a, path)
    io.append_actions(a.where("id % 5 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "decision": F.lit("delete"), "performed_at": F.col("performed_at") - F.expr("interval 1 second")}), path)
    return tables.actions_for(spark.read.parquet(path), fx.events(spark, sf_dir).where("chat_id = 3")).select("event_id", "decision", "place")


@query(_LOG + "SELECT moderator_id, decision, count(*) AS n, CAST(sum(took_ms) AS BIGINT) AS took_ms FROM (SELECT 1 + id % 3 AS moderator_id, CASE WHEN id % 3 = 1 THEN 'kick' ELSE 'ham' END AS decision, 1000 * (id % 120) AS took_ms FROM log WHERE action = 'notify' AND id % 3 <> 0) GROUP BY ALL")
def q_overrides(spark, sf_dir):
    return fx.actions(spark, sf_dir).groupBy("moderator_id", "decision").agg(F.count("*").alias("n"), F.sum("took_ms").alias("took_ms"))


_I = _LOG.rstrip() + ", i AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS spam_id FROM log WHERE action <> 'approve') ORDER BY spam_id DESC LIMIT 500) "


@query(_I + "SELECT a.spam_id, i.id, i.action, (SELECT min(spam_id) FROM i) AS least, (SELECT max(spam_id) FROM i) AS most FROM (SELECT DISTINCT spam_id - 250 AS spam_id FROM i) a LEFT JOIN i USING (spam_id)")
def q_incident_lookup(spark, sf_dir):
    """Half of the numbers asked for are there."""
    found = written(tables.incidents(fx.events(spark, sf_dir)), "incidents")
    return tables.incident_lookup(found, found.select(F.col("spam_id") - 250).toDF("spam_id")).select("spam_id", "id", "action", "least", "most")


@query(_CTX + "SELECT message_id, chat_id, user_id, sha256(norm) AS norm_hash FROM ctx")
def q_compact(spark, sf_dir):
    """Events as they are kept for a list: what only the analysis needs is gone."""
    rows = with_history(spark, sf_dir).select("message_id", "chat_id", "user_id", F.sha2("norm", 256).alias("norm_hash"), "chat_history", "user_history")
    return tables.compact(rows.withColumns({"ctx_capsule": F.lit("x"), "msg_vec": F.array(F.lit(0.5)), "embedding_ms": F.lit(1), "features": F.array(F.lit(0.5))}))


_ART = fx.with_tables("vectors", "").rstrip()


@query(f"{_ART}, m AS (SELECT is_spam::VARCHAR AS name, pos, avg(x) AS x FROM (SELECT is_spam, unnest(vec) AS x, unnest(range(1, 65)) AS pos FROM vectors WHERE vec IS NOT NULL) GROUP BY ALL UNION ALL SELECT family, pos, avg(x) FROM (SELECT family, unnest(vec) AS x, unnest(range(1, 65)) AS pos FROM vectors WHERE vec IS NOT NULL) GROUP BY ALL)"
       " SELECT name, round(sum(x), 6) AS total, true AS model_is_the_same FROM m GROUP BY name")
def q_artefacts(spark, sf_dir):
    """Centroids, prototypes and a model, saved and loaded again."""
    v = fx.vectors(spark, sf_dir)
    rows = vectors.with_vectors(v).select(F.col("vec").alias("features"), F.col("is_spam").alias("label"))
    model = training.fit_logistic(rows, max_iter=20)
    path = f"{_folder(spark, sf_dir)}/artefacts"
    io.save_artefacts(vectors.mean_vectors(v, "is_spam"), vectors.mean_vectors(v, "family"), model, path)
    centroids, prototypes, loaded = io.load_artefacts(spark, path)
    same = training.predict(rows, loaded).agg(F.max(F.abs(F.col("p_spam") - 1 / (1 + F.exp(-training.raw_score(F.col("features"), model))))).alias("off")).select((F.col("off") < 1e-9).alias("model_is_the_same"))
    both = centroids.select(F.col("is_spam").cast("string").alias("name"), "vec").unionByName(prototypes.select(F.col("family").alias("name"), "vec"))
    return both.select("name", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total")).crossJoin(F.broadcast(same))  # one row


@query(fx.with_tables("scores", "SELECT id, kw_score, tfidf_score, label, true AS other_sizes_are_ignored FROM scores"))
def q_score_cache(spark, sf_dir):
    """Scores from a cache, which counts only if it has as many rows as the data."""
    path = f"{_folder(spark, sf_dir)}/scores"
    s = fx.scores(spark, sf_dir).select("id", "kw_score", "tfidf_score", "label")
    s.write.parquet(path)
    n = s.count()
    return io.cached_scores(spark, path, n).withColumn("other_sizes_are_ignored", F.lit(io.cached_scores(spark, path, n + 1) is None))


# streams: the tables as files, read to their end
def _stream(spark: SparkSession, sf_dir: str, table: str, derive) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", "false")
    if _is_file(spark, path):  # a stream reads folders: of this one, the table's file alone
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return derive(reader.parquet(path))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _event_stream(raw: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "click", "notify").when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "kick").otherwise("approve")
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 8).alias("chat_id"), action.alias("action"), F.when(F.col("event_type") != "error", 0.5).alias("filter_embedding_score"))


@query(_LOG + "SELECT epoch_ms(time_bucket(INTERVAL 1 hour, created_at)) AS period_ms, count(*) FILTER (WHERE action <> 'approve') AS spam_detected, count(*) FILTER (WHERE filter_embedding_score IS NULL) AS embed_failures FROM log GROUP BY 1")
def q_stream_metrics(spark, sf_dir):
    out = run_to_table(jobs.stream_snapshots(_stream(spark, sf_dir, "events", _event_stream)), "complete")
    return out.select(F.unix_millis("period_start").alias("period_ms"), "spam_detected", "embed_failures")


@query(_LOG + "SELECT id, chat_id, 'ham' AS decision FROM log WHERE action = 'notify' AND id % 3 = 2")
def q_stream_verdicts(spark, sf_dir):
    def verdicts(raw):
        e = _event_stream(raw).where((F.col("action") == "notify") & (F.col("id") % 3 == 2))
        return e.select(F.col("id").alias("event_id"), F.timestamp_micros(F.unix_micros("created_at") + F.col("id") % 120 * 1_000_000).alias("performed_at"), F.lit("ham").alias("decision"))

    events = _stream(spark, sf_dir, "events", _event_stream).where("action = 'notify'")
    return run_to_table(jobs.stream_verdicts(events, _stream(spark, sf_dir, "events", verdicts)))


def _message_stream(raw: DataFrame) -> DataFrame:
    mid = F.col("conv_id") * 10 + F.col("turn")
    return raw.select(mid.alias("message_id"), (F.col("conv_id") % 25).alias("chat_id"), F.timestamp_seconds(F.lit(1704067200) + mid * 60).alias("ts"), F.md5("text").alias("norm"))


@query("""WITH m AS (SELECT conv_id * 10 + turn AS message_id, conv_id % 25 AS chat_id, md5(text) AS norm FROM conversations),
    h AS (SELECT *, coalesce(list(norm) OVER (PARTITION BY chat_id ORDER BY message_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), []) AS held FROM m)
    SELECT chat_id, message_id, CAST(len(held) AS INTEGER) AS history_size, array_to_string(list_reverse(held)[1:4], '|') AS last_texts FROM h""")
def q_stream_history(spark, sf_dir):
    return run_to_table(jobs.stream_history(_stream(spark, sf_dir, "conversations", _message_stream)), "update")


def _user_stream(raw: DataFrame) -> DataFrame:
    return _message_stream(raw).withColumn("user_id", 1000 + F.col("message_id") % 40)


@query("""WITH m AS (SELECT conv_id * 10 + turn AS message_id, 1000 + (conv_id * 10 + turn) % 40 AS user_id, md5(text) AS norm FROM conversations),
    h AS (SELECT *, coalesce(list(norm) OVER (PARTITION BY user_id ORDER BY message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS held FROM m)
    SELECT user_id, message_id, CAST(len(held) AS INTEGER) AS history_size, array_to_string(list_reverse(held)[1:5], '|') AS last_texts FROM h""")
def q_stream_user_history(spark, sf_dir):
    out = jobs.stream_history(_stream(spark, sf_dir, "conversations", _user_stream), USER_HISTORY, key="user_id", shown=USER_CONTEXT)
    return run_to_table(out, "update")


@query("SELECT DISTINCT conv_id * 10 + turn AS message_id, conv_id % 25 AS chat_id FROM conversations")
def q_stream_dedup(spark, sf_dir):
    twice = lambda raw: _message_stream(raw).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_to_table(jobs.stream_distinct(_stream(spark, sf_dir, "conversations", twice))).select("message_id", "chat_id")


@query(_CTX + "SELECT count(*) AS messages, CAST(sum(len(ch)) AS BIGINT) AS chat_rows, CAST(sum(len(uh)) AS BIGINT) AS user_rows, CAST(sum(len(cc)) AS BIGINT) AS chat_context, CAST(sum(len(uc)) AS BIGINT) AS user_context FROM ctx")
def q_history_totals(spark, sf_dir):
    h = history.with_history(history.normalized(gated(spark, sf_dir)))
    size = lambda c: F.sum(F.size(c)).cast("long")
    return h.agg(F.count("*").alias("messages"), size("chat_history").alias("chat_rows"), size("user_history").alias("user_rows"), size(history.chat_context(F.col("chat_history"), F.col("user_id"))).alias("chat_context"), size(history.user_context(F.col("user_history"))).alias("user_context"))
