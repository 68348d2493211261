"""Moderation tables derived from the given tables, in Spark.

Each function has a twin in SQL below, so that queries can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlark.config import LEGIT_FAMILIES, SPAM_FAMILIES

WHITELIST = (1, 2, 3)
MODERATOR_CHAT = 24
# What is appended to a message, by its number modulo 13.
SNIPPETS = (
    " Заработок от 500$ в день, пиши + в ЛС", " Удалёнка 18+, доход 15к, без вложений", " Казино: фриспины и ставки, выигрыш 1000 руб https://t.me/luckyslot", " Звоните +7(912)345-67-89",
    " Почта a@ya.ru или anna@mail.example.com", " Где мой заказ? Доставка пиццы, магазин на сайте", " Пассивный доход: крипта и трейдинг, https://bit.ly/x1", " Скидка 20 процентов на товар бренда acmeshop",
    " зaрабoтoк 3aмена а1б", " от 18 лет, 21+ и 30 года", " @manager t.me/channel_1 www.site.example", "", " жми сюда",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in WHITELIST], "user_id long")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages from ``conversations``."""
    c = _table(spark, sf_dir, "conversations")
    mid = F.col("conv_id") * 10 + F.col("turn")
    who = F.when(F.col("role") == "user", 1000 + F.col("conv_id") % 40).when(F.col("role") == "assistant", 1 + F.col("conv_id") % 3).when(F.col("role") == "system", 900)
    user = F.when(mid % 97 != 0, who).cast("long")
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (mid % 13 + 1).cast("int"))
    text = F.when(mid % 29 == 0, None).when(mid % 31 == 0, "   ").otherwise(F.concat("text", snippet))
    chat = F.col("conv_id") % 25
    return c.select(
        mid.alias("message_id"), chat.alias("chat_id"), F.timestamp_seconds(F.lit(1704067200) + mid * 60).alias("ts"), user.alias("user_id"), F.concat(F.lit("u"), user.cast("string")).alias("username"),
        F.when(chat % 2 == 0, F.concat(F.lit("chat"), chat.cast("string"))).alias("chat_username"), text.alias("text"), F.when(mid % 29 == 0, F.col("text")).alias("caption"), (mid % 11 == 0).alias("is_forwarded"),
        F.when(F.col("role") == "system", "channel").alias("sender_chat_type"), F.lag(user).over(Window.partitionBy("conv_id").orderBy("turn")).alias("reply_to_user_id"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, message, label)`` from documents with a toxicity label."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("message"), F.col("toxic").cast("int").alias("label"))


def labelled_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeats, contradictions and empty messages."""
    base = labelled(spark, sf_dir)
    flipped = base.where("id % 10 = 3").select("message", (1 - F.col("label")).alias("label"))
    blank = spark.createDataFrame([(None, 0), ("  ", 1)], "message string, label int")
    pair = base.select("message", "label")
    return pair.unionByName(base.where("id % 5 = 0").select("message", "label")).unionByName(flipped).unionByName(blank)


def new_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = labelled(spark, sf_dir)
    fresh = base.where("id % 7 = 0").select(F.concat(F.lit("new "), F.col("id").cast("string")).alias("message"), "label")
    return base.where("id % 4 = 0").select("message", "label").unionByName(fresh)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, vec, family, is_spam)`` from ``embeddings``."""
    families = SPAM_FAMILIES + LEGIT_FAMILIES[:3]
    family = F.element_at(F.array(*map(F.lit, families)), (F.col("label") + 1).cast("int"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 20 != 0, F.col("embedding").cast("array<double>")).alias("vec"), family.alias("family"), (F.col("label") < len(SPAM_FAMILIES)).cast("int").alias("is_spam"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and model scores from ``events``."""
    e, i = _table(spark, sf_dir, "events"), F.col("event_id")
    kw = F.element_at(F.array(*map(F.lit, (0.0, 0.4, 0.6, 0.8, 0.95))), (i % 5 + 1).cast("int"))
    return e.select(
        i.alias("id"), kw.alias("kw_score"), F.round(F.col("value") / (F.col("value") + 50), 6).alias("tfidf_score"),
        F.when(i % 6 == 0, None).when(i % 6 == 1, 0.7).otherwise(0.5).alias("emb_score"), F.when(i % 6 != 0, 1.0).alias("emb_conf"),
        F.when(i % 10 != 0, (i * 37 % 1000) / 1000.0).alias("meta_proba"), (i % 17 != 0).alias("has_metadata"), (i % 7 == 0).alias("is_channel_announcement"), (i % 5 == 0).alias("reply_to_staff"),
        (i % 3).cast("int").alias("hits_store"), (i % 2).cast("int").alias("hits_order"), F.when(i % 11 == 0, 1).otherwise(0).alias("hits_brand"), (i % 4 == 0).alias("degraded_ctx"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("label"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moderation event log from ``events``."""
    e, i = _table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(F.col("event_type") == "click", "notify").when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "signup", "kick").otherwise("approve")
    return e.select(
        i.alias("id"), F.col("ts").cast("timestamp").alias("created_at"), (i % 8).alias("chat_id"), i.alias("message_id"), "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.sha2(F.concat(F.lit("m"), i.cast("string")), 256).alias("text_hash"), (i % 300).alias("text_length"), action.alias("action"), F.round(F.col("value") / (F.col("value") + 50), 6).alias("action_confidence"),
        F.when(F.col("event_type") != "error", 0.5).alias("filter_embedding_score"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderators' verdicts on events to review."""
    i = F.col("id")
    e = events(spark, sf_dir).where((F.col("action") == "notify") & (i % 3 != 0))
    return e.select(i.alias("id"), i.alias("event_id"), (1 + i % 3).alias("moderator_id"), F.when(i % 3 == 1, "kick").otherwise("ham").alias("decision"), F.timestamp_micros(F.unix_micros("created_at") + (i % 120) * 1_000_000).alias("performed_at"), (1000 * (i % 120)).alias("took_ms"))


#: Keys and values of settings changes, by the number of the event: valid, invalid and unknown ones.
SETTING_KEYS = ("policy_mode", "meta_notify", "meta_delete", "meta_kick", "meta_downweight_announcement", "meta_downweight_reply_to_staff", "meta_downweight_whitelist", "unknown_key")
MODE_VALUES = ('"AUTO"', '" semi_auto "', '"manual"', '"odd"', "auto")


def settings_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of settings (key, JSON value, whether removed, version), one by every event."""
    i = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, SETTING_KEYS)), (i % len(SETTING_KEYS) + 1).cast("int"))
    mode = F.element_at(F.array(*map(F.lit, MODE_VALUES)), (i % len(MODE_VALUES) + 1).cast("int"))
    per_mille = i * 7 % 1100 + 100
    number = F.when(i % 13 == 0, '"oops"').otherwise(F.concat(F.floor(per_mille / 1000).cast("string"), F.lit("."), F.lpad((per_mille % 1000).cast("string"), 3, "0")))
    return _table(spark, sf_dir, "events").select(key.alias("key"), F.when(i % 11 != 0, F.when(key == "policy_mode", mode).otherwise(number)).alias("value"), (i % 11 == 0).alias("deleted"), i.alias("version"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats of the event log with settings of their own: some modes, some thresholds out of range."""
    c = F.col("chat_id")
    n = events(spark, sf_dir).groupBy("chat_id").agg(F.count("*").alias("n"))
    mode = F.element_at(F.array(*map(F.lit, ("manual", "semi-auto", "auto", "legacy-manual", "odd"))), (c % 5 + 1).cast("int"))
    return n.select("chat_id", F.when(c != 5, mode).alias("policy_mode"), F.when(c % 3 != 0, (F.col("n") % 90 + 20) / 100.0).alias("meta_notify"), F.when(c % 4 == 1, 1.5).when(c % 4 == 2, 0.75).alias("meta_delete"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FAMILY_LIST = _sql_list(SPAM_FAMILIES + LEGIT_FAMILIES[:3])
SQL = {
    "messages": f"""
        SELECT conv_id * 10 + turn AS message_id, conv_id % 25 AS chat_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS ts, user_id, 'u' || user_id AS username,
               CASE WHEN conv_id % 25 % 2 = 0 THEN 'chat' || (conv_id % 25) END AS chat_username,
               CASE WHEN (conv_id * 10 + turn) % 29 = 0 THEN NULL WHEN (conv_id * 10 + turn) % 31 = 0 THEN '   ' ELSE text || {_sql_list(SNIPPETS)}[(conv_id * 10 + turn) % 13 + 1] END AS text,
               CASE WHEN (conv_id * 10 + turn) % 29 = 0 THEN text END AS caption, (conv_id * 10 + turn) % 11 = 0 AS is_forwarded, CASE WHEN role = 'system' THEN 'channel' END AS sender_chat_type,
               lag(user_id) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to_user_id
        FROM (SELECT *, CASE WHEN (conv_id * 10 + turn) % 97 <> 0 THEN CASE role WHEN 'user' THEN 1000 + conv_id % 40 WHEN 'assistant' THEN 1 + conv_id % 3 WHEN 'system' THEN 900 END END AS user_id FROM conversations)""",
    "gated": f"""
        SELECT * FROM (SELECT *, trim(coalesce(nullif(text, ''), caption, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS body FROM messages
        WHERE user_id IS NOT NULL AND chat_id <> {MODERATOR_CHAT} AND user_id NOT IN (1, 2, 3)) WHERE body <> ''""",
    "labelled": "SELECT d.doc_id AS id, d.text AS message, CAST(l.toxic AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id)",
    "labelled_dirty": """
        SELECT message, label FROM labelled UNION ALL SELECT message, label FROM labelled WHERE id % 5 = 0 UNION ALL SELECT message, 1 - label FROM labelled WHERE id % 10 = 3
        UNION ALL SELECT NULL, 0 UNION ALL SELECT '  ', 1""",
    "cleaned": "SELECT message, min(label) AS label FROM labelled_dirty WHERE message IS NOT NULL AND trim(message) <> '' GROUP BY message HAVING min(label) = max(label)",
    "vectors": f"SELECT vec_id, CASE WHEN vec_id % 20 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS vec, {_FAMILY_LIST}[label + 1] AS family, CAST(label < 7 AS INTEGER) AS is_spam FROM embeddings",
    "scores": """
        SELECT event_id AS id, [0.0, 0.4, 0.6, 0.8, 0.95][event_id % 5 + 1]::DOUBLE AS kw_score, round(value / (value + 50), 6) AS tfidf_score,
               CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS emb_score, CASE WHEN event_id % 6 <> 0 THEN 1.0 END::DOUBLE AS emb_conf,
               CASE WHEN event_id % 10 <> 0 THEN (event_id * 37 % 1000)::DOUBLE / 1000 END AS meta_proba, event_id % 17 <> 0 AS has_metadata, event_id % 7 = 0 AS is_channel_announcement,
               event_id % 5 = 0 AS reply_to_staff, CAST(event_id % 3 AS INTEGER) AS hits_store, CAST(event_id % 2 AS INTEGER) AS hits_order, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS hits_brand,
               event_id % 4 = 0 AS degraded_ctx, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS label FROM events""",
    "log": """
        SELECT event_id AS id, ts AS created_at, event_id % 8 AS chat_id, event_id AS message_id, user_id, 'u' || user_id AS username, sha256('m' || event_id) AS text_hash, event_id % 300 AS text_length,
               CASE event_type WHEN 'click' THEN 'notify' WHEN 'purchase' THEN 'delete' WHEN 'signup' THEN 'kick' ELSE 'approve' END AS action, round(value / (value + 50), 6) AS action_confidence,
               CASE WHEN event_type <> 'error' THEN 0.5 END AS filter_embedding_score FROM events""",
    "actions": """
        SELECT id, id AS event_id, 1 + id % 3 AS moderator_id, CASE WHEN id % 3 = 1 THEN 'kick' ELSE 'ham' END AS decision, created_at + to_seconds(id % 120) AS performed_at, 1000 * (id % 120) AS took_ms
        FROM log WHERE action = 'notify' AND id % 3 <> 0""",
    "settings_log": f"""
        SELECT key, CASE WHEN version % 11 <> 0 THEN CASE WHEN key = 'policy_mode' THEN {_sql_list(MODE_VALUES)}[version % {len(MODE_VALUES)} + 1]
               WHEN version % 13 = 0 THEN '"oops"' ELSE (m // 1000) || '.' || lpad((m % 1000)::VARCHAR, 3, '0') END END AS value, version % 11 = 0 AS deleted, version
        FROM (SELECT event_id AS version, event_id * 7 % 1100 + 100 AS m, {_sql_list(SETTING_KEYS)}[event_id % {len(SETTING_KEYS)} + 1] AS key FROM events)""",
    "chats": """
        SELECT chat_id, CASE WHEN chat_id <> 5 THEN ['manual', 'semi-auto', 'auto', 'legacy-manual', 'odd'][chat_id % 5 + 1] END AS policy_mode,
               CASE WHEN chat_id % 3 <> 0 THEN (n % 90 + 20)::DOUBLE / 100 END AS meta_notify, CASE chat_id % 4 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE END AS meta_delete
        FROM (SELECT chat_id, count(*) AS n FROM log GROUP BY chat_id)""",
}
_NEEDS = {"gated": ["messages"], "labelled_dirty": ["labelled"], "cleaned": ["labelled", "labelled_dirty"], "actions": ["log"], "chats": ["log"]}


def with_tables(names: str, select: str) -> str:
    """A query after the definitions of the fixture tables that it names."""
    need: list[str] = []
    for name in names.split():
        need += [n for n in [*_NEEDS.get(name, []), name] if n not in need]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in need) + "\n" + select
