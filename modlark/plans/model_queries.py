"""Queries over labelled samples, vectors, scores and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.config import BRAND_TERMS, LEGIT_FAMILIES, ORDER_TERMS, SPAM_FAMILIES, STORE_TERMS
from modlark.functions import policy as P
from modlark.functions import text as T
from modlark.operators import bayes, evaluation, gates, history, keywords, tables, training, vector_index, vectors
from modlark.operators.exact_split import exact_split
from modlark.plans.message_queries import _HIST, _LADDER, _NORM, _ODD, _PATTERN_SQL, _SCORED, _hits, gated, sql_normalize, with_history
from modlark.plans.message_queries import _WORDS as _BODY_WORDS
from modlark.plans.registry import query
from modlark.sources import fixtures as fx
from modlark.sources import models
from modlark.sources.shared import job_folder, written


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.clean(fx.labelled_dirty(spark, sf_dir))


@query(fx.with_tables("cleaned", "SELECT sha256(message) AS message_hash, label FROM cleaned"))
def q_clean_dataset(spark, sf_dir):
    return cleaned(spark, sf_dir).select(F.sha2("message", 256).alias("message_hash"), "label")


@query(fx.with_tables("cleaned", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share, count(*) >= 30 AS enough FROM cleaned GROUP BY label"))
def q_class_balance(spark, sf_dir):
    return training.class_balance(cleaned(spark, sf_dir)).withColumn("share", F.round("share", 6))


_NEW = """given AS (SELECT message, label FROM labelled WHERE id % 4 = 0 UNION ALL SELECT 'new ' || id, label FROM labelled WHERE id % 7 = 0)
    SELECT DISTINCT sha256(message) AS message_hash, label FROM given g WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.message = g.message AND l.label = g.label)"""


@query(fx.with_tables("labelled", "").rstrip() + ", " + _NEW)
def q_append_samples(spark, sf_dir):
    out = tables.new_samples(fx.labelled(spark, sf_dir), fx.new_samples(spark, sf_dir))
    return out.select(F.sha2("message", 256).alias("message_hash"), "label")


@query(fx.with_tables("cleaned", "SELECT sha256(message) AS message_hash, label FROM cleaned WHERE label = 1 AND length(message) BETWEEN 50 AND 300 ORDER BY sha256(message || 'examples'), message LIMIT 12"))
def q_examples(spark, sf_dir):
    return training.examples(cleaned(spark, sf_dir), 12, 50, 300, "examples").select(F.sha2("message", 256).alias("message_hash"), "label")


@query(fx.with_tables("cleaned", "SELECT CASE WHEN ('0x' || left(sha256(message || '#42'), 8))::UBIGINT < 3435973836 THEN 'train' ELSE 'test' END AS part, label, count(*) AS n FROM cleaned GROUP BY ALL"))
def q_split(spark, sf_dir):
    return training.split(cleaned(spark, sf_dir)).groupBy("part", "label").agg(F.count("*").alias("n"))


@query(fx.with_tables("labelled_dirty", "").rstrip() + """, placed AS (SELECT sha256(coalesce(message, '')) AS message_hash, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256(coalesce(message, '') || '#42')) <= round(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS part FROM labelled_dirty)
    SELECT message_hash, label, part, count(*) AS n FROM placed GROUP BY ALL""")
def q_exact_split(spark, sf_dir):
    """Four fifths of each class, exactly; copies of a message may be in both parts."""
    out = exact_split(fx.labelled_dirty(spark, sf_dir))
    return out.groupBy(F.sha2(F.coalesce("message", F.lit("")), 256).alias("message_hash"), "label", "part").agg(F.count("*").alias("n"))


_WORDS = r"regexp_extract_all(lower(message), '[\p{L}\p{N}_]{2,}')"


def _counts_sql(name: str, docs: str) -> str:
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_WORDS}) AS term FROM {docs}) GROUP BY id, term)"


def _fit_sql(docs: str, upto: int = 4) -> str:
    """CTEs of a model of labelled documents: counts, idf, weighted, theta."""
    parts = (
        _counts_sql("counts", docs),
        f"idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1.0 AS idf FROM counts GROUP BY term)",
        "raw AS (SELECT id, term, tf * idf AS w FROM counts JOIN idf USING (term)), weighted AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)",
        f"""grid AS (SELECT t.term, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT term FROM weighted) t CROSS JOIN (SELECT DISTINCT label FROM {docs}) l
    LEFT JOIN (SELECT term, label, sum(w) AS n FROM weighted JOIN {docs} USING (id) GROUP BY term, label) s ON s.term = t.term AND s.label = l.label),
    theta AS (SELECT label, term, ln(n + 1) - ln(sum(n) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label)) AS theta FROM grid)""",
    )
    return ", ".join(parts[:upto])


def _score_sql(docs: str, fitted: str) -> str:
    """CTEs that end in ``judged (id, p_spam, confidence)``."""
    return f"""{_counts_sql("asked", docs)}, asked_raw AS (SELECT id, term, tf * idf AS w FROM asked JOIN idf USING (term)), asked_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM asked_raw),
    joint AS (SELECT d.id, c.label, coalesce(s, 0) + ln(c.n / (SELECT count(*) FROM {fitted})) AS s FROM {docs} d CROSS JOIN (SELECT label, count(*) AS n FROM {fitted} GROUP BY label) c
    LEFT JOIN (SELECT id, t.label, sum(w * theta) AS s FROM asked_w JOIN theta t USING (term) GROUP BY id, t.label) x ON x.id = d.id AND x.label = c.label),
    top AS (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM joint),
    judged AS (SELECT id, sum(CASE WHEN label = 1 THEN exp(s - m) ELSE 0 END) / sum(exp(s - m)) AS p_spam, 1 / sum(exp(s - m)) AS confidence FROM top GROUP BY id)"""


def _base(upto: int) -> str:
    return fx.with_tables("labelled", "").rstrip() + ", " + _fit_sql("labelled", upto) + " "


def _counted(spark, sf_dir):
    """Labelled documents, how many there are, and their term counts, which are written once."""
    docs = fx.labelled(spark, sf_dir)
    return docs, docs.count(), written(bayes.term_counts(docs, "id", "message"), "counts")


@query(_base(2) + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def q_idf(spark, sf_dir):
    _, n, counts = _counted(spark, sf_dir)
    return bayes.idf(counts, n).withColumn("idf", F.round("idf", 6))


@query(_base(3) + "SELECT id, term, round(w, 6) AS w FROM weighted")
def q_tfidf(spark, sf_dir):
    _, n, counts = _counted(spark, sf_dir)
    return bayes.tfidf(counts, written(bayes.idf(counts, n), "idf")).withColumn("w", F.round("w", 6))


@query(_base(4) + "SELECT label, term, round(theta, 6) AS theta FROM theta")
def q_nb_fit(spark, sf_dir):
    docs, n, counts = _counted(spark, sf_dir)
    w = bayes.tfidf(counts, written(bayes.idf(counts, n), "idf"))
    return bayes.fit_terms(w, docs.select("id", "label")).withColumn("theta", F.round("theta", 6))


def _fitted(spark, sf_dir):
    """The model of all labelled documents: terms, written, and priors."""
    docs, n, counts = _counted(spark, sf_dir)
    terms, priors = bayes.fit(docs, counts, n)
    return docs, counts, written(terms, "terms"), priors


def _loaded(spark, sf_dir):
    """Terms and priors of that model, from where it was stored when it was last fitted to the same files."""

    def fit(path: str) -> None:
        _, _, terms, priors = _fitted(spark, sf_dir)
        terms.write.parquet(f"{path}/terms")
        priors.write.parquet(f"{path}/priors")

    path = models.stored(fx.labelled(spark, sf_dir), "bayes", fit)
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/priors")


@query(_base(4) + ", " + _score_sql("labelled", "labelled") + " SELECT id, round(p_spam, 6) AS p_spam, round(confidence, 6) AS confidence FROM judged")
def q_nb_score(spark, sf_dir):
    docs, counts, terms, priors = _fitted(spark, sf_dir)
    out = bayes.score(docs.select("id"), counts, terms, priors)
    return out.select("id", F.round("p_spam", 6).alias("p_spam"), F.round("confidence", 6).alias("confidence"))


@query(fx.with_tables("labelled", "SELECT id, 0.5::DOUBLE AS p_spam, 0.0::DOUBLE AS confidence FROM labelled"))
def q_nb_without_model(spark, sf_dir):
    """Documents before any model is there."""
    docs, counts, terms, priors = _fitted(spark, sf_dir)
    return bayes.score(docs.select("id"), counts, terms.where("df < 0"), priors.where("prior > 0"))


_PARTS = "parts AS (SELECT id, message, label, ('0x' || left(sha256(message || '#42'), 8))::UBIGINT < 3006477107 AS train FROM labelled), fitted AS (SELECT id, message, label FROM parts WHERE train), tested AS (SELECT id, message, label FROM parts WHERE NOT train)"
_REPORT = """c AS (SELECT k, count(*) FILTER (WHERE predicted = k AND label = k) AS tp, count(*) FILTER (WHERE predicted = k) AS made, count(*) FILTER (WHERE label = k) AS support FROM pred CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k),
    q AS (SELECT k::VARCHAR AS name, coalesce(tp / nullif(made, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM c),
    r AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q),
    told AS (SELECT name, precision, recall, f1, support FROM r UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)"""


@query(fx.with_tables("labelled", "").rstrip() + f", {_PARTS}, {_fit_sql('fitted')}, {_score_sql('tested', 'fitted')}, pred AS (SELECT t.label, CAST(p_spam >= 0.5 AS INTEGER) AS predicted FROM tested t JOIN judged USING (id)), {_REPORT}"
       " SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, (SELECT round(avg(CAST(predicted = label AS INTEGER)), 6) FROM pred) AS accuracy FROM told")
def q_nb_evaluation(spark, sf_dir):
    """A model of seven tenths of the labelled documents on the others."""
    docs, _, counts = _counted(spark, sf_dir)
    told = bayes.evaluate(training.split(docs, 0.7).select("id", "label", "part"), counts)
    told = written(told, "told")
    report = evaluation.class_report(told, "predicted", "label").crossJoin(evaluation.accuracy(told, "predicted", "label"))
    return report.select("name", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support", F.round("accuracy", 6).alias("accuracy"))


@query(fx.with_tables("labelled", "SELECT count(*) FILTER (WHERE id > 100) AS new_samples, count(*) FILTER (WHERE id > 100) >= 100 AS retrain FROM labelled"))
def q_retrain_gate(spark, sf_dir):
    return bayes.needs_training(fx.labelled(spark, sf_dir), 100, version_col="id")


# vectors
_MEAN = "(SELECT {0}, list(x ORDER BY pos) AS vec FROM (SELECT {0}, pos, avg(x) AS x FROM (SELECT {0}, unnest(vec) AS x, unnest(range(1, 65)) AS pos FROM vectors WHERE vec IS NOT NULL) GROUP BY {0}, pos) GROUP BY {0})"
_CENT = "cent AS " + _MEAN.format("is_spam")
_PROTO = "proto AS " + _MEAN.format("family")
_VEC = fx.with_tables("vectors", "").rstrip()


def _artefacts(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    return v, vectors.artefacts(vectors.mean_vectors(v, "is_spam"), vectors.mean_vectors(v, "family"))


@query(f"{_VEC}, {_CENT} SELECT is_spam, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, round(unnest(vec), 6) AS x FROM cent")
def q_centroids(spark, sf_dir):
    out = vectors.mean_vectors(fx.vectors(spark, sf_dir), "is_spam")
    return out.select("is_spam", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"{_VEC}, {_PROTO} SELECT family, round(list_sum(vec), 6) AS total, round(vec[1], 6) AS first FROM proto")
def q_prototypes(spark, sf_dir):
    out = vectors.mean_vectors(fx.vectors(spark, sf_dir), "family")
    return out.select("family", F.round(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.col("vec")[0], 6).alias("first"))


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE list_cosine_similarity({a}, {b}) END"


def _cos_of_joined(a: str, b: str) -> str:
    """The same by sums: the function refuses the nulls of an outer join even where it isn't used."""
    norm = lambda v: f"sqrt(list_sum([x * x FOR x IN {v}]))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE list_sum([{a}[i] * {b}[i] FOR i IN range(1, 65)]) / ({norm(a)} * {norm(b)}) END"


_SIMS = ["round({}, 6) AS sim_spam_msg".format(_cos("vec", "s")), "round({}, 6) AS sim_ham_msg".format(_cos("vec", "h")), f"round({_cos('vec', 's')} - {_cos('vec', 'h')}, 6) AS delta_msg"]
_WIDE = "wide AS (SELECT " + ", ".join([f"(SELECT vec FROM cent WHERE is_spam = {k}) AS {n}" for n, k in (("s", 1), ("h", 0))] + [f"(SELECT vec FROM proto WHERE family = '{f}') AS {f}" for f in SPAM_FAMILIES + LEGIT_FAMILIES]) + ")"


@query(f"{_VEC}, {_CENT}, {_PROTO}, {_WIDE} SELECT vec_id, {', '.join(_SIMS)}, " + ", ".join(f"round({_cos('vec', f)}, 6) AS sim_proto_{f}" for f in SPAM_FAMILIES + LEGIT_FAMILIES) + " FROM vectors CROSS JOIN wide")
def q_cosine_features(spark, sf_dir):
    v, wide = _artefacts(spark, sf_dir)
    out = vectors.similarities(v, wide, {"msg": "vec"})
    return out.select("vec_id", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith(("sim_", "delta_"))))


@query(f"{_VEC} SELECT count(*) AS total, count(vec) AS valid, round(count(vec) / count(*), 6) AS coverage, count(vec) / count(*) < 0.8 AS low FROM vectors")
def q_coverage(spark, sf_dir):
    return vectors.coverage(fx.vectors(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


_COEF = [round(0.4 - 0.02 * i if i % 2 else -0.3 + 0.01 * i, 4) for i in range(len(vectors.FEATURES))]
#: Which given vector stands for a message's text, context and user.
_VECTOR_OF = {"msg": (1, 0), "ctx": (7, 1), "user": (3, 2)}


def _features(spark, sf_dir):
    """Gated messages with all that the feature row is made of."""
    v, wide = _artefacts(spark, sf_dir)
    rows = with_history(spark, sf_dir, texts=False)
    has = {"msg": F.lit(True), "ctx": F.size(history.chat_context(F.col("chat_history"), F.col("user_id"))) > 0, "user": F.size(history.user_context(F.col("user_history"))) > 0}
    rows = rows.withColumns({f"has_{k}": cond for k, cond in has.items()}).drop("norm", "chat_history", "user_history")
    n = max(1, v.count())
    for k, (a, b) in _VECTOR_OF.items():
        of = v.select(F.col("vec_id").alias("_id"), F.col("vec").alias(f"{k}_vec"))
        rows = rows.join(of, (F.col("message_id") * a + b) % n == F.col("_id"), "left").drop("_id").withColumn(f"{k}_vec", F.when(F.col(f"has_{k}"), F.col(f"{k}_vec")))
    rows = keywords.keyword_filter(rows).withColumns(T.patterns(F.col("body"))).withColumn("kw_score", F.col("keyword_score"))
    terms, priors = _loaded(spark, sf_dir)
    told = gated(spark, sf_dir).select(F.col("message_id").alias("id"), F.col("body").alias("message"))
    judged = bayes.score(told.select("id"), written(bayes.term_counts(told, "id", "message"), "asked"), terms, priors)
    rows = rows.join(judged.select(F.col("id").alias("message_id"), F.col("p_spam").alias("tfidf_score")), "message_id", "left")
    return vectors.similarities(rows, wide, {k: f"{k}_vec" for k in _VECTOR_OF})


_FLAG_SQL = {"reply_to_staff": "coalesce(reply_to_user_id IN (1, 2, 3), false)", "is_forwarded": "is_forwarded", "author_is_admin": "user_id IN (1, 2, 3)", "is_channel_announcement": "coalesce(sender_chat_type = 'channel', false)"}
_FEATURE_SQL = (
    {f"{k}_{v}": e for v in _VECTOR_OF for k, e in (("sim_spam", _cos_of_joined(f"{v}_vec", "s")), ("sim_ham", _cos_of_joined(f"{v}_vec", "h")), ("delta", f"{_cos_of_joined(f'{v}_vec', 's')} - {_cos_of_joined(f'{v}_vec', 'h')}"))}
    | {f"sim_proto_{f}": _cos_of_joined("msg_vec", f) for f in SPAM_FAMILIES + LEGIT_FAMILIES} | {"kw_score": _LADDER, "tfidf_score": "p_spam"} | _PATTERN_SQL
    | {"obfuscation_ratio": f"len({_ODD})::DOUBLE / greatest(len({_BODY_WORDS}), 1)"} | _FLAG_SQL
    | {f"whitelist_hits_{k}": _hits(t) for k, t in (("store", STORE_TERMS), ("order", ORDER_TERMS), ("brand", BRAND_TERMS))}
)
_FEATURES_SQL = (
    fx.with_tables("gated vectors labelled", "").rstrip() + f", {_NORM}, {_HIST}, {_SCORED}, {_CENT}, {_PROTO}, {_WIDE}, {_fit_sql('labelled')}, told AS (SELECT message_id AS id, body AS message FROM gated), {_score_sql('told', 'labelled')}, "
    + "joined AS (SELECT scored.*, p_spam, wide.*, m.vec AS msg_vec, CASE WHEN len(cc) > 0 THEN c.vec END AS ctx_vec, CASE WHEN len(uc) > 0 THEN u.vec END AS user_vec, len(cc) > 0 AS has_ctx, len(uc) > 0 AS has_user FROM scored JOIN ctx USING (message_id) JOIN judged ON judged.id = message_id CROSS JOIN wide "
    + " ".join(f"LEFT JOIN vectors {x} ON {x}.vec_id = (message_id * {a} + {b}) % (SELECT count(*) FROM vectors)" for x, (a, b) in zip("mcu", _VECTOR_OF.values())) + "), "
    + "feats AS (SELECT *, " + ", ".join(f"coalesce(({_FEATURE_SQL[f]})::DOUBLE, 0) AS f_{f}" for f in (*vectors.FEATURES, "has_contact")) + " FROM joined), "
    + "rows AS (SELECT *, [" + ", ".join(f"f_{f}" for f in vectors.FEATURES) + "] AS f, " + str(_COEF) + "::DOUBLE[] AS k FROM feats), "
    + "parts AS (SELECT *, 1 / (1 + exp(-(list_dot_product(f, k) - 0.5))) AS p, list_sort([{'by': -round(abs(f[i] * k[i]), 9), 'name': " + fx._sql_list(vectors.FEATURES) + "[i]} FOR i IN range(1, len(k) + 1)]) AS led FROM rows) "
)


@query(_FEATURES_SQL + "SELECT message_id, " + ", ".join(f"round(f_{f}, 6) AS {f}" for f in vectors.FEATURES) + " FROM feats")
def q_feature_row(spark, sf_dir):
    """The whole row, by name."""
    out = vectors.feature_row(_features(spark, sf_dir))
    return out.select("message_id", *(F.round(F.col("features")[i], 6).alias(f) for i, f in enumerate(vectors.FEATURES)))


@query(_FEATURES_SQL + "SELECT message_id, " + ", ".join("round(" + {"sim_spam": "f_sim_spam_msg", "sim_ham": "f_sim_ham_msg", "sim_diff": "f_delta_msg", "kw_score": "0::DOUBLE", "tfidf_score": "0::DOUBLE"}.get(f, f"f_{f}") + f", 6) AS {f}" for f in vectors.BASE_FEATURES) + " FROM feats")
def q_base_feature_row(spark, sf_dir):
    out = vectors.base_features(_features(spark, sf_dir))
    return out.select("message_id", *(F.round(F.col("features")[i], 6).alias(f) for i, f in enumerate(vectors.BASE_FEATURES)))


@query(_FEATURES_SQL + "SELECT message_id, round(p, 6) AS p_spam, round(CASE WHEN msg_vec IS NOT NULL THEN p END, 6) AS used FROM parts")
def q_linear_score(spark, sf_dir):
    """The model's probability, and what of it is used: none without a vector."""
    p = vectors.linear_score(F.col("features"), _COEF, -0.5)
    return vectors.feature_row(_features(spark, sf_dir)).select("message_id", F.round(p, 6).alias("p_spam"), F.round(P.meta_probability(p, F.col("msg_vec")), 6).alias("used"))


@query(_FEATURES_SQL + "SELECT message_id, array_to_string([x.name FOR x IN led[1:5]], ',') AS names FROM parts")
def q_top_contrib(spark, sf_dir):
    top = vectors.top_contributions(F.col("features"), _COEF)
    return vectors.feature_row(_features(spark, sf_dir)).select("message_id", F.concat_ws(",", F.transform(top, lambda s: s["name"])).alias("names"))


_DEGRADED = "has_{0} AND {0}_vec IS NULL AND coalesce(msg_vec, ctx_vec, user_vec) IS NOT NULL"


@query(_FEATURES_SQL + f"SELECT message_id, 0.5::DOUBLE AS score, CASE WHEN msg_vec IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence, ctx_vec IS NOT NULL AS has_context, user_vec IS NOT NULL AS has_user, {_DEGRADED.format('ctx')} AS degraded_ctx, {_DEGRADED.format('user')} AS degraded_user FROM joined")
def q_vector_result(spark, sf_dir):
    """The vector filter's own result, and which capsules got no vector."""
    rows = _features(spark, sf_dir)
    vec = {k: F.col(f"{k}_vec") for k in _VECTOR_OF}
    flag = lambda k: vectors.degraded(F.when(F.col(f"has_{k}"), "capsule"), vec[k], *(vec[o] for o in vec if o != k)).alias(f"degraded_{k}")
    return rows.select("message_id", vectors.neutral_result(vec["msg"], vec["ctx"], vec["user"]).alias("r"), flag("ctx"), flag("user")).select("message_id", "r.*", "degraded_ctx", "degraded_user")


_ADJUSTED = "p * (CASE WHEN f_is_channel_announcement = 1 THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN f_reply_to_staff = 1 THEN 0.9::DOUBLE ELSE 1 END) * (CASE WHEN f_whitelist_hits_store + f_whitelist_hits_order + f_whitelist_hits_brand > 0 THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN f_whitelist_hits_brand > 0 THEN 0.7::DOUBLE ELSE 1 END)"
_FIRED = ("has_phone", "has_url", "has_email", "has_money", "has_age", "has_cta_plus", "has_dm", "has_contact", "has_remote", "has_legal", "has_casino")
_THREE = "printf('%.3f', floor({} * 1000 + 0.5) / 1000)"


@query(_FEATURES_SQL + f""", shown AS (SELECT *, {_ADJUSTED} AS q FROM parts) SELECT message_id AS id, CASE WHEN length(body) > 200 THEN left(body, 200) || '…' ELSE body END AS preview,
    array_to_string([x FOR x IN [{', '.join(f"CASE WHEN f_{k} = 1 THEN '{k}' END" for k in _FLAG_SQL)}] IF x IS NOT NULL], ',') AS flags, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN f_{k} = 1 THEN '{k}' END" for k in _FIRED)}] IF x IS NOT NULL][1:5], ',') AS patterns,
    array_to_string([x.name FOR x IN led[1:3]], ',') AS top, f_whitelist_hits_store::INTEGER || '/' || f_whitelist_hits_order::INTEGER || '/' || f_whitelist_hits_brand::INTEGER AS whitelist,
    CASE WHEN abs(p - q) > 0.001 THEN {_THREE.format('p')} || ' -> ' ELSE '' END || {_THREE.format('q')} AS probability FROM shown""")
def q_debug_report(spark, sf_dir):
    rows = vectors.feature_row(_features(spark, sf_dir)).withColumnRenamed("message_id", "id").withColumn("p_original", vectors.linear_score(F.col("features"), _COEF, -0.5))
    applied = P.downweights(F.col("is_channel_announcement"), F.col("reply_to_staff"), *(F.col(f"whitelist_hits_{k}") for k in ("store", "order", "brand")))
    rows = rows.withColumn("p_adjusted", P.adjusted(F.col("p_original"), applied))
    return tables.debug_report(rows, list(_FLAG_SQL), list(_FIRED), vectors.top_contributions(F.col("features"), _COEF))


@query(f"{_VEC} SELECT is_spam, family, count(*) AS n FROM vectors WHERE vec IS NOT NULL GROUP BY ALL")
def q_valid_vectors(spark, sf_dir):
    return vectors.with_vectors(fx.vectors(spark, sf_dir)).groupBy("is_spam", "family").agg(F.count("*").alias("n"))


@query(fx.with_tables("vectors log", "").rstrip() + f", {_CENT}, {_PROTO} SELECT 41 AS n_features, (SELECT strftime(max(created_at), '%Y-%m-%d') FROM log) AS fitted_at, (SELECT count(*) FROM cent) AS centroids, (SELECT count(*) FROM proto) AS prototypes, (SELECT count(*) FROM cent) = 2 AS ready")
def q_model_info(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    date = fx.events(spark, sf_dir).agg(F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("d"))
    out = vectors.model_info(vectors.mean_vectors(v, "is_spam"), vectors.mean_vectors(v, "family"), F.lit(None).cast("string"))
    return out.drop("fitted_at").crossJoin(date.withColumnRenamed("d", "fitted_at")).select("n_features", "fitted_at", "centroids", "prototypes", "ready")


@query(f"{_VEC}, {_CENT}, {_PROTO}, {_WIDE} SELECT vec_id, round(1 / (1 + exp(-({_cos('vec', 's')} * 2.0 - {_cos('vec', 'h')} * 1.5 + 0.25))), 6) AS p_spam FROM vectors CROSS JOIN wide")
def q_centroid_score(spark, sf_dir):
    v, wide = _artefacts(spark, sf_dir)
    out = vectors.feature_row(vectors.similarities(v, wide, {"msg": "vec"}), ("sim_spam_msg", "sim_ham_msg"))
    return out.select("vec_id", F.round(vectors.linear_score(F.col("features"), [2.0, -1.5], 0.25), 6).alias("p_spam"))


@query(f"{_VEC}, {_PROTO}, ex AS (SELECT family AS exemplar, CAST(list_position({fx._sql_list(SPAM_FAMILIES)}, family) IS NOT NULL AS INTEGER) AS label, vec AS e FROM proto), sim AS (SELECT v.vec_id, exemplar, ex.label, round(list_cosine_similarity(v.vec, e), 9) AS similarity FROM vectors v CROSS JOIN ex WHERE v.vec IS NOT NULL)"
       " SELECT vec_id, exemplar, label, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, exemplar) AS rank FROM sim) WHERE rank <= 3")
def q_nearest_exemplars(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    means = vectors.mean_vectors(v, "family")
    ex = means.select(F.col("family").alias("exemplar"), F.col("family").isin(*SPAM_FAMILIES).cast("int").alias("label"), "vec")
    return vector_index.nearest(v, ex, 3, "vec_id").withColumn("similarity", F.round("similarity", 6))


_PREPARED = f"prep AS (SELECT message_id, 'passage: ' || {sql_normalize('body', T.ENCODER_MONEY)} AS prepared FROM gated)"
_ENCODED = """hashed AS (SELECT message_id, ('0x' || left(md5(w), 8))::UBIGINT AS h FROM (SELECT message_id, unnest([x FOR x IN string_split_regex(lower(prepared), '\\s+') IF x <> '']) AS w FROM prep)),
    summed AS (SELECT message_id, h % 64 AS pos, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hashed GROUP BY ALL), long AS (SELECT message_id, sqrt(sum(x * x)) AS n FROM summed GROUP BY message_id),
    enc AS (SELECT message_id, CASE WHEN n > 0 THEN n END AS n, sum(x * pos) AS total, coalesce(max(x) FILTER (WHERE pos = 0), 0) AS first FROM summed JOIN long USING (message_id) GROUP BY message_id, n)"""
_ENC = fx.with_tables("gated", "").rstrip() + f", {_PREPARED}, {_ENCODED} "


def _encoded(spark, sf_dir):
    return vectors.encode_once(gated(spark, sf_dir).select("message_id", "body").withColumn("prepared", T.encoder_text(F.col("body"))), "prepared")


@query(_ENC + "SELECT message_id, CASE WHEN n IS NULL THEN NULL ELSE 64 END AS dim, round(first / n, 6) AS first, round(total / n, 6) AS total FROM enc")
def q_encode(spark, sf_dir):
    total = F.aggregate(F.transform("vec", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return _encoded(spark, sf_dir).select("message_id", F.when(F.col("vec").isNotNull(), F.size("vec")).alias("dim"), F.round(F.col("vec")[0], 6).alias("first"), F.round(total, 6).alias("total"))


@query(_ENC + "SELECT message_id, 0.5::DOUBLE AS score, CASE WHEN n IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence, false AS has_context, false AS has_user FROM enc")
def q_encode_single(spark, sf_dir):
    return vectors.encode_single(gated(spark, sf_dir).select("message_id", "body"), "body").select("message_id", "result.*")


@query(_ENC + ", bad AS (SELECT message_id, contains(lower(prepared), 'казино') AS refused FROM prep) SELECT message_id, NOT refused AS encoded, CASE WHEN NOT refused THEN length(prepared) END AS n FROM bad JOIN prep USING (message_id)")
def q_encoder_retries(spark, sf_dir):
    """An encoder that fails on a whole call for one text, and gives no vector
    to others unless they are alone: each text gets its own vector or none."""

    def encoder(texts):
        if any("казино" in t.lower() for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t))] if len(texts) == 1 or "доход" not in t.lower() else None for t in texts]

    out = vectors.encode(gated(spark, sf_dir).select("message_id", T.encoder_text(F.col("body")).alias("prepared")), "prepared", encoder)
    return out.select("message_id", F.col("vec").isNotNull().alias("encoded"), F.col("vec")[0].cast("long").alias("n"))


@query(_ENC + "SELECT count(*) AS total, count(n) AS successes, count(*) - count(n) AS failures FROM enc")
def q_encoder_stats(spark, sf_dir):
    return vectors.run_stats(_encoded(spark, sf_dir))


@query(_ENC + "SELECT count(*) AS total, count(n) AS successes, count(*) - count(n) AS failures, true AS timed FROM enc")
def q_encoder_run(spark, sf_dir):
    """The figures that a run gathers while its vectors are written."""
    run = vectors.EncoderRun(spark)
    written(run.watch(_encoded(spark, sf_dir)), "encoded")
    return run.stats().select("total", "successes", "failures", (F.col("elapsed_ms") >= 0).alias("timed"))


_BY_FAMILY = f"{_VEC}, fam AS (SELECT unnest({fx._sql_list(SPAM_FAMILIES + LEGIT_FAMILIES)}) AS family)"


@query(_BY_FAMILY + " SELECT family, true AS is_nearest, true AS of_its_cluster FROM fam")
def q_kmeans_representatives(spark, sf_dir):
    """What holds of each family's representative: it belongs to the cluster, and no other of its vectors is nearer to the centre."""
    v, parts = vectors.with_vectors(fx.vectors(spark, sf_dir)), []
    for label, families in ((1, SPAM_FAMILIES), (0, LEGIT_FAMILIES)):
        mine = v.where(F.col("is_spam") == label).select("vec_id", "vec")
        centres = written(vectors.kmeans_prototypes(mine, families), "centres")
        near = written(vectors.assigned(mine, centres, "vec_id").select("vec_id", "family", "distance"), "assigned")
        reps = vectors.representatives(mine, centres, "vec_id").select(F.col("family").alias("of"), F.col("vec_id").alias("chosen"))
        met = near.join(F.broadcast(reps), near["family"] == F.col("of"))  # a row for each family
        parts.append(met.groupBy("family").agg((F.min_by("distance", F.col("vec_id") != F.col("chosen")) == F.min("distance")).alias("is_nearest"), F.max(F.col("vec_id") == F.col("chosen")).alias("of_its_cluster")))
    return parts[0].unionByName(parts[1])


@query()
def q_kmeans(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    spam = vectors.kmeans_prototypes(v.where("is_spam = 1"), SPAM_FAMILIES)
    legit = vectors.kmeans_prototypes(v.where("is_spam = 0"), LEGIT_FAMILIES)
    reps = vectors.representatives(v, spam.unionByName(legit), "vec_id")
    return reps.select("family", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"{_VEC} SELECT is_spam, CASE WHEN is_spam = 1 THEN 7 ELSE 4 END AS centres, count(*) AS vectors, true AS are_means FROM vectors WHERE vec IS NOT NULL GROUP BY is_spam")
def q_kmeans_centres(spark, sf_dir):
    """What holds of the prototypes: as many as families, each the mean of the vectors nearest to it."""
    v, parts = vectors.with_vectors(fx.vectors(spark, sf_dir)), []
    for label, families in ((1, SPAM_FAMILIES), (0, LEGIT_FAMILIES)):
        mine = v.where(F.col("is_spam") == label).select("vec_id", "vec")
        centres = written(vectors.kmeans_prototypes(mine, families), "centres")
        near = vectors.assigned(mine, centres, "vec_id").drop("distance")
        means = vectors.mean_vectors(near, "family").select("family", F.col("vec").alias("mean")).join(centres, "family")
        off = F.aggregate(F.zip_with("vec", "mean", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
        parts.append(means.agg(F.count("*").cast("int").alias("centres"), (F.max(off) < 1e-3).alias("are_means")).crossJoin(mine.agg(F.count("*").alias("vectors"))).withColumn("is_spam", F.lit(label)))
    return parts[0].unionByName(parts[1]).select("is_spam", "centres", "vectors", "are_means")


def _calibrated(spark, sf_dir):
    rows = vectors.feature_row(fx.scores(spark, sf_dir), ("kw_score", "tfidf_score", "meta_proba"))
    model = training.calibrate(rows, "id")
    return rows.select("id", "label", model.probability(F.col("features")).alias("p"))


_SCORE_NAMES = ("kw_score", "tfidf_score", "meta_proba")


@query(fx.with_tables("scores", "SELECT id, true AS as_before_storing, 0.0::DOUBLE AS p_without, 'model_not_ready' AS error_without, 0.0::DOUBLE AS p_of_others, 'features_differ' AS error_of_others FROM scores"))
def q_meta_stored(spark, sf_dir):
    """A calibrated model and the order of its features, stored and loaded; and what is said without a model, or with one of other features."""
    rows = vectors.feature_row(fx.scores(spark, sf_dir), _SCORE_NAMES)
    before, root = [], job_folder(spark, "meta")

    def fit(path: str) -> None:
        before.append(training.calibrate(rows, "id"))
        models.save_meta(spark, models.Meta(before[0], _SCORE_NAMES), f"{path}/meta")

    path = models.stored(fx.scores(spark, sf_dir), "meta", fit)
    meta = models.load_meta(spark, f"{path}/meta")
    out = models.score(rows, meta, _SCORE_NAMES)
    expected = (before[0] if before else meta.calibrated).probability(F.col("features"))
    out = out.withColumn("as_before_storing", F.col("error").isNull() & (F.abs(F.col("p_spam") - expected) < 1e-12)).drop("p_spam", "error")
    out = models.score(out, models.load_meta(spark, f"{root}/none"), _SCORE_NAMES).withColumnsRenamed({"p_spam": "p_without", "error": "error_without"})
    out = models.score(out, meta, _SCORE_NAMES[::-1]).withColumnsRenamed({"p_spam": "p_of_others", "error": "error_of_others"})
    return out.select("id", "as_before_storing", "p_without", "error_without", "p_of_others", "error_of_others")


@query()
def q_calibrated(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("id", "label", F.round("p", 6).alias("p_spam"))


@query(fx.with_tables("scores", "SELECT count(*) AS n, true AS probabilities, true AS mean_is_near, true AS no_worse FROM scores"))
def q_calibration(spark, sf_dir):
    """What holds of calibrated scores: they are probabilities whose mean is near
    the share of spam, and their Brier score isn't worse than that of the share."""
    share = F.avg("label")
    told = _calibrated(spark, sf_dir).agg(F.count("*").alias("n"), (F.min("p") >= 0).alias("low"), (F.max("p") <= 1).alias("high"), F.abs(F.avg("p") - share).alias("off"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), share.alias("share"))
    return told.select("n", (F.col("low") & F.col("high")).alias("probabilities"), (F.col("off") < 0.02).alias("mean_is_near"), (F.col("brier") <= F.col("share") * (1 - F.col("share")) + 0.001).alias("no_worse"))


@query(fx.with_tables("scores", """, s AS (SELECT meta_proba AS x, avg(label) AS y, count(*) AS n FROM scores WHERE meta_proba IS NOT NULL AND id % 2 = 0 GROUP BY meta_proba),
    c AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(y * n) OVER (ORDER BY x) AS cy, sum(n) OVER (ORDER BY x) AS cn, y * n AS yn, n FROM s),
    best AS (SELECT b.i AS lo, k.i AS hi, (k.cy - b.cy + b.yn) / (k.cn - b.cn + b.n) AS m FROM c b JOIN c k ON b.i <= k.i),
    right_min AS (SELECT lo, hi, min(m) OVER (PARTITION BY lo ORDER BY hi DESC) AS m FROM best),
    fit AS (SELECT c.x, max(m) AS g FROM right_min JOIN c ON c.i = right_min.hi GROUP BY c.x),
    steps AS (SELECT x, g, lead(x) OVER (ORDER BY x) AS x1, lead(g) OVER (ORDER BY x) AS g1 FROM fit), ends AS (SELECT min(x) AS a, min_by(g, x) AS ga, max(x) AS b, max_by(g, x) AS gb FROM fit)
    SELECT id, meta_proba, round(CASE WHEN meta_proba <= a THEN ga WHEN meta_proba >= b THEN gb WHEN meta_proba = x THEN g ELSE g + (g1 - g) * (meta_proba - x) / (x1 - x) END, 6) AS calibrated
    FROM scores CROSS JOIN ends ASOF LEFT JOIN steps ON scores.meta_proba >= steps.x WHERE meta_proba IS NOT NULL AND id % 2 = 1""").replace("\n, s AS", ", s AS", 1))
def q_isotonic(spark, sf_dir):
    """Fitted to every other event, applied to those between."""
    s = fx.scores(spark, sf_dir)
    out = training.isotonic(s.where("id % 2 = 0"), "meta_proba", s.where("id % 2 = 1"))
    return out.select("id", "meta_proba", F.round("calibrated", 6).alias("calibrated"))


@query()
def q_char_model(spark, sf_dir):
    """Character runs and a logistic model: fitted to four fifths of the labelled documents."""
    docs = training.split(fx.labelled(spark, sf_dir)).withColumnRenamed("message", "text")
    return training.char_model(docs, F.col("part") == "train").select("id", "label", "fitted", F.round("p_spam", 6).alias("p_spam"))


@query()
def q_pattern_trees(spark, sf_dir):
    """A hundred boosted trees on patterns of labelled documents; what is known of messages alone is 0 for them."""
    rows = fx.labelled(spark, sf_dir).where("message is not null").withColumns(T.patterns(F.col("message")))
    rows = rows.select("id", "label", F.length("message").alias("text_length"), *(c for c in training.PATTERN_FEATURES if c in rows.columns))
    out = training.pattern_trees(rows, F.pmod(F.xxhash64("id"), F.lit(5)) > 0)
    return out.select("id", "label", "fitted", F.round("p_spam", 6).alias("p_spam"))


# policy
def decided(spark, sf_dir, mode: str) -> DataFrame:
    s = fx.scores(spark, sf_dir)
    off = lambda c: F.when(F.col("has_metadata"), F.col(c)).otherwise(F.lit(0).cast(dict(s.dtypes)[c]) if dict(s.dtypes)[c] != "boolean" else F.lit(False))
    applied = P.downweights(off("is_channel_announcement"), off("reply_to_staff"), off("hits_store"), off("hits_order"), off("hits_brand"))
    d = P.decide(F.lit(mode), F.col("meta_proba"), F.col("kw_score"), F.col("tfidf_score"), applied, F.col("degraded_ctx"))
    return s.withColumn("applied", applied).withColumn("d", d)


_MULT = """mult AS (SELECT *, [x FOR x IN [CASE WHEN has_metadata AND is_channel_announcement THEN {'type': 'is_channel_announcement', 'm': 0.85::DOUBLE} END, CASE WHEN has_metadata AND reply_to_staff THEN {'type': 'reply_to_staff', 'm': 0.9::DOUBLE} END,
    CASE WHEN has_metadata AND hits_store + hits_order + hits_brand > 0 THEN {'type': 'whitelist_hits', 'm': 0.85::DOUBLE} END, CASE WHEN has_metadata AND hits_brand > 0 THEN {'type': 'brand_hits', 'm': 0.7::DOUBLE} END] IF x IS NOT NULL] AS applied FROM scores),
    adj AS (SELECT *, meta_proba * (CASE WHEN has_metadata AND is_channel_announcement THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN has_metadata AND reply_to_staff THEN 0.9::DOUBLE ELSE 1 END)
    * (CASE WHEN has_metadata AND hits_store + hits_order + hits_brand > 0 THEN 0.85::DOUBLE ELSE 1 END) * (CASE WHEN has_metadata AND hits_brand > 0 THEN 0.7::DOUBLE ELSE 1 END) AS p,
    CASE WHEN degraded_ctx THEN 0.65::DOUBLE + 0.05::DOUBLE ELSE 0.65::DOUBLE END AS notify, CASE WHEN kw_score >= 0.6 THEN 'keyword' WHEN tfidf_score >= 0.65 THEN 'tfidf' END AS trig FROM mult)"""
_ADJ = fx.with_tables("scores", "").rstrip() + ", " + _MULT + " "
_AUTO_RAW = "CASE WHEN meta_proba >= 0.95 THEN 'kick' WHEN meta_proba >= 0.85 THEN 'delete' WHEN meta_proba >= 0.65 THEN 'notify' WHEN meta_proba IS NOT NULL THEN 'approve' END"


def _ladder(mode: str) -> str:
    rungs = {"manual": "", "unknown": "", "semi-auto": "WHEN p >= 0.85 THEN 'delete' ", "auto": "WHEN p >= 0.95 THEN 'kick' WHEN p >= 0.85 THEN 'delete' "}[mode]
    return f"CASE WHEN meta_proba IS NULL THEN CASE WHEN trig IS NULL THEN 'approve' ELSE 'notify' END {rungs}WHEN p >= notify THEN 'notify' ELSE 'approve' END"


def _policy(mode: str):
    def run(spark, sf_dir):
        return decided(spark, sf_dir, mode).select("id", F.col("d.action").alias("action"), F.round("d.p_adjusted", 9).alias("p_adjusted"), F.round("d.notify", 6).alias("notify"))

    run.__name__ = f"q_policy_{mode.replace('-', '_')}"
    sql = f"SELECT id, {_ladder(mode)} AS action, round(CASE WHEN meta_proba IS NOT NULL THEN p END, 9) AS p_adjusted, CASE WHEN meta_proba IS NULL THEN 0.65::DOUBLE ELSE round(notify, 6) END AS notify FROM adj"
    return query(_ADJ + sql)(run)


q_policy_manual, q_policy_semi_auto, q_policy_auto = map(_policy, ("manual", "semi-auto", "auto"))
q_policy_unknown = _policy("unknown")


@query(_ADJ + f"SELECT id, CASE WHEN trig IS NULL THEN 'approve' ELSE 'notify' END AS action, coalesce(trig, 'none') AS trigger, coalesce({_AUTO_RAW}, 'none') AS preview FROM adj")
def q_policy_legacy(spark, sf_dir):
    return decided(spark, sf_dir, "legacy-manual").select("id", F.col("d.action").alias("action"), F.coalesce("d.trigger", F.lit("none")).alias("trigger"), F.coalesce("d.preview_action", F.lit("none")).alias("preview"))


@query(_ADJ + "SELECT id, array_to_string([x.type FOR x IN applied], ',') AS applied, CAST(len(applied) AS INTEGER) AS n, round(p, 9) AS p_adjusted FROM adj")
def q_downweights(spark, sf_dir):
    d = decided(spark, sf_dir, "auto")
    return d.select("id", F.concat_ws(",", F.transform("applied", lambda x: x["type"])).alias("applied"), F.size("applied").alias("n"), F.round(P.adjusted(F.col("meta_proba"), F.col("applied")), 9).alias("p_adjusted"))


@query(_ADJ + "SELECT id, true AS fallback_meta, CASE WHEN trig IS NULL THEN 'approve' ELSE 'notify' END AS action, degraded_ctx FROM adj WHERE meta_proba IS NULL")
def q_fallback(spark, sf_dir):
    return decided(spark, sf_dir, "semi-auto").where("d.fallback_meta").select("id", "d.fallback_meta", F.col("d.action").alias("action"), "d.degraded_ctx")


@query(_ADJ + f"""SELECT id, CASE action WHEN 'delete' THEN 'Evident spam (p=' || pc || '). Deleted.' WHEN 'notify' THEN 'Suspicious message (p=' || pc || '). Needs review.' ELSE 'Legitimate message (p=' || pc || ').' END
    || CASE WHEN len(applied) > 0 THEN ' Downweights: ' || array_to_string([x.type || ' (×' || x.m || ')' FOR x IN applied], ', ') || '.' ELSE '' END AS reason
    FROM (SELECT *, {_ladder("semi-auto")} AS action, (floor(p * 10000 + 0.5)::BIGINT // 100) || '.' || lpad((floor(p * 10000 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || '%' AS pc FROM adj WHERE meta_proba IS NOT NULL)""")
def q_explain(spark, sf_dir):
    d = decided(spark, sf_dir, "semi-auto").where("meta_proba is not null")
    return d.select("id", P.explain(F.col("d.action"), F.col("d.p_adjusted"), F.col("d.applied")).alias("reason"))


_AVG = "CASE WHEN emb_score <> 0.5 AND emb_conf > 0 THEN 0.5 * emb_score + 0.3 * tfidf_score + 0.2 * kw_score ELSE 0.6 * tfidf_score + 0.4 * kw_score END"


@query(fx.with_tables("scores", f"""SELECT id, round({_AVG}, 9) AS average, greatest(kw_score, tfidf_score, emb_score) AS highest, kw_score >= 0.7 AND tfidf_score >= 0.7 AND coalesce(emb_score >= 0.7, true) AS all_high,
    round(coalesce(CASE WHEN id % 7 = 0 THEN kw_score END, CASE WHEN id % 7 = 1 THEN tfidf_score END, CASE WHEN id % 7 = 2 THEN emb_score END, meta_proba, {_AVG}), 9) AS confidence FROM scores"""))
def q_combined_scores(spark, sf_dir):
    s = fx.scores(spark, sf_dir)
    at = lambda k, c: F.when(F.col("id") % 7 == k, F.col(c))
    kw, tf, em, ec = (F.col(c) for c in ("kw_score", "tfidf_score", "emb_score", "emb_conf"))
    avg = P.average_score(kw, tf, em, ec)
    return s.select("id", F.round(avg, 9).alias("average"), P.max_score(kw, tf, em).alias("highest"), P.all_high(kw, tf, em).alias("all_high"), F.round(P.event_confidence(at(0, "kw_score"), at(1, "tfidf_score"), at(2, "emb_score"), F.col("meta_proba"), avg), 9).alias("confidence"))


# evaluation
def _predicted(spark, sf_dir):
    return fx.scores(spark, sf_dir).where("meta_proba is not null").withColumn("predicted", (F.col("meta_proba") >= 0.5).cast("int"))


_PRED = fx.with_tables("scores", "").rstrip() + ", pred AS (SELECT *, CAST(meta_proba >= 0.5 AS INTEGER) AS predicted FROM scores WHERE meta_proba IS NOT NULL) "


@query(_ADJ + ", modes AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, {_ladder(m)} AS action, label FROM adj" for m in ("manual", "semi-auto", "auto")) + " UNION ALL SELECT 'legacy-manual', CASE WHEN trig IS NULL THEN 'approve' ELSE 'notify' END, label FROM adj) SELECT mode, round(avg(CAST(CAST(action <> 'approve' AS INTEGER) = label AS INTEGER)), 6) AS accuracy FROM modes GROUP BY mode")
def q_mode_accuracy(spark, sf_dir):
    each = decided(spark, sf_dir, "auto").drop("d")
    each = each.withColumn("mode", F.explode(F.array(*map(F.lit, ("manual", "semi-auto", "auto", "legacy-manual")))))
    d = P.decide(F.col("mode"), F.col("meta_proba"), F.col("kw_score"), F.col("tfidf_score"), F.col("applied"), F.col("degraded_ctx"))
    rows = each.withColumn("predicted", (d["action"] != "approve").cast("int"))
    return evaluation.accuracy(rows, "predicted", "label", "mode").withColumn("accuracy", F.round("accuracy", 6))


@query(_PRED + "SELECT label, count(*) FILTER (WHERE predicted = 0) AS predicted_0, count(*) FILTER (WHERE predicted = 1) AS predicted_1 FROM pred GROUP BY label")
def q_confusion(spark, sf_dir):
    return evaluation.confusion(_predicted(spark, sf_dir), "predicted", "label")


@query(_PRED + """, c AS (SELECT k, count(*) FILTER (WHERE predicted = k AND label = k) AS tp, count(*) FILTER (WHERE predicted = k) AS made, count(*) FILTER (WHERE label = k) AS support FROM pred CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k),
    r AS (SELECT k::VARCHAR AS name, tp / made AS precision, tp / support AS recall, 2 * (tp / made) * (tp / support) / (tp / made + tp / support) AS f1, support FROM c)
    SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
    UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""")
def q_report(spark, sf_dir):
    out = evaluation.class_report(_predicted(spark, sf_dir), "predicted", "label")
    return out.select("name", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(_PRED + """, s AS (SELECT meta_proba AS p, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY p), r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg / 2 AS below FROM s)
    SELECT round(sum(pos * below) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r""")
def q_roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_predicted(spark, sf_dir), "meta_proba", "label").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(_PRED + """, s AS (SELECT meta_proba AS p, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY p), r AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n FROM s WINDOW w AS (ORDER BY p DESC)),
    c AS (SELECT p, tp / (tp + fp) AS pr, tp / n AS re FROM r), d AS (SELECT *, lag(pr, 1, 1.0) OVER (ORDER BY p DESC) AS pr0, lag(re, 1, 0.0) OVER (ORDER BY p DESC) AS re0 FROM c) SELECT round(sum((re - re0) * (pr + pr0) / 2), 6) AS pr_auc FROM d""")
def q_pr_auc(spark, sf_dir):
    return evaluation.pr_auc(_predicted(spark, sf_dir), "meta_proba", "label").select(F.round("pr_auc", 6).alias("pr_auc"))


@query(_PRED + "SELECT round(avg((meta_proba - label) ** 2), 6) AS brier FROM pred")
def q_brier(spark, sf_dir):
    return evaluation.brier(_predicted(spark, sf_dir), "meta_proba", "label").select(F.round("brier", 6).alias("brier"))


@query(_PRED + "SELECT round(avg(label) FILTER (WHERE meta_proba >= 0.85), 6) AS precision, count(*) FILTER (WHERE meta_proba >= 0.85) AS n FROM pred")
def q_prec_at(spark, sf_dir):
    return evaluation.precision_at(_predicted(spark, sf_dir), "meta_proba", "label", 0.85).withColumn("precision", F.round("precision", 6))


@query(_PRED + "SELECT round(count(*) FILTER (WHERE predicted = 1 AND label = 0) / count(*) FILTER (WHERE label = 0), 6) AS fp_rate, round(count(*) FILTER (WHERE predicted = 0 AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS fn_rate, CASE WHEN count(*) FILTER (WHERE predicted = 1 AND label = 0) / count(*) FILTER (WHERE label = 0) > 0.07 THEN 0.05::DOUBLE WHEN count(*) FILTER (WHERE predicted = 0 AND label = 1) / count(*) FILTER (WHERE label = 1) > 0.14 THEN -0.03::DOUBLE ELSE 0::DOUBLE END AS step FROM pred")
def q_threshold_tuning(spark, sf_dir):
    out = evaluation.error_rates(_predicted(spark, sf_dir), "predicted", "label")
    return out.select(F.round("fp_rate", 6).alias("fp_rate"), F.round("fn_rate", 6).alias("fn_rate"), "step")


@query(_PRED + "SELECT id, round(meta_proba, 6) AS meta_proba, round(abs(meta_proba - 0.5), 6) AS priority FROM pred WHERE meta_proba > 0.6 AND meta_proba < 0.75")
def q_grey_zone(spark, sf_dir):
    out = evaluation.grey_zone(_predicted(spark, sf_dir), "meta_proba")
    return out.select("id", F.round("meta_proba", 6).alias("meta_proba"), F.round("priority", 6).alias("priority"))


_CURVES = """s AS (SELECT meta_proba AS p, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY p), roc AS (SELECT sum(pos * below) / (sum(pos) * sum(neg)) AS v FROM (SELECT *, sum(neg) OVER (ORDER BY p) - neg / 2 AS below FROM s)),
    pr AS (SELECT sum((re - re0) * (pr + pr0) / 2) AS v FROM (SELECT *, lag(pr, 1, 1.0) OVER (ORDER BY p DESC) AS pr0, lag(re, 1, 0.0) OVER (ORDER BY p DESC) AS re0 FROM (SELECT p, tp / (tp + fp) AS pr, tp / n AS re FROM (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n FROM s WINDOW w AS (ORDER BY p DESC)))))"""


@query(_PRED.rstrip() + f""", {_CURVES}, {_REPORT}, lines AS (SELECT 'rows_label_' || label AS metric, count(*)::DOUBLE AS value FROM pred GROUP BY label UNION ALL SELECT 'rows_' || CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END, count(*) FROM pred GROUP BY ALL
    UNION ALL SELECT 'rows', count(*) FROM pred UNION ALL SELECT 'roc_auc', v FROM roc UNION ALL SELECT 'pr_auc', v FROM pr UNION ALL SELECT 'brier', avg((meta_proba - label) ** 2) FROM pred UNION ALL SELECT 'precision_at', avg(label) FILTER (WHERE meta_proba >= 0.85) FROM pred
    UNION ALL SELECT 'accuracy', avg(CAST(predicted = label AS INTEGER)) FROM pred UNION ALL SELECT 'label_' || label || '_predicted_' || k, count(*) FILTER (WHERE predicted = k) FROM pred CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY label, k
    UNION ALL SELECT name || '_precision', precision FROM told UNION ALL SELECT name || '_recall', recall FROM told UNION ALL SELECT name || '_f1', f1 FROM told UNION ALL SELECT name || '_support', support FROM told)
    SELECT metric, round(value, 6) AS value FROM lines""")
def q_training_report(spark, sf_dir):
    p = _predicted(spark, sf_dir).withColumn("part", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    return evaluation.training_report(p, "meta_proba", "predicted", "label", "part").withColumn("value", F.round("value", 6))
