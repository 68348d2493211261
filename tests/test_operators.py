"""Operators on small hand-written tables."""

from __future__ import annotations

import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modlark.config import Policy
from modlark.functions import policy as P
from modlark.operators import bayes, evaluation, gates, history, keywords, review, settings, tables, training, vectors
from modlark.plans import model_queries
from modlark.sources import fixtures, io


def test_keyword_ladder(spark):
    df = spark.createDataFrame([("",), ("казино",), ("Доставка ставки доход",), (None,)], "body string")
    rows = keywords.keyword_filter(df).select("total_matches", "keyword_score").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0), (1, 0.4), (2, 0.6), (0, 0.0)]
    with pytest.raises(ValueError):
        keywords.keyword_filter(df, keywords=(), patterns=())


def test_gates_drop_what_they_should(spark):
    m = spark.createDataFrame([(1, 1, 10, "a", None), (2, 24, 10, "a", None), (3, 1, None, "a", None), (4, 1, 2, "a", None), (5, 1, 10, " ", "b"), (6, 1, 10, "", "b")], "message_id long, chat_id long, user_id long, text string, caption string")
    kept = gates.gate(m, fixtures.whitelist(spark), 24)
    assert sorted((r.message_id, r.body) for r in kept.collect()) == [(1, "a"), (6, "b")]


@pytest.mark.parametrize(
    "mode, p, action",
    [("manual", 0.99, "notify"), ("semi-auto", 0.85, "delete"), ("semi-auto", 0.99, "delete"), ("auto", 0.95, "kick"), ("auto", 0.85, "delete"), ("auto", 0.65, "notify"), ("auto", 0.6499, "approve"), ("odd", 0.99, "notify")],
)
def test_ladders(spark, mode, p, action):
    none = F.array().cast("array<struct<type:string,multiplier:double>>")
    d = spark.range(1).select(P.decide(F.lit(mode), F.lit(p), F.lit(0.0), F.lit(0.0), none, F.lit(False)).alias("d")).first().d
    assert d.action == action


def test_policy_fallback_degradation_and_weights(spark):
    applied = P.downweights(F.lit(True), F.lit(True), F.lit(1), F.lit(0), F.lit(1))
    d = spark.range(1).select(P.decide(F.lit("auto"), F.lit(1.0), F.lit(0.0), F.lit(0.0), applied, F.lit(True)).alias("d")).first().d
    assert [a.type for a in d.applied] == ["is_channel_announcement", "reply_to_staff", "whitelist_hits", "brand_hits"]
    assert d.p_adjusted == pytest.approx(0.85 * 0.9 * 0.85 * 0.7) and d.notify == pytest.approx(0.7)
    f = spark.range(1).select(P.decide(F.lit("auto"), F.lit(None).cast("double"), F.lit(0.6), F.lit(0.9), applied, F.lit(None).cast("boolean")).alias("d")).first().d
    assert f.fallback_meta and f.action == "notify" and f.trigger == "keyword" and not f.applied and f.notify == Policy().notify


def test_capsules_cut(spark):
    df = spark.createDataFrame([("x" * 10, ["a" * 30, "b" * 30, "c" * 5])], "norm string, ctx array<string>")
    flags = {k: F.lit(True) for k in ("reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement")}
    cap = lambda n: df.select(history.context_capsule(F.col("norm"), F.col("ctx"), flags, n).alias("c")).first().c
    full = cap(1000)
    assert full.startswith("passage:\n[CTX:n=3][reply_to_staff=1]") and full.endswith("\n---\n" + "c" * 5)
    assert "b" * 30 not in cap(len(full) - 20) and "c" * 5 not in cap(len(full) - 20)  # what doesn't fit ends the capsule
    assert "[CTX:n=0]" in cap(50)
    user = df.select(history.user_capsule(F.col("ctx"), 60).alias("c")).first().c
    assert user == "passage:\n[USER:k=3]\n" + "a" * 30
    empty = df.select(history.user_capsule(F.array().cast("array<string>")).alias("c")).first().c
    assert empty == "passage:\n[USER:k=0]\n"


def test_naive_bayes_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb", 1), (2, "bb cc", 0), (3, "", 0)], "id long, text string, label int")
    counts = bayes.term_counts(docs)
    weights = bayes.idf(counts, 3)
    idf = {r.term: r.idf for r in weights.collect()}
    assert idf["bb"] == pytest.approx(math.log(4 / 3) + 1) and idf["aa"] == pytest.approx(math.log(2) + 1)
    terms, priors = bayes.fit(docs, counts, 3)
    scores = {r.id: r for r in bayes.score(docs, counts, terms, priors).collect()}
    assert scores[1].p_spam > 0.4 > scores[2].p_spam and scores[3].p_spam == pytest.approx(1 / 3)
    none = bayes.score(docs, counts, terms.limit(0), priors.limit(0)).collect()
    assert all(r.p_spam == 0.5 and r.confidence == 0 for r in none)


@pytest.mark.parametrize("share", (1e-4, 0.05, 1.0))
def test_frequent_terms_meet_their_weights_like_others(spark, monkeypatch, share):
    monkeypatch.setattr(bayes, "SHARE", share)
    monkeypatch.setattr(bayes, "MAX_TERMS", 0 if share < 1 else 100)
    docs = spark.createDataFrame([(i, "aa " * (i % 3 + 1) + f"bb{i % 4} cc{i}") for i in range(60)], "id long, text string")
    counts = bayes.term_counts(docs)
    weights = bayes.idf(counts, 60)
    found = bayes.lookup(counts, weights)
    assert found.count() == counts.count() == 180
    assert sorted((r.id, r.term, r.tf, r.df) for r in found.collect()) == sorted((r.id, r.term, r.tf, r.df) for r in counts.join(weights, "term").collect())


def test_terms_are_counted_where_a_document_is(spark):
    counts = bayes.term_counts(spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, None)], "id long, text string"))
    assert sorted(map(tuple, counts.collect())) == [(1, "aa", 3), (1, "bb", 1)]
    told = re.findall(r"hashpartitioning\(([^)]*)\)", counts._jdf.queryExecution().executedPlan().toString())
    assert told and all(re.fullmatch(r"id#\d+L, \d+", x) for x in told)


def test_feature_rows_carry_no_texts_of_the_history(spark, sf_dir):
    plan = model_queries._features(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan  # nothing is normalised


def test_character_runs_stay_within_words(spark):
    row = spark.createDataFrame([("Ab  c",), ("",), (None,)], "t string").select(bayes.char_tokens(F.col("t")).alias("r")).collect()
    assert row[0].r == [" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab ", " ", "c", " ", " c", "c ", " c "] and row[1].r == [] == row[2].r


def test_character_model_tells_held_out_rows(spark):
    docs = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.concat(F.when(F.col("id") % 3 == 0, "winzone ").otherwise("weather "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    out = training.char_model(docs, F.pmod(F.xxhash64("id"), F.lit(4)) > 0, terms=400).where("not fitted").collect()
    assert len(out) > 40 and sum((r.p_spam >= 0.5) == (r.label == 1) for r in out) >= 0.95 * len(out)


def test_character_runs_are_counted_in_their_rows(spark):
    """The same terms, counts and vectors as of exploded rows, without a shuffle."""
    texts = ["Ab  c", "", None, " \t ", "a", "ababab ab\u00a0AB", "Ünï 😀😀 x😀y", "ΣΑΣ İ", "long " * 500 + "x" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    counted = training.char_counts(docs)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    said = lambda code: "".join(chr((code >> k & 0x1FFFFF) - 1) for k in (42, 21, 0) if code >> k & 0x1FFFFF)
    found = {(r.id, said(t), n) for r in counted.collect() for t, n in zip(r.terms, r.tfs)}
    counts = bayes.term_counts(docs, split=bayes.char_tokens)
    assert found == {(r.id, r.term, r.tf) for r in counts.collect()}
    top = bayes.idf(counts, 9).orderBy(F.desc("df"), "term").limit(40).collect()
    coded = bayes.idf(counted.select(F.explode("terms").alias("term")), 9).orderBy(F.desc("df"), "term").limit(40).collect()
    assert [(said(r.term), r.df) for r in coded] == [(r.term, r.df) for r in top]
    expected = {(r.id, r.term): r.w for r in bayes.tfidf(counts, spark.createDataFrame(top), sublinear=True).collect()}
    rows = training.char_vectors(counted, [(r.term, r.idf) for r in coded], 40).collect()
    got = {(r.id, top[at].term): w for r in rows for at, w in zip(r.features["indices"], r.features["values"])}
    assert len(rows) == 9 and got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_pattern_trees_tell_held_out_rows(spark):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100))
    rows = spark.range(900).select("id", (h("m") % 4).alias("money_count"), (h("u") < 30).cast("int").alias("has_url"))
    rows = rows.withColumn("label", ((F.col("money_count") >= 2) & (F.col("has_url") == 1)).cast("int"))
    out = training.pattern_trees(rows, F.pmod(F.xxhash64("id"), F.lit(4)) > 0, rounds=5).where("not fitted").collect()
    assert len(out) > 150 and sum((r.p_spam >= 0.5) == (r.label == 1) for r in out) >= 0.97 * len(out) and all(0 <= r.p_spam <= 1 for r in out)


def test_too_few_samples_are_not_evaluated(spark):
    docs = spark.createDataFrame([(i, "a b", i % 2, "train" if i < 6 else "test") for i in range(9)], "id long, text string, label int, part string")
    assert bayes.evaluate(docs, bayes.term_counts(docs)) is None
    told = bayes.evaluate(docs.unionByName(docs.withColumn("id", F.col("id") + 100)), bayes.term_counts(docs), leaked=True)
    assert told.count() == 6


def test_history_crosses_buckets(spark):
    """Whatever the buckets, a message's history is the same; a null user has one, too."""
    rows = [(i, i % 2, None if i % 5 == 0 else i % 3, i * 37 % 500, f"t{i}") for i in range(120)]
    m = spark.createDataFrame(rows, "message_id long, chat_id long, user_id long, s long, norm string").withColumn("ts", F.timestamp_seconds("s"))
    one = lambda seconds: sorted((r.message_id, tuple((h.user, h.text) for h in r.chat_history), tuple(r.user_history)) for r in history.with_history(m, 4, 3, seconds).collect())
    whole = one(1_000_000)
    assert one(7) == one(60) == whole
    by_time = sorted(rows, key=lambda r: (r[3], r[0]))
    for mid, chats, users in whole:
        at = next(k for k, r in enumerate(by_time) if r[0] == mid)
        mine = by_time[at]
        assert list(chats) == [(r[2], r[4]) for r in by_time[:at] if r[1] == mine[1]][-4:] and list(users) == [r[4] for r in by_time[:at] if r[2] == mine[2]][-3:]


def test_degradation_needs_another_vector(spark):
    df = spark.createDataFrame([("c", None, [1.0], None), ("c", None, None, None), ("c", [1.0], None, None), (None, None, [1.0], None)], "capsule string, ctx array<double>, msg array<double>, user array<double>")
    assert [r.d for r in df.select(vectors.degraded(F.col("capsule"), F.col("ctx"), F.col("msg"), F.col("user")).alias("d")).collect()] == [True, False, False, False]


def test_short_answers_of_an_encoder_are_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "t string").coalesce(1)

    def encoder(texts):
        return [[1.0]] * (len(texts) - 1) if len(texts) > 1 else [None if texts == ["c"] else [2.0]]

    assert {r.t: r.vec for r in vectors.encode(df, "t", encoder, at_once=3).collect()} == {"a": [1.0], "b": [1.0], "c": None}


def test_settings_reach_the_policy(spark):
    base = settings.defaults(spark)
    state = spark.createDataFrame([("policy_mode", '"auto"'), ("meta_kick", "0.7"), ("meta_downweight_whitelist", "0.5")], "key string, value string")
    row = settings.policy_row(settings.effective(state, base))
    rules = P.policy_of()
    for hits, action in ((0, "kick"), (1, "approve")):
        applied = P.downweights(F.lit(False), F.lit(False), F.lit(hits), F.lit(0), F.lit(0), rules)
        d = P.decide(rules.mode, F.lit(0.8), F.lit(0.0), F.lit(0.0), applied, F.lit(False), rules)
        assert row.select(d["action"]).first()[0] == action


def test_cleaning(spark):
    s = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1), (None, 1), (" ", 0), ("c", 0)], "message string, label int")
    assert sorted(tuple(r) for r in training.clean(s).collect()) == [("a", 1), ("c", 0)]
    with pytest.raises(ValueError):
        training.require_balance(s, 30)


def test_split_is_stable(spark):
    s = spark.range(2000).select(F.col("id").cast("string").alias("message"), (F.col("id") % 2).alias("label"))
    parts = {r.part: r["count"] for r in training.split(s, 0.8).groupBy("part").count().collect()}
    assert abs(parts["train"] - 1600) < 80


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_encoder_failures_are_retried_alone(spark):
    def encoder(texts):
        if "bad" in texts:
            raise RuntimeError("bad text")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string").coalesce(1)
    assert {r.t: r.vec for r in vectors.encode(df, "t", encoder).collect()} == {"a": [1.0], "bad": None, None: None}


def test_curves(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (None, 1)], "p double, y int")
    assert evaluation.roc_auc(df, "p", "y").first()[0] == pytest.approx(0.75)
    assert evaluation.pr_auc(df, "p", "y").first()[0] == pytest.approx(0.791666, abs=1e-5)


def test_calibration_is_a_probability_and_isotonic_is_monotone(spark):
    rows = spark.range(600).select("id", (F.col("id") % 100 / 100.0).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(100)) < F.col("id") % 100).cast("int").alias("label"))
    rows = rows.withColumn("features", F.array("s"))
    p = [r.p for r in rows.select(training.calibrate(rows, "id").probability(F.col("features")).alias("p"), "s").orderBy("s").collect()]
    assert all(0 <= x <= 1 for x in p) and p == sorted(p)
    iso = [r.calibrated for r in training.isotonic(rows.where("id % 2 = 0"), "s", rows.where("id % 2 = 1")).orderBy("s").collect()]
    assert iso == sorted(iso)


def test_kmeans_of_too_few_rows_is_the_mean(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([3.0, 1.0],)], "vec array<double>")
    assert {tuple(r.vec) for r in vectors.kmeans_prototypes(df, ("a", "b", "c")).collect()} == {(2.0, 1.0)}


def test_nearest_prototypes_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [9.0, 9.0]), (3, None)], "id long, vec array<double>")
    centres = spark.createDataFrame([("b", [0.0, 0.0]), ("a", [0.0, 0.0]), ("c", [9.0, 8.0])], "family string, vec array<double>")
    found = vectors.assigned(rows, centres, "id")
    assert sorted((r.id, r.vec, r.family, r.distance) for r in found.collect()) == [(1, [0.0, 0.0], "a", 0.0), (2, [3.0, 4.0], "a", 5.0), (2, [9.0, 9.0], "c", 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan
    assert vectors.assigned(rows, centres.limit(0), "id").count() == 0


def test_profiles_keep_the_last_name_even_if_null(spark):
    m = spark.createDataFrame([(1, 10, "a", 1), (2, 10, None, 2)], "message_id long, user_id long, username string, s long").withColumn("ts", F.timestamp_seconds("s"))
    p = tables.user_profiles(m)
    assert p.first().username is None
    merged = tables.merge_profiles(p.withColumn("username", F.lit("old")), p).collect()
    assert len(merged) == 1 and merged[0].username is None


def test_payloads(spark):
    df = spark.createDataFrame([("kick:1:2",), ("ham:1:2:0",), ("ham:1:2:7",), ("ham:1",), ("ham:x:2",), ("ham:1:2:x",)], "payload string")
    assert [(r.verdict, r.payload_event) for r in review.parse_payload(df).collect()] == [("kick", None), ("ham", 0), ("ham", 7)]


def test_settings_are_checked(spark):
    state = spark.createDataFrame([("policy_mode", '" Auto "'), ("meta_notify", "0.65"), ("meta_kick", "2"), ("meta_delete", "x"), ("other", "1")], "key string, value string")
    base = settings.defaults(spark)
    assert {r.key: r.verdict for r in settings.checked(state, base).collect()} == {"policy_mode": "ok", "meta_notify": "ok", "meta_kick": "rejected", "meta_delete": "undecodable"}
    assert [(r.key, r.text) for r in settings.overrides(state, base).collect()] == [("policy_mode", "auto")]
    one = spark.createDataFrame([("1, 2;x,3", " YES ")], "a string, b string").select(settings.int_list(F.col("a")).alias("a"), settings.truth(F.col("b")).alias("b")).first()
    assert list(one.a) == [1, 3] and one.b


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [('He said "hi", then\nleft', 1), ("a,b", 0)]
    io.write_labelled(spark.createDataFrame(rows, "message string, label int"), path)
    assert sorted(tuple(r) for r in io.read_labelled(spark, path).collect()) == sorted(rows)
    assert io.dataset_stats(spark, path).first().rows == 2
    (tmp_path / "lexicon.json").write_text('{"keywords": ["a", "b"], "patterns": ["c+"]}')
    assert [tuple(r) for r in io.read_lexicon(spark, str(tmp_path / "lexicon.json")).orderBy("kind", "ord").collect()] == [("keyword", 0, "a"), ("keyword", 1, "b"), ("pattern", 0, "c+")]


def test_event_log_appends(spark, sf_dir, tmp_path):
    path = str(tmp_path / "log")
    e = fixtures.events(spark, sf_dir)
    io.append_events(e.where("id % 2 = 0"), path)
    io.append_events(e.where("id % 2 = 1"), path)
    assert io.read_events(spark, path).count() == e.count()


def test_few_vectors_are_held_at_a_time(spark):
    """A batch of any length gets its vectors part by part, nulls and failures at their places."""
    seen = []

    def run(texts):
        seen.extend(texts)
        if len(texts) > 1 and "t900" in texts:
            raise RuntimeError("refused")
        return [[float(t[1:])] for t in texts]

    texts = pd.Series([None if i % 50 == 7 else f"t{i}" for i in range(3000)], dtype=object)
    parts = vectors._vectors(texts, run, 32)
    first = next(parts)
    assert len(seen) <= len(first) <= vectors.AT_HAND
    rest = [first, *parts]
    assert max(map(len, rest)) <= vectors.AT_HAND and [v for p in rest for v in p] == [None if t is None else [float(t[1:])] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    assert all(r.vec == (None if r.t is None else [float(r.t[1:])]) for r in vectors.encode(df, "t", lambda ts: [[float(t[1:])] for t in ts]).collect())


def test_a_task_counts_the_terms_of_few_documents(spark):
    docs = spark.range(4 * bayes.DEALT).select(F.col("id") % (4 * bayes.DEALT - 1), F.lit("aa bb aa").alias("text")).toDF("id", "text")
    tasks = bayes.term_counts(docs).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("id").alias("n"), F.sum("tf").alias("tf")).collect()
    assert len(tasks) > 3 and max(r.n for r in tasks) < 1.5 * bayes.DEALT
    assert sum(r.n for r in tasks) == 4 * bayes.DEALT - 1 and sum(r.tf for r in tasks) == 12 * bayes.DEALT  # an id that comes twice is one document
