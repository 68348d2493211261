from __future__ import annotations

import math
import random

import numpy as np

from pyspark.sql import functions as F

from modlark.llm import queries, toxicity, words
from tests.llm.conftest import prose


def corpus(n=240):
    rng, rows = random.Random(5), []
    for k in range(n):
        text = prose(k, rng.randint(5, 150)).split()
        if k % 4 == 0:
            stem = rng.choice(["blockhead", "nincompoop"])
            text.insert(rng.randrange(len(text)), stem + rng.choice(["", "s", "ish", "!", "y"]))
        rows.append((k, " ".join(text), int(k % 4 == 0)))
    return rows


def test_finds_insults_and_their_misspellings(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    found = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 5 == 0).join(df.select("doc_id", "toxic"), "doc_id").collect()
    new = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in new) >= 0.9 * len(new)
    model = toxicity.train([t for _, t, _ in corpus()], [y for _, _, y in corpus()])
    gains = toxicity._Gains(model.gain)
    odd, plain = toxicity.score_texts(["you blokhead", "you " + prose(900, 1)], gains, model.bias)
    assert odd > plain


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.toxicity(odd, none, F.lit(None).cast("boolean")).collect()
    assert len(found) == 14 and all(0 <= r.score <= 1 and r.predicted == 0 and not r.held_out for r in found)
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, one, F.lit(False)).count() == 14
    both = spark.createDataFrame([(1, 1), (5, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, both, F.lit(False)).count() == 14
    assert toxicity.toxicity(empty, both, F.lit(False)).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, toxic int")
    swapped = df.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    runs = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(df.select("doc_id", "text"), labels.select("doc_id", "toxic"), F.col("doc_id") % 5 == 0).collect()) for labels in (df, swapped)]
    assert runs[0] == runs[1]


def test_given_documents(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.toxicity(documents, labels, F.col("doc_id") % 5 == 0).count() == documents.count()


def test_held_out_labels_of_given_documents(spark):
    """By the folds of the query, on more documents: toxic ones are found, clean ones left alone."""
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    for rows in ([r for r in found if r.held_out], [r for r in found if not r.held_out]):
        toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
        assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.03 * len(clean) and len(toxic) >= 5


def forward(texts, labels, table, soft, bias):
    """The model read literally, text by text: its loss and scores."""
    loss, scores = 0.0, []
    for text, y in zip(texts, labels):
        w, logits = words.split(text), []
        for at in range(0, len(w), toxicity.SEGMENT):
            part = [np.mean([table[g] for g in toxicity.subwords(x)], axis=0) for x in w[at : at + toxicity.SEGMENT]]
            two = np.mean(part, axis=0) @ soft + bias
            logits.append(two[1] - two[0])
        z = np.log(np.mean(np.exp(logits))) if logits else None
        scores.append(1 / (1 + math.exp(-(z if logits else bias[1] - bias[0]))))
        if logits:
            loss += math.log1p(math.exp(z)) - y * z
    return loss / len(texts), scores


def test_scores_and_gradients_equal_the_literal_model():
    rng = np.random.default_rng(4)
    texts, labels = ["you old blockhead and more words", "fine day", "a", "you you you", "one two three four"], np.array([1, 0, 1, 0, 1], np.float32)
    table, soft, bias = rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.5, (toxicity.DIM, 2)), np.array([0.1, -0.2])
    batch = toxicity._Batch(texts, labels, {})
    found = batch.gradients(table, soft, bias)
    step = 1e-5
    used = sorted({g for t in texts for w in words.split(t) for g in toxicity.subwords(w)})
    places = [(0, (g, k)) for g in used[::7] for k in (0, 5)] + [(1, (k, c)) for k in range(toxicity.DIM) for c in (0, 1)] + [(2, (c,)) for c in (0, 1)]
    for which, at in places:
        both = []
        for sign in (1, -1):
            theta = [table.copy(), soft.copy(), bias.copy()]
            theta[which][at] += sign * step
            both.append(forward(texts, labels, *theta)[0])
        assert abs((both[0] - both[1]) / (2 * step) - found[which][at]) < 1e-4, (which, at)
    assert not np.delete(found[0], used, axis=0).any()
    model = toxicity.Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))
    scores = toxicity.score_texts([*texts, "", None], toxicity._Gains(model.gain), model.bias)
    assert np.allclose(scores, forward([*texts, "", None], [0] * 7, table, soft, bias)[1], atol=1e-6)
