"""Indexes and the review queue against brute force."""

from __future__ import annotations

import random
from collections import OrderedDict

import numpy as np
import pytest

from modlark.operators import lexicon, review_queue, vector_index


def vectors(n, d=8, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    rows = [(i, [float(x) for x in centres[i % 5] + r.normal(scale=0.4, size=d)], i % 3) for i in range(n)]
    return rows + [(n + i, rows[0][1], 9) for i in range(n // 3)] + [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [1.0], 1), (9003, [float("nan")] * d, 1)]


def brute(rows, asked, k):
    good = sorted((i, np.array(v)) for i, v, _ in rows if v and len(v) == 8 and not np.isnan(v).any())
    out = set()
    for q, v, _ in asked:
        if v is None or len(v) != 8 or np.isnan(v).any():
            continue
        v, told = np.array(v), []
        for i, w in good:
            norm = np.linalg.norm(v) * np.linalg.norm(w)
            told.append((-round(float(v @ w / norm) if norm else 0.0, 6), i))
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(told)[:k])}
    return out


@pytest.mark.parametrize("cells", (1, 7))
def test_all_cells_are_exact_in_any_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    monkeypatch.setattr(vector_index, "QUERIES", 13)
    monkeypatch.setattr(vector_index, "SLICE", 5)
    rows = vectors(150)
    asked = rows[::9] + rows[-4:]
    schema = "id long, vec array<double>, label int"
    index = vector_index.build(spark.createDataFrame(rows, schema), "id", label_col="label", cells=cells)
    assert len(index.centres) == cells
    found = vector_index.search(index, spark.createDataFrame(asked, schema), 4, "id", digits=6).collect()
    assert {(r.id, r["item"], r["rank"]) for r in found} == brute(rows, asked, 4)
    labels = {i: label for i, _, label in rows}
    assert all(r.label == labels[r["item"]] for r in found)


def test_few_cells_find_most(spark):
    rows = vectors(600)[:600]
    schema = "id long, vec array<double>, label int"
    df = spark.createDataFrame(rows, schema)
    index = vector_index.build(df, "id", cells=20)
    exact = vector_index.search(index, df, 5, "id")
    assert vector_index.recall(vector_index.search(index, df, 5, "id", probes=8), exact, "id").first().recall >= 0.9
    probes = vector_index.probes_for(index, df, 5, "id", share=0.9)
    assert 1 <= probes < 20
    assert vector_index.recall(vector_index.search(index, df, 5, "id", probes=probes), exact, "id").first().recall >= 0.85
    plan = vector_index.search(index, df, 5, "id", probes=8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastExchange" not in plan


def test_an_index_of_nothing(spark):
    df = spark.createDataFrame([], "id long, vec array<double>, label int")
    index = vector_index.build(df, "id")
    assert vector_index.search(index, df, 5, "id").count() == 0
    some = vector_index.build(spark.createDataFrame(vectors(10), "id long, vec array<double>, label int"), "id")
    assert vector_index.search(some, df, 5, "id").count() == 0


@pytest.mark.parametrize("size", (lexicon.SHARD, 40))
def test_terms_in_texts(spark, size):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abßéИя ") for _ in range(r.randint(1, 5)))
    terms = [word() for _ in range(60)] + ["A", "a", "ab", "AB", "", None]
    texts = [(i, "".join(word() for _ in range(r.randint(0, 30)))) for i in range(80)] + [(80, None), (81, ""), (82, "xyz"), (0, "ab twice")]
    df, t = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in terms], "term string")
    found = sorted((x.id, x.term) for x in lexicon.term_hits(df, lexicon.terms_of(t), "id", "text", size).collect())
    assert found == sorted((i, x) for i, text in texts for x in set(terms) if x and text and x.lower() in text.lower())
    counts = {x.term: x.hits for x in lexicon.term_counts(df, lexicon.terms_of(t), "id", "text", size).collect()}
    assert counts == {x: sum(term == x for _, term in found) for _, x in found}


def test_terms_of_no_word_are_in_no_shard(spark):
    words = spark.createDataFrame([("zabcd" + "x" * 40,), ("q",), ("",)], "word string").where("word <> ''")
    keys = ["abc", "x" * 30, "x" * 16 + "y", "no", "q", "qq", "a b", "zabcd" + "x" * 40]
    left = lexicon._possible(spark.createDataFrame([(k,) for k in keys], "key string"), words)
    assert sorted(r.key for r in left.collect()) == sorted(set(keys) - {"no", "qq"})


def test_a_lexicon_has_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "some text")], "id long, text string")
    terms = lexicon.terms_of(spark.range(100_000).selectExpr("concat('t', id) as term"))
    plan = lexicon.term_counts(df, terms, "id", "text")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert lexicon.term_counts(df, terms.limit(0), "id", "text").count() == 0


def queue(events, verdicts, keep):
    steps = [(at, 0, i) for i, at in events] + [(max(at, dict(events)[i]), 1, i) for i, at in verdicts.items()]
    waiting, out = OrderedDict(), set()
    for _, kind, i in sorted(steps):
        if kind:
            waiting.pop(i, None)
        else:
            waiting[i] = None
            if len(waiting) > keep:
                out.add(waiting.popitem(last=False)[0])
    return out, set(waiting)


@pytest.mark.parametrize("seed, n, keep, size, delay", [(1, 400, 20, 50, 40), (2, 400, 20, 50, 400), (3, 300, 7, 10, 60), (4, 300, 30, 1000, 100), (5, 200, 3, 1, 20), (6, 300, 15, 40, 5000)])
def test_the_queue_evicts_as_one_worker_would(spark, seed, n, keep, size, delay):
    r = random.Random(seed)
    events = [(i, r.choice((r.randint(0, 300), 77))) for i in r.sample(range(10_000), n)]
    verdicts = {i: at + r.randint(-2, delay) for i, at in events if r.random() < 0.7}
    stamp = lambda rows, c: spark.createDataFrame(rows, f"{c} long, s long").selectExpr(c, f"timestamp_seconds(s) as {'created_at' if c == 'id' else 'performed_at'}")
    e, v = stamp(events, "id"), stamp([*verdicts.items(), *[(i, at + 9) for i, at in verdicts.items() if i % 5 == 0], (-1, 5)], "event_id")
    gone, left = queue(events, verdicts, keep)
    found = [x.id for x in review_queue.evicted(e, v, keep, size).collect()]
    assert sorted(found) == sorted(gone)
    assert {x.id for x in review_queue.pending_after(e, v, keep, size).collect()} == left


def test_an_empty_queue(spark):
    none = spark.createDataFrame([], "id long, created_at timestamp")
    verdicts = spark.createDataFrame([], "event_id long, performed_at timestamp")
    assert review_queue.evicted(none, verdicts).count() == 0
