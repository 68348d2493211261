from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlark.llm import mixing


def test_alpha_meets_its_targets():
    tokens = np.array([1000.0, 100.0, 50.0, 0.0])
    a = mixing.solve(tokens, 2.0, None)
    turns = mixing.passes(tokens, mixing.weights(tokens / tokens.sum(), a), None)
    assert turns[:3].max() == pytest.approx(2.0, rel=1e-6) and turns[:3].min() == pytest.approx(1.0) and turns[3] == 1
    e = mixing.solve(tokens, None, 0.9)
    assert mixing.entropy(mixing.weights(tokens / tokens.sum(), e)) == pytest.approx(0.9, abs=1e-6)
    assert mixing.solve(tokens, None, None) == 1.0 and mixing.solve(tokens, 100.0, None) == 0.0
    assert mixing.solve(np.zeros(0), 2.0, None) == 0.0


def corpus(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.expr("concat_ws(' ', sequence(1, 5 + id % 40))").alias("text"))


def test_budgets_are_met(spark):
    docs = corpus(spark)
    out = mixing.mix(docs, max_passes=1.5).withColumn("tokens", mixing.n_words(F.col("text")))
    rows = out.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("epoch").alias("e"), F.countDistinct("doc_id").alias("d"), F.first("source_weight").alias("w")).collect()
    total = sum(r.t for r in rows)
    assert all(abs(r.t / total - r.w) < 0.003 for r in rows) and max(r.e for r in rows) == 2
    assert sum(r.d for r in rows) == 3000
    each = Counter((r.doc_id, r.epoch) for r in out.collect())
    assert set(each.values()) == {1}
    place = [r.mix_position for r in out.select("mix_position").collect()]
    assert 0 <= min(place) and max(place) < 1


def test_small_budget_takes_a_part(spark):
    docs = corpus(spark)
    tokens = docs.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    out = mixing.mix(docs, max_passes=None, budget_tokens=tokens / 2).select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(out - tokens / 2) < 0.02 * tokens


def test_runs_are_the_same(spark):
    docs = corpus(spark, 500)
    key = lambda df: sorted((r.doc_id, r.epoch) for r in df.collect())
    assert key(mixing.mix(docs)) == key(mixing.mix(docs.repartition(5)))


def test_odd_rows(odd, empty):
    out = mixing.mix(odd)
    assert [c for c in odd.columns if c not in out.columns] == [] and out.count() >= odd.count()
    first = out.where("epoch = 1")
    assert first.count() == odd.count()
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("budget", (None, 20_000.0, 90_000.0))
def test_rows_equal_brute_force(spark, budget):
    """Whole passes, then whole blocks of the last pass in its order, then documents of one block, by plain loops."""
    docs = corpus(spark, 2000)
    told = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n"), F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(mixing.N_BLOCKS)).alias("block"), mixing._spread(F.col("doc_id"), F.lit("within")).alias("at"))
    ranks = told.crossJoin(spark.range(1, 4).withColumnRenamed("id", "turn")).select("doc_id", "turn", mixing._rank(F.concat(F.lit("s"), "source"), F.col("block"), F.col("turn").cast("int")).alias("rank"))
    rank = {(r.doc_id, r.turn): r["rank"] for r in ranks.collect()}
    sources = {}
    for r in told.collect():
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources)
    tokens = np.array([sum(r.n for r in sources[s]) for s in names], float)
    alpha = mixing.solve(tokens, 2.0, None, budget)
    turns = mixing.passes(tokens, mixing.weights(tokens / tokens.sum(), alpha), budget)
    expected = Counter()
    for s, total, many in zip(names, tokens, turns):
        whole = int(many + 1e-9)
        left = (many - whole) * total if many - whole > 1e-9 else 0.0
        expected.update({r.doc_id: whole for r in sources[s] if whole})
        if left:
            for r in sorted(sources[s], key=lambda r: (rank[r.doc_id, whole + 1], r.at)):
                left -= r.n
                if left < 0:
                    break
                expected[r.doc_id] += 1
    found = Counter(r.doc_id for r in mixing.mix(docs, budget_tokens=budget).collect())
    assert found == expected
