from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from modlark.llm import hyperminhash, near_dedup, words
from modlark.llm.components import components
from modlark.llm.scratch import Scratch
from tests.llm.conftest import SCHEMA, document, prose


def brute(rows, percent, size=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    common = defaultdict(int)
    for group in having.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                common[group[a], group[b]] += 1
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[top(a)] = top(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(top(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def variants():
    """A chain of near copies, a star of near copies, and texts that only share a passage."""
    base, out = prose(5, 200).split(), []
    for k in range(30):
        changed = list(base)
        changed[(k * 6) % 200] = f"new{k}"
        out.append(" ".join(changed))
    chain = list(base)
    for k in range(12):
        chain[k * 15] = f"chain{k}"
        out.append(" ".join(chain))
    passage = prose(6, 40)
    return out + [f"{prose(100 + k, 60 + k)} {passage}" for k in range(20)]


def test_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(variants())]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = near_dedup.near_duplicates(documents)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(brute(rows, 85))


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = [(i, t) for i, t in enumerate(variants())]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 85)


def test_crowded_bands_are_banded_again(spark, monkeypatch):
    """Links are the same, whether a band is compared whole or banded again."""
    rows = [(i, t) for i, t in enumerate(variants())]
    for block, crowded in ((2, 4), (4, 8)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowded=crowded)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(rows, 85)
    registers, many = near_dedup.tables_for(1 << 20, 85)
    assert (1 - 0.85**registers) ** many <= near_dedup.MISSED and many * near_dedup.BLOCK < 1 << 20


def test_null_and_repeated_ids_are_told_apart_by_their_texts(spark):
    texts = variants()
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:42]] + [(None, texts[0])] * 5
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=key) == sorted(brute(rows, 85), key=key)


def test_odd_rows(odd, empty):
    found = near_dedup.near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(rows, 85), key=key)
    assert [r.kept for r in found if r.n_shingles == 0] == [True] * 4
    assert near_dedup.near_duplicates(empty).count() == 0


def test_keep_one(spark, odd, empty):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 2, 3, 4, 5, 7, 8, 10, 10, None, None]
    assert near_dedup.keep_one(empty).count() == 0
    same = spark.createDataFrame([document(1, prose(1, 50)), document(1, prose(1, 50) + " more")], SCHEMA)
    assert near_dedup.keep_one(same).count() == 1


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 2**63, 4000).astype(np.uint64)
        sets = []
        for _ in range(2):
            own = rng.integers(0, 2**63, int(4000 * (1 - share) / share / 2)).astype(np.uint64)
            sets.append(np.unique(words.mix(np.concatenate([common, own]))))
        n = np.array([len(s) for s in sets])
        regs = hyperminhash.registers(np.concatenate(sets), np.repeat([0, 1], n), 2)
        near = hyperminhash.similarity(regs[:1], regs[1:], n[:1], n[1:])[0]
        assert abs(near - share) < 5 * (share * (1 - share) / hyperminhash.BUCKETS) ** 0.5


def test_accidental_collisions_are_rare_and_corrected():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2)) for _ in range(2)]
    n = np.array([len(s) for s in sets])
    regs = hyperminhash.registers(np.concatenate(sets), np.repeat([0, 1], n), 2)
    assert hyperminhash.similarity(regs[:1], regs[1:], n[:1], n[1:])[0] < 0.03
    assert (hyperminhash._CHANCE > 0).all() and (hyperminhash._CHANCE < 1e-3).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {r.node: r.root for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_hot_copies_and_a_crowd_below_the_threshold(spark):
    """A third of the rows are copies; the others share all but two words, too few to be linked."""
    other = F.concat(F.lit(prose(2, 40) + " "), F.md5(F.col("id").cast("string")), F.lit(" "), F.sha1(F.col("id").cast("string")), F.lit(" " + prose(3, 4)))
    docs = spark.range(450).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(prose(1, 80))).otherwise(other).alias("text"))
    found = near_dedup.near_duplicates(docs)
    assert [tuple(r) for r in found.where("doc_id % 3 = 0").select("component_id").distinct().collect()] == [(0,)]
    assert found.where("kept").count() == 301


def test_counting_at_once_equals_pairs():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(20)]
    common = near_dedup._common(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)
