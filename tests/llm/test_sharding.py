from __future__ import annotations

import zlib

import numpy as np

from modlark.llm import sharding


def check(found, docs):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    places = {}
    for r in found:
        places.setdefault(r.shard, []).append(r.slot)
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    return places


def test_bytes_are_nearly_equal(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    found = sharding.shard(documents, n_shards=8).collect()
    check(found, docs)
    load = np.bincount([r.shard for r in found], [r.size for r in found], 8)
    assert load.max() - load.min() <= 0.02 * load.mean()


def test_odd_rows(odd, empty):
    found = sharding.shard(odd, n_shards=5).collect()
    check(found, [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.shard(empty).count() == 0


def test_rebalancing_edits_the_map_only_where_needed():
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 100, 4096).astype(float)
    first = sharding.first_map(40, 4096)
    second = sharding.rebalance(first, weight, 40)
    load = np.bincount(second, weight, 40)
    assert load.max() - load.min() <= 2e-4 * load.mean() + 1 and (first != second).mean() < 0.5
    assert (sharding.rebalance(second, weight, 40) == second).mean() > 0.99
    heavy = weight.copy()
    heavy[7] = weight.sum()  # one slot that can't be cut
    assert np.bincount(sharding.rebalance(first, heavy, 40), minlength=40).sum() == 4096


def test_a_slot_that_cant_be_cut_leaves_the_others_even():
    weight = np.random.default_rng(2).integers(1, 100, 4096).astype(float)
    for share in (0.03, 0.05, 0.33):
        weight[7] = 0
        weight[7] = share / (1 - share) * weight.sum()
        second = sharding.rebalance(sharding.first_map(40, 4096), weight, 40)
        load = np.delete(np.bincount(second, weight, 40), second[7])
        assert (second == second[7]).sum() == 1 and load.max() - load.min() <= 2e-4 * load.mean() + 1


def test_repeated_rows_are_dealt_over_slots(spark):
    docs = [(1, "one row " * 40)] * 900 + [(None, "no id " * 40)] * 900 + [(i, f"text {i} " * 30) for i in range(2, 1500)]
    found = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), n_shards=8).collect()
    check(found, docs)
    load = np.bincount([r.shard for r in found], [r.size for r in found], 8)
    assert load.max() - load.min() <= 0.02 * load.mean()
    assert max(np.bincount([r.virtual_slot for r in found])) < 20


def test_versions(spark):
    a = sharding.first_map(4, 64)
    b = sharding.rebalance(a, np.arange(64.0), 4)
    maps = sharding.map_table(spark, {0: a, 1: b})
    assert {r.virtual_slot: r.shard for r in sharding.latest(maps).collect()} == dict(enumerate(b.tolist()))


def test_a_stored_map_is_edited_in_the_next_run(spark, tmp_path):
    """Two runs on changed tables: few slots move, all other rows stay where they are."""
    path = str(tmp_path / "slots")
    docs = [(i, f"text {i} " * (5 + i % 40)) for i in range(6000)]
    first = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), n_shards=8, n_slots=1024, map_path=path).collect()
    more = docs[200:] + [(i, f"new {i} " * 30) for i in range(6000, 6500)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    second = sharding.shard(df, n_shards=8, n_slots=1024, map_path=path).collect()
    check(second, more)
    maps = {v: {} for v in (0, 1, 2)}
    for r in spark.read.parquet(path).collect():
        maps[r.version][r.virtual_slot] = r.shard
    assert all(len(m) == 1024 for m in maps.values())
    assert {r.virtual_slot: r.shard for r in second}.items() <= maps[2].items() and {r.map_version for r in second} == {2}
    moved = sum(maps[1][s] != maps[2][s] for s in maps[1])
    was, now = ({r.doc_id: r.shard for r in rows} for rows in (first, second))
    assert 0 < moved < 200 and sum(was[i] != now[i] for i in was.keys() & now.keys()) < 0.25 * len(was)
    load = np.bincount([r.shard for r in second], [r.size for r in second], 8)
    assert load.max() - load.min() <= 0.02 * load.mean()
    again = sharding.shard(df, n_shards=8, n_slots=1024, map_path=path).collect()
    assert {r.map_version for r in again} == {2} and {r.doc_id: r.shard for r in again} == now
    fewer = sharding.shard(df, n_shards=5, n_slots=1024, map_path=path).collect()
    assert {r.map_version for r in fewer} == {3} and {r.shard for r in fewer} == set(range(5))
