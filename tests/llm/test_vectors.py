from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from modlark.llm import centroids, exact, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, dots array<int>, cluster string, vector int"
LONG = (1 << 63) - 1


def floor(x, scale):
    return int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale))


def rows(big: bool):
    r = random.Random(5)
    near = [[r.choice((-1, 0, 2)) + r.gauss(0, 0.3) for _ in range(64)] for _ in range(9)]
    out = [(i, [c + r.gauss(0, 0.2) for c in near[i % 9]], (1, 2, None)[i % 3]) for i in range(300)]
    out += [(1000 + i, near[0], 7) for i in range(60)] + [(1000, near[0], 7), (None, near[1], None), (5, near[2], 4), (6, [0.0] * 64, 4), (2000, [-0.001] * 64, 4)]
    out += [(3, None, 1), (7000, [float("nan")] * 64, 1), (7001, near[0][:-1] + [None], 1), (7002, near[0][:-1] + [float("inf")], 1), (7003, near[0][:60], 1), (7004, [], 1)]
    if big:
        out += [(-1, [1e9 * c for c in near[3]], 9), (8001, [3e38] * 32 + [-3e38] * 32, 9), (8002, [1e5] * 64, 9), (8003, [1e5] * 63 + [1e5 + 2**-8], 9)]
    return [(*x, "c", [1], "d", 3) for x in out]


def kept(given, scale):
    return sorted(((i, [floor(x, scale) for x in v], label, v) for i, v, label, *_ in given if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)), key=lambda x: (x[0] is None, x[0] or 0, x[3]))


def closest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries))


def lloyd(vectors, entries, rounds):
    entries = [list(e) for e in entries]
    for _ in range(rounds):
        own = defaultdict(list)
        for v in vectors:
            own[closest(v, entries)[1]].append(v)
        for k, vs in own.items():
            entries[k] = [sum(c) // len(vs) for c in zip(*vs)]
    return entries, [closest(v, entries) for v in vectors]


def digest(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def brute_codes(given, parts=16, size=64):
    all_rows, d = kept(given, 256), 64 // parts
    codes, errors, books = [""] * len(all_rows), [0] * len(all_rows), []
    for p in range(parts):
        part = [r[1][p * d : (p + 1) * d] for r in all_rows]
        book, told = lloyd(part, part[:size], 2)
        books += [c for e in book for c in e]
        for i, (far, k) in enumerate(told):
            codes[i] += f"{k:02x}"
            errors[i] += far
    errors, by_label = [min(e, LONG) for e in errors], Counter()
    for r, e in zip(all_rows, errors):
        by_label[r[2]] += e
    return [(r[0], c, e, min(by_label[r[2]], LONG), digest(books)) for r, c, e in zip(all_rows, codes, errors)]


def brute_clusters(given, k=16):
    all_rows = kept(given, 64)
    order = sorted(all_rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[3]))
    entries, told = lloyd([r[1] for r in all_rows], [r[1] for r in order[:k]], 3)
    inertia, far = Counter(), [min(d, LONG) for d, _ in told]
    for d, (_, n) in zip(far, told):
        inertia[n] += d
    return [(r[0], n, d, min(inertia[n], LONG), min(sum(inertia.values()), LONG), digest(entries[n])) for r, d, (_, n) in zip(all_rows, far, told)]


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("big", (False, True))
def test_codes_equal_brute_force(spark, big):
    given = rows(big)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    assert tuples(vector_codes.vector_codes(df)) == sorted(brute_codes(given), key=repr)


@pytest.mark.parametrize("big", (False, True))
def test_clusters_equal_brute_force(spark, big):
    given = rows(big)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    assert tuples(centroids.cluster(df)) == sorted(brute_clusters(given), key=repr)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(rows(False)[:5], SCHEMA)
    assert tuples(vector_codes.vector_codes(df)) == sorted(brute_codes(rows(False)[:5]), key=repr)
    assert tuples(centroids.cluster(df)) == sorted(brute_clusters(rows(False)[:5]), key=repr)
    for none in (df.limit(0), df.where("false"), spark.createDataFrame(rows(False)[-5:], SCHEMA).where("vec_id >= 7000")):
        assert vector_codes.vector_codes(none).count() == centroids.cluster(none).count() == 0


def test_many_labels_are_joined_and_hot_ones_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MAX_BROADCAST", 1)
    monkeypatch.setattr(vector_codes, "RARE", 4)
    given = rows(False)
    assert tuples(vector_codes.vector_codes(spark.createDataFrame(given, SCHEMA))) == sorted(brute_codes(given), key=repr)


@pytest.mark.parametrize("size", (1, 1 << 20, 1 << 25, (1 << 29) - 1, 1 << 40, 1 << 80))
@pytest.mark.parametrize("d", (1, 4, 64))
def test_products_are_exact(size, d):
    r = random.Random(size + d)
    x, c = ([[r.choice((-size, size, r.randint(-size, size))) for _ in range(d)] for _ in range(n)] for n in (20, 7))
    found = exact.products(exact.narrowed(np.array(x, object)), exact.narrowed(np.array(c, object)))
    assert found.tolist() == [[sum(a * b for a, b in zip(u, v)) for v in c] for u in x]
    at, far = exact.nearest(exact.narrowed(np.array(x, object)), exact.narrowed(np.array(c, object)))
    assert list(zip(far.tolist(), at.tolist())) == [closest(u, c) for u in x]


def test_limbs_stay_below_the_mantissa():
    for d in (1, 3, 4, 64, 1000):
        bits = exact.limb_bits(d)
        assert d * (2**bits - 1) ** 2 < 2**53 and d * (2 ** (bits + 1) - 1) ** 2 > 2**53
        x = np.array([-(1 << 40), -1, 0, 1 << 50, (1 << 24) - 1])
        parts = exact.limbs(x, bits)
        assert sum(p.astype(object) * (1 << bits * i) for i, p in enumerate(parts)).tolist() == x.tolist() and max(abs(p).max() for p in parts) < 2**bits


def test_products_are_updated_by_changed_components():
    r = np.random.default_rng(3)
    x, before = r.integers(-99, 99, (50, 64)), r.integers(-99, 99, (5, 64))
    after = before.copy()
    after[1, 7] += 3
    after[3] -= 1
    assert (centroids.updated(x, x @ before.T, before, after) == x @ after.T).all()
    x[:, 8:] = 10**15  # would be wrong if unchanged components were read
    assert (centroids.updated(x, np.zeros((50, 5), np.int64), before[:3], after[:3])[:, 1] == 3 * x[:, 7]).all()
