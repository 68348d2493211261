from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlark.llm import lm_scores


def base_scores(rows):
    split = [(text or "").encode().lower().split() + [b""] for _, text, _ in rows]
    c = Counter(w for words, (_, _, held) in zip(split, rows) if not held for w in words)
    n, v = sum(c.values()), len(c)
    return sorted(((r[0] is None, r[0] or 0, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for w, r in zip(split, rows))), n


def held(df):
    return df.withColumn("held_out", F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) == 1)


def test_base_scores_and_gain(documents):
    given = held(documents)
    rows = [(r.doc_id, r.text, r.held_out) for r in given.collect()]
    found = lm_scores.lm_scores(given).collect()
    expected, n = base_scores(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {n}
    new = [r for r in found if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text, False) for r in odd.collect()]
    found = lm_scores.lm_scores(odd.withColumn("held_out", F.lit(None).cast("boolean"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == base_scores(rows)[0]
    assert lm_scores.lm_scores(empty.withColumn("held_out", F.lit(False))).count() == 0
    none = lm_scores.lm_scores(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def brute(rows):
    """Scores by dictionaries; rows are (doc_id, text, held_out, apart): in training, but apart when weights are learned."""
    split = {i: [b"", *(text or "").encode().lower().split(), b""] for i, text, _, _ in rows}
    pairs = {i: list(zip(t, t[1:])) for i, t in split.items()}
    train, apart = [r[0] for r in rows if not r[2]], [r[0] for r in rows if not r[2] and r[3]]

    def counted(ids):
        c2 = Counter(p for i in ids for p in pairs[i])
        return c2, Counter(w for i in ids for w in split[i][1:])

    all2, all1 = counted(train)
    core2, core1 = counted([i for i in train if i not in apart])
    s, n = lm_scores.STEPS, sum(all1.values())

    def estimates(u, w, c2, c1, total, less=0):
        count = lambda c, x: max(c[x] - less, 0)
        ctx = count(c1, u)
        return (1 + int(math.log2(ctx)) if ctx else 0), count(c2, (u, w)) / max(ctx, 1), count(c1, w) / max(total, 1)

    seen = Counter()
    for i in apart or train:
        for u, w in pairs[i]:
            b, *p = estimates(u, w, core2, core1, sum(core1.values())) if apart else estimates(u, w, all2, all1, n - 1, 1)
            seen[(b, *(round(s * math.log2(max(x, 2.0**-60))) for x in p))] += 1
    uniform = 1 / (len(all1) + 1)
    weights = defaultdict(lambda: list(lm_scores.START), {0: [0, 0.8, 0.2]})
    for _ in range(50):
        new = {b: [x * 1e-3 for x in weights[b]] for b in {k[0] for k in seen}}
        for (b, *c), many in seen.items():
            part = [x * p for x, p in zip(weights[b], [0 if k <= -60 * s else 2 ** (k / s) for k in c] + [uniform])]
            new[b] = [x + many * p / sum(part) for x, p in zip(new[b], part)]
        weights.update({b: [x / sum(w) for x in w] for b, w in new.items()})
    out = {}
    for i, told in pairs.items():
        at = [(b, p2, p1) for b, p2, p1 in (estimates(u, w, all2, all1, n) for u, w in told)]
        out[i] = sum(math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] * uniform) for b, p2, p1 in at)
    return out


@pytest.mark.parametrize("apart", (True, False))
def test_scores_equal_brute_force(spark, documents, apart):
    given = documents.where("doc_id < 120").select("doc_id", F.substring("text", 1, 900).alias("text")).dropDuplicates(["doc_id"])
    told = given.withColumn("apart", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(lm_scores.HELD_OUT)) == 0)
    told = told if apart else told.where("not apart")
    told = held(told).select("doc_id", "text", "held_out", "apart").collect()
    expected = brute([tuple(r) for r in told])
    found = lm_scores.lm_scores(spark.createDataFrame(told, "doc_id long, text string, held_out boolean, apart boolean")).collect()
    assert {r.doc_id: r.score for r in found} == pytest.approx(expected, abs=1e-6)


def test_layout_changes_no_score(documents, odd, monkeypatch):
    """Whatever the partitions, blocks and ranges, every score is the same."""
    one = lambda df: Counter((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores.lm_scores(df).collect())
    for given in (held(documents), odd.withColumn("held_out", F.lit(False))):
        first = one(given.repartition(1))
        for n in (3, 7):
            monkeypatch.setattr(lm_scores, "BLOCK_BYTES", (20_000 * n, 30_000 * n))
            monkeypatch.setattr(lm_scores, "BYTES_PER_RANGE", 100_000 // n)
            monkeypatch.setattr(lm_scores, "PARTS", 4096 if n == 3 else 5)  # then by teams
            monkeypatch.setattr(lm_scores, "TEAM", 2)
            assert one(given.repartition(n)) == first


def test_probabilities_add_up(spark, monkeypatch):
    """Over all words and one unknown, the probabilities after a context add up to 1.

    The text "a w" has log P(a | start) + log P(w | a) + log P(end | w), and
    "w" has log P(w | start) + log P(end | w); what is summed is the second
    word's share, with the ends' probabilities taken from one-word texts."""
    train = [(i, t, False) for i, t in enumerate(["a b a b", "a b c", "b a c c", "c a b"] * 30)]
    vocabulary = ["a", "b", "c", "zzz"]
    asked = [(1000 + i, f"{u} {w}", True) for i, (u, w) in enumerate((u, w) for u in vocabulary for w in vocabulary)] + [(2000 + i, w, True) for i, w in enumerate(vocabulary)] + [(3000, "", True)]
    out = {r.doc_id: 10**r.score for r in lm_scores.lm_scores(spark.createDataFrame(train + asked, "doc_id long, text string, held_out boolean")).collect()}
    one = np.array([out[2000 + i] for i in range(4)])  # P(w | start) P(end | w)
    two = np.array([out[1000 + i] for i in range(16)]).reshape(4, 4)  # P(u | start) P(w | u) P(end | w)
    # unknown x: solve P(. | start) from P(u | start) (P(end | u) + sum P(w | u)) = P(u | start)
    end_u = lambda start: one / start
    start = np.full(4, 0.2)
    for _ in range(200):
        start = one + (two / end_u(start)[None, :]).sum(axis=1)
    assert out[3000] + start.sum() == pytest.approx(1.0, abs=1e-6)


def test_mixture_weights_find_the_better_estimate():
    s = lm_scores.STEPS
    good, bad = int(s * np.log2(0.5)), int(s * np.log2(0.01))
    rows = np.array([[5, good, bad, 100], [7, bad, good, 100], [9, -60 * s, good, 50]])
    w = lm_scores.mixture_weights(rows, 1e-6)
    assert w[5, 0] > 0.9 and w[7, 1] > 0.9 and w[9, 0] < 0.01
    assert w.sum(axis=1) == pytest.approx(1.0)
    assert lm_scores.mixture_weights(np.empty((0, 4), np.int64), 0.1)[0] == pytest.approx([0, 0.8, 0.2])


def test_planes_round_trip():
    for kind in ("<i4", "<u8", "<i8"):
        x = np.arange(1000).astype(kind) * 77
        assert (lm_scores._numbers(lm_scores._planes(x), kind) == x).all()
    assert len(lm_scores._numbers(lm_scores._planes(np.empty(0, "<i8")), "<i8")) == 0
