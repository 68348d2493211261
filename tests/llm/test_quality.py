from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from modlark.llm import quality, words


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {k + i for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def measures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_rules(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long")
    found = quality.quality_rules(odd, none).collect()
    assert sorted(measures(r) for r in found) == sorted(base(r.text) for r in odd.collect())
    assert all(r.kept == (not r.base_failed) and r.log_ratio == 0 for r in found)
    assert quality.quality_rules(empty, none).count() == 0
    text = "a b c\na b c\n\n \na b c d\n" + "e f " * 3 + "#*x"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert measures(quality.quality_rules(df, none).first()) == base(text)


def test_judge_keeps_columns(spark, odd):
    rules = quality.learn_rules(odd, spark.createDataFrame([(1,), (None,), (7,)], "doc_id long"))
    out = quality.judge(odd, rules)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert out.where("doc_id = 7").first().lang == "en"


def test_junk_goes_and_clean_stays(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.quality_rules(documents, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in found if r.quality == 1]
    assert sum(clean) >= 0.98 * len(clean)
    junk = [r.kept for r in found if r.quality == 0]
    assert not junk or sum(junk) <= 0.5 * len(junk)


def brute(rows, trusted):
    """Log ratios and verdicts by dictionaries over (doc_id, text)."""
    grams = {}
    for k, (_, text) in enumerate(rows):
        h = words.hashes((text or "").encode().split())
        grams[k] = [int(x) % quality.BUCKETS for x in (*words.mix(h), *words.windows(h, 2))]
    raw = Counter(g for gs in grams.values() for g in gs)
    target = Counter(g for k, gs in grams.items() if rows[k][0] in trusted for g in gs)
    n_raw, n_target, floor = sum(raw.values()), sum(target.values()), quality.SMOOTHING / quality.BUCKETS
    ratio = lambda g: math.log(target[g] / n_target + floor) - math.log(raw[g] / n_raw + floor)
    scores = [sum(map(ratio, gs)) / max(len(gs), 1) for gs in grams.values()]
    seen = [s for s, (i, t) in zip(scores, rows) if i in trusted and not base(t)[-1]]
    mean = sum(seen) / len(seen)
    least = mean - 6 * (sum((s - mean) ** 2 for s in seen) / len(seen)) ** 0.5
    return {i: (round(s, 6), not base(t)[-1] and s >= least) for s, (i, t) in zip(scores, rows)}


@pytest.mark.parametrize("max_broadcast", (2_000_000, 1))
def test_ratios_and_verdicts_equal_brute_force(spark, sf_dir, documents, max_broadcast):
    """By broadcast ids and by joined ones."""
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = brute(rows, {r.doc_id for r in ids.collect()})
    found = quality.judge(documents, quality.learn_rules(documents.repartition(3), ids, max_broadcast=max_broadcast)).collect()
    assert {r.doc_id: (round(r.log_ratio, 6), r.kept) for r in found} == expected and len(found) == len(rows)
