"""Each stage against its operator and a plain reading of what it must keep."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from modlark.llm import mixing, quality
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check
from tests.llm.test_quality import base


def test_stages(spark, documents, sf_dir, vocabulary):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secret_scans", "source_mixing", "best_fit_packing"]
    columns = documents.columns
    given = documents.cache()
    kept = stages["quality_rules"](spark, given, sf_dir).cache()
    assert kept.columns == columns
    rows = {r.doc_id: r.text for r in given.collect()}
    passed = {i for i, t in rows.items() if not base(t)[-1]}
    verdict = {r.doc_id for r in quality.quality_rules(given, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict <= passed

    unique = stages["near_duplicates"](spark, kept, sf_dir).cache()
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, _, c in brute(pairs, 80)}) and unique.columns == columns

    safe = stages["secret_scans"](spark, unique, sf_dir).cache()
    assert safe.count() == unique.count() and safe.columns == columns and safe.where("text like '%AKIA____________%'").count() == 0

    mixed = stages["source_mixing"](spark, safe, sf_dir).cache()
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {r.doc_id for r in safe.collect()} and max(times.values()) == 2
    assert mixed.count() == mixing.mix(safe).count()

    packed = stages["best_fit_packing"](spark, mixed, sf_dir).collect()
    used, least = check(packed, [(r.doc_id, r.text) for r in mixed.collect()], vocabulary)
    assert used <= least * 1.02 + 1
    given.unpersist()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_stages_on_odd_rows(spark, odd, sf_dir):
    """With columns that operators use themselves, which all come through."""
    clashing = odd.withColumns({"alpha": F.lit("mine"), "log_ratio": F.lit("mine"), "n_words": F.col("doc_id"), "found": F.lit("mine")})
    for docs in (clashing, clashing.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "best_fit_packing":
                assert docs.columns == columns
                rows = docs.collect()
                assert all((r.alpha, r.log_ratio, r.n_words, r.found, r.kept, r.epoch, r.node) == ("mine", "mine", r.doc_id, "mine", True, 5, 4) for r in rows)
        assert (docs.count() > 0) == (columns != [] and bool(rows))
    assert not rows


def test_scratch_tables_go(spark, sf_dir, monkeypatch):
    """Only what the last stage reads is left once `run` returns."""
    roots = []
    made = corpus_pipeline.Scratch
    monkeypatch.setattr(corpus_pipeline, "Scratch", lambda *a: roots.append(made(*a)) or roots[-1])
    corpus_pipeline.run(spark, sf_dir)
    folder = spark._jvm.org.apache.hadoop.fs.Path(roots[0].root)
    left = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    assert [s.getPath().getName() for s in left] == ["source_mixing"]
