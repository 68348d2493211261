"""A corpus pipeline of five operators of ``modlark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
it kept.  `run` writes what a stage returns to the shared scratch folder and
reads it again, so that no stage is computed twice.  Packing has no SQL; the
tests hold each stage against a brute-force version.

Every stage takes an empty table, rows that repeat, and columns of any names,
which all but the last return as they are.  Null, empty and wordless texts fail
the quality rules; stages after it treat them as empty.  Null ids are ids that
no other row has in quality rules and mixing; among near-duplicates a group
without any other id keeps one row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.llm import mixing, near_dedup, packing, quality, secrets
from modlark.llm.scratch import Scratch

VOCABULARY = "word_bpe_49k.json"


def _apart(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns of names that an operator adds, and its own columns afterwards."""
    names = {c: f"_own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    given, back = _apart(docs, (*quality.OUT, "kept"))
    return quality.judge(given, quality.learn_rules(docs, trusted)).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets masked."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice."""
    given, back = _apart(docs, mixing.ADDED)
    return mixing.mix(given).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # nothing reads it any more
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
