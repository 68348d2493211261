"""Queries through indexes: neighbours among vectors, and lexicons of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from modlark.config import BRAND_TERMS, ORDER_TERMS, STORE_TERMS
from modlark.operators import lexicon, vector_index
from modlark.plans.message_queries import gated
from modlark.plans.registry import query
from modlark.sources import fixtures as fx
from modlark.sources import io
from modlark.sources.shared import job_folder

_NEAR = """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS item, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
    near AS (SELECT vec_id, item, label, round(list_cosine_similarity(v, w), 9) AS similarity FROM q CROSS JOIN e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, item) <= 10)"""

def _vectors(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vec"))
    return items, items.where("vec_id % 100 = 0")


@query(_NEAR + " SELECT vec_id, item, label, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, item) AS INTEGER) AS rank FROM near")
def q_neighbours(spark, sf_dir):
    """The ten nearest of all vectors for every hundredth one, exactly: all cells are looked into."""
    items, asked = _vectors(spark, sf_dir)
    found = vector_index.search(vector_index.build(items, "vec_id", label_col="label"), asked, 10, "vec_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_NEAR + " SELECT count(DISTINCT vec_id) AS queries, count(*) AS links, true AS nine_tenths_found FROM near")
def q_index_recall(spark, sf_dir):
    """What the index finds in some of its cells, as many as a sample of queries needs, against all exact neighbours."""
    items, asked = _vectors(spark, sf_dir)
    index = vector_index.build(items, "vec_id")
    probes = vector_index.probes_for(index, asked, 10, "vec_id")
    met = vector_index.recall(vector_index.search(index, asked, 10, "vec_id", probes=probes), vector_index.search(index, asked, 10, "vec_id"), "vec_id")
    return met.select("queries", "links", (F.col("recall") >= 0.9).alias("nine_tenths_found"))


_WORDS = "terms AS (SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '')"


@query(fx.with_tables("gated", "").rstrip() + f", {_WORDS} SELECT term, count(*) AS hits FROM gated JOIN terms ON contains(lower(body), lower(term)) GROUP BY term")
def q_large_lexicon(spark, sf_dir):
    """How many messages hold each word of all documents, as any part of their text."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("term"))
    return lexicon.term_counts(gated(spark, sf_dir), lexicon.terms_of(words), "message_id", "body")


_LISTS = {"store": STORE_TERMS, "order": ORDER_TERMS, "brand": BRAND_TERMS}


@query(fx.with_tables("gated", "").rstrip() + " SELECT message_id, " + ", ".join(f"(SELECT CAST(count(DISTINCT t) AS INTEGER) FROM unnest({fx._sql_list(terms)}) u(t) WHERE contains(lower(body), lower(t))) AS hits_{name}" for name, terms in _LISTS.items()) + " FROM gated")
def q_list_hits(spark, sf_dir):
    """Hits of word lists of one's own, read from a file."""
    path = f"{job_folder(spark, 'lists')}/lists"
    spark.createDataFrame([(name, t) for name, terms in _LISTS.items() for t in terms], "name string, term string").write.json(path)
    return lexicon.list_hits(gated(spark, sf_dir).select("message_id", "body"), io.read_lists(spark, path), "message_id", "body").drop("body")
