"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.llm.centroids import cluster
from modlark.llm.html_text import extract
from modlark.llm.lm_scores import lm_scores
from modlark.llm.media import media_digest
from modlark.llm.mixing import mix
from modlark.llm.near_dedup import near_duplicates
from modlark.llm.packing import pack
from modlark.llm.pii import personal_data
from modlark.llm.quality import quality_rules
from modlark.llm.secrets import scan
from modlark.llm.sharding import shard
from modlark.llm.toxicity import toxicity
from modlark.llm.vector_codes import vector_codes
from modlark.llm.vector_sql import OP11_SQL, OP12_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder():
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the passes and positions of the mix.  Null sources are one source; rows without words count nothing; repeated rows stay together."""
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "epoch", "mix_position", "source_weight", "alpha")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; null and empty texts are scored like any other, extra columns are not read."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder() == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null or wordless texts fail the base rules, null ids are never trusted."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their places; a null or empty text is its end id alone, repeated rows are packed each."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as audio in Matroska and read back; a null text is empty, equal texts get equal values."""
    return media_digest(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a null or wordless text is its end alone, a null id is hashed as an empty one."""
    return lm_scores(_table(spark, sf_dir, "documents").withColumn("held_out", _remainder() == 1))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a shard of nearly equal bytes, by a map that begins anew; a null text has 16 bytes, hot repeated rows are spread."""
    placed = shard(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all texts with their verdicts; null and clean texts have none, repeated rows theirs each."""
    return scan(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, empty for null html; null ids and urls come through."""
    return extract(_table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document; texts without words are linked with nothing, null ids take part in their groups."""
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("group_key", "text_key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors; null vectors and those with null or non-finite components are dropped, null ids and labels come through."""
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components; repeated rows count each."""
    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text; a null text is empty, repeated rows have theirs each."""
    return personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_source_mixing, op2_toxicity, op3_quality_rules, op4_best_fit_packing, op5_media_columns, op6_lm_scoring, op7_sharding, op8_secret_scans, op9_html_extraction, op10_near_dedup, op11_vector_codes, op12_centroid_clustering, op13_pii)}


_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
#: The contract read literally: sets of shingles, all links, what they lead to.
OP10_SQL = rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s FROM words),
    named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM sets),
    classes AS MATERIALIZED (SELECT k, min(doc_id) AS c, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY k),
    each AS MATERIALIZED (SELECT c, n, unnest(s) AS shingle FROM classes),
    met AS (SELECT a.c AS x, b.c AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM each a JOIN each b ON a.shingle = b.shingle AND a.c < b.c GROUP BY a.c, b.c),
    links AS MATERIALIZED (SELECT x, y FROM met WHERE 100 * common >= 85 * (n + m - common)),
    edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y),
    least AS (SELECT x, min(y) AS component FROM reached GROUP BY x)
    SELECT doc_id, named.n AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
    FROM named LEFT JOIN classes USING (k) LEFT JOIN least ON least.x = classes.c"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that their contracts determine wholly."""
    return {"op10_near_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_centroid_clustering": OP12_SQL}
