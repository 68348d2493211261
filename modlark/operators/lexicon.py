"""Lexicons of any size: which terms occur in which texts.

One automaton finds all terms of a lexicon in a single pass over a text, so
the work doesn't grow with their number.  Terms whose total size is below a
bound are sent to the tasks; a larger lexicon loses the terms that no word of
the texts can hold, is dealt into shards by a hash, and texts are read once for
each.  No text is shuffled, and no text meets a
term that it doesn't hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlark.sources.shared import written

#: Characters of the terms of a shard at most, about: an automaton takes some 100 bytes for each.
SHARD = 4_000_000
#: By so many of their first characters the terms are looked for among words.
START = 16


def terms_of(table: DataFrame, column: str = "term") -> DataFrame:
    """``(term, key)``: the distinct terms, and each in lower case, by which it is
    found.  Null and empty ones are left out."""
    return table.select(F.col(column).alias("term")).where("term <> ''").distinct().withColumn("key", F.lower("term"))


def _shards(keys: DataFrame, size: int) -> tuple[int, Column]:
    total = keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    n = max(1, -(-total // size))
    return n, F.pmod(F.xxhash64("key"), F.lit(n))


def _possible(keys: DataFrame, words: DataFrame) -> DataFrame:
    """``keys`` without those that can't occur: a key without a blank lies within
    one of the distinct ``words``, and so do its first ``START`` characters.

    A word meets the lexicon by the pieces of it that are as long, so this work
    grows with the words and with the keys, not with their product."""
    pieces = F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({START}, length(word) - i + 1)), n -> substring(word, i, n))))")
    starts = words.select(F.explode(F.array_distinct(pieces)).alias("_start")).distinct()
    blank = F.col("key").rlike(r"[\x20\x09-\x0D]")
    met = keys.where(~blank).withColumn("_start", F.substring("key", 1, START)).join(starts, "_start", "left_semi").select("key")
    return met.unionByName(keys.where(blank))


def term_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, size: int = SHARD) -> DataFrame:
    """``(id, term)`` for each text and each term of `terms_of` that occurs in
    it, in any case.

    Null and empty texts hold nothing; rows that repeat give their hits each;
    terms that differ in case alone are all found."""
    keys = terms.select("key").distinct()
    n, shard = _shards(keys, size)
    given = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("text <> ''")
    if n > 1:  # each shard reads all texts
        words = given.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()
        keys = written(_possible(keys, words), "keys")
        n, shard = _shards(keys, size)
    kind = given.schema["id"].dataType.simpleString()
    out = given.limit(0).select("id", F.lit("").alias("key"))
    for k in range(n):
        own = [r["key"] for r in keys.where(shard == k).collect()]  # of bounded size

        def find(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, key in enumerate(own):
                automaton.add_word(key, i)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1)):
                    hits = {i for _, i in automaton.iter(text.as_py())}
                    rows += [row] * len(hits)
                    found += [own[i] for i in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "key"])

        if own:
            out = out.unionByName(given.mapInArrow(find, f"id {kind}, key string"))
    return out.join(terms, "key").select(F.col("id").alias(id_col), "term")


def term_counts(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, size: int = SHARD) -> DataFrame:
    """``(term, hits)``: the number of texts that hold each term; terms without any are left out."""
    return term_hits(texts, terms, id_col, text_col, size).groupBy("term").agg(F.count("*").alias("hits"))


def list_hits(texts: DataFrame, lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``texts`` with ``hits_<name>`` for word lists ``(name, term)`` read from a
    file: in how many of a list's terms each text holds."""
    names = sorted(r["name"] for r in lists.select("name").distinct().collect())  # a list is a column
    met = term_hits(texts, terms_of(lists), id_col, text_col).join(lists.select("name", "term").distinct(), "term")
    counts = met.groupBy(id_col).pivot("name", names).agg(F.count("term").cast("int")) if names else met.select(id_col).distinct()
    return texts.join(counts.withColumnsRenamed({n: f"hits_{n}" for n in names}), id_col, "left").fillna(0, [f"hits_{n}" for n in names])
