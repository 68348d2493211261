"""The keyword filter: terms and patterns of a lexicon, and the score of their number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlark.config import KEYWORDS, PATTERNS


def matched_keywords(text: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """Terms that occur in the text, any case, in the lexicon's order."""
    lower = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(lower, F.lit(k.lower())), k) for k in keywords)))


def matched_patterns(text: Column, patterns: Sequence[str] = PATTERNS) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike("(?iU)" + p), F.lit(p)) for p in patterns)))


def score_of(total: Column) -> Column:
    """0, 0.4, 0.6, 0.8 and, from four matches on, 0.95."""
    ladder = F.when(total == 0, 0.0)
    for n, score in enumerate((0.4, 0.6, 0.8), 1):
        ladder = ladder.when(total == n, score)
    return ladder.otherwise(0.95)


def keyword_filter(messages: DataFrame, text_col: str = "body", keywords: Sequence[str] = KEYWORDS, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """Add ``matched_keywords, matched_patterns, total_matches`` and ``keyword_score``."""
    if not keywords and not patterns:
        raise ValueError("the lexicon is empty")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = messages.withColumn("matched_keywords", matched_keywords(text, keywords)).withColumn("matched_patterns", matched_patterns(text, patterns))
    out = out.withColumn("total_matches", F.size("matched_keywords") + F.size("matched_patterns"))
    return out.withColumn("keyword_score", score_of(F.col("total_matches")))


def term_frequency(scored: DataFrame) -> DataFrame:
    """In how many messages each keyword and pattern was matched."""
    return scored.select(F.explode(F.concat("matched_keywords", "matched_patterns")).alias("term")).groupBy("term").agg(F.count("*").alias("hits"))
