"""Quality rules: plain counts of a text, and importance weights against a trusted target.

The method's verdict: the words and word pairs of a text are hashed into
``BUCKETS`` buckets.  Two multinomials over buckets are counted, one over the
trusted documents and one over all.  A text's score is the mean over its
n-grams of log p_target - log p_raw.  The threshold lies some standard deviations
below the mean score of the trusted documents, and every text whose score
reaches it passes; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import words

BUCKETS = 1 << 14
#: Texts whose words are numbered together.
GROUP = 2_000
SYMBOLS = "#*$%&|<>"
#: Added to each bucket's count, as a share of a bucket's mean count.
SMOOTHING = 0.01


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts' words and word pairs, each n-gram's text number,
    and the words' numbers in text order with their counts."""
    ids, counts, vocabulary = words.numbered(texts, lower=False)
    hashed = words.hashes(vocabulary)[ids]
    text = np.repeat(np.arange(len(counts)), counts)
    pair = words.windows(hashed, 2)
    inside = text[:-1] == text[1:] if len(text) else np.empty(0, bool)
    gram = np.concatenate([words.mix(hashed), pair[inside]]) % np.uint64(BUCKETS)
    return gram.astype(np.int64), np.concatenate([text, text[:-1][inside]]), np.stack([ids, text])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bucket counts: of trusted texts, and of all."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            gram, text, _ = _grams(part.column(0).to_pylist())
            trusted = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[text]
            totals += [np.bincount(gram[trusted], minlength=BUCKETS), np.bincount(gram, minlength=BUCKETS)]
    some = np.flatnonzero(totals[1])
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in totals)], names=["bucket", "target", "raw"])


def log_ratios(told: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, counted over all rows of
    ``(text, trusted)``.

    Tasks sum their own counts first, so that the shuffle and the driver see
    ``BUCKETS`` rows at most.  Without trusted documents all ratios are 0.
    """
    rows = told.select("text", "trusted").mapInArrow(_counted, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    totals = np.zeros((2, BUCKETS))
    for r in rows:
        totals[:, r.bucket] = r.target, r.raw
    if not totals[0].any():
        return np.zeros(BUCKETS)
    share = totals / totals.sum(axis=1, keepdims=True) + SMOOTHING / BUCKETS
    return np.log(share[0] / share[1])


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, back, n = np.unique(words.windows(ids.astype(np.uint64), 3), return_inverse=True, return_counts=True)
    again = n[back] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def _plain(text: str | None) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines."""
    text = text or ""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(text) - sum(map(text.count, " \t\n\r\x0b\x0c")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double"
OUT = tuple(part.split()[0] for part in _MEASURES.split(", "))


@dataclass
class Rules:
    """What was learned: a ratio for each bucket, and the least score to pass."""

    ratios: np.ndarray
    least: float


def _measured(ratios: np.ndarray):
    """Append the measures of the last column's texts to all columns."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = part.column(part.num_columns - 1).to_pylist()
                gram, of, (ids, text) = _grams(texts)
                n = len(texts)
                mean = np.bincount(of, ratios[gram], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
                n_words = np.bincount(text, minlength=n)
                cut = words.starts(n_words)
                repeat = np.asarray([_repeated(ids[i:j]) for i, j in zip(cut[:-1], cut[1:])], np.int64)
                plain = np.asarray([_plain(t) for t in texts], np.int64).reshape(-1, 3)
                failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
                columns = [n_words, *plain.T, repeat, failed, mean]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns)], names=[*part.schema.names, *OUT])

    return measure


def measures(docs: DataFrame, ratios: np.ndarray, text_col: str) -> DataFrame:
    """``docs`` with the columns of `OUT`, which replace any of those names."""
    rest = [c for c in docs.columns if c not in OUT and c != text_col]
    given = docs.select(*rest, F.col(text_col).cast("string").alias(text_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(_measured(ratios), f"{kinds}, {_MEASURES}")


def learn_rules(docs: DataFrame, trusted_ids: DataFrame, spread: float = 6.0, max_broadcast: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> Rules:
    """Learn from all trusted ids and all documents.

    Up to ``max_broadcast`` ids (8 bytes each) are broadcast, and no text is
    shuffled; more are joined by a shuffle.  Every document counts for the raw
    corpus.  Null ids are never trusted.  Without trusted documents all ratios
    are 0 and every score passes.
    """
    ids = trusted_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id")).distinct()
    small, ids = ids.count() <= max_broadcast, ids.withColumn("_in", F.lit(True))
    ids = F.broadcast(ids) if small else ids.hint("shuffle_merge")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    told = given.join(ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("_in", F.lit(False)).alias("trusted"))
    ratios = log_ratios(told)
    seen = measures(told.where("trusted").select("text"), ratios, "text").where("not base_failed").agg(F.avg("log_ratio"), F.stddev_pop("log_ratio")).first()
    return Rules(ratios, float("-inf") if seen[0] is None else seen[0] - spread * seen[1])


def judge(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of `OUT` and ``kept``; nothing is shuffled.

    ``base_failed`` if a text has fewer than 50 words or over half of its words
    lie in repeated 3-word windows; ``kept`` if it isn't so and ``log_ratio``,
    the mean over its n-grams, reaches the rules' least score.

    * Null or wordless text: all counts 0, ``base_failed``, not kept.
    * Null ids and repeated rows are judged like any other.  Columns of these
      names are replaced, all others kept.  An empty table gives no rows.
    """
    measured = measures(docs.drop("kept"), rules.ratios, text_col)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(rules.least)))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the columns of `OUT` and ``kept`` for every row of ``docs``,
    by `learn_rules` and `judge`."""
    rules = learn_rules(docs, trusted_ids, id_col=id_col, text_col=text_col)
    judged = judge(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rules)
    return judged.select("doc_id", *OUT, "kept")
