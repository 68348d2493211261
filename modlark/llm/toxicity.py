"""Toxicity by subword bags.

A word is the bag of its character n-grams, hashed to rows of an embedding
table, so that a misspelling never seen shares most of its rows with the word
that it hides.  The embeddings of a segment of ``SEGMENT`` words are averaged
and go through a linear softmax; a text is as toxic as its worst segment, taken
softly, as a single insult in a long text is toxic, too.  Table and softmax
are trained jointly in numpy on a bounded sample of labelled rows.  As
everything up to the softmax is linear, scoring needs one number per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlark.llm import words

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4, 5)
SEGMENT = 3
SIGNS = ".,;:!?\"'()[]{}|*#$%&<>"
#: Words whose score a worker remembers.
REMEMBERED = 200_000


def subwords(word: bytes) -> list[int]:
    """Table rows of a word's character n-grams, borders marked."""
    text = f"<{word.decode().strip(SIGNS).lower()}>"
    raw = [text.encode()] if len(text) <= NGRAMS[0] else [text[i : i + n].encode() for n in NGRAMS for i in range(len(text) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in raw]


@dataclass
class Model:
    """``gain[b]`` is what row b of the table adds to the logit of a text."""

    gain: np.ndarray
    bias: float


def _segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every segment, and each segment's text."""
    at = words.starts(counts)
    each = [np.arange(i, j, SEGMENT) for i, j in zip(at[:-1], at[1:])]
    return np.concatenate([*each, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(counts)), [len(e) for e in each])


def _pooled(logit: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A soft maximum over each text's segments, and each segment's part in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, logit)
    part = np.exp(logit - top[text])
    total = np.bincount(text, part, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, top + np.log(total / np.bincount(text, minlength=n)), -np.inf), part / total[text]


class _Batch:
    """Some labelled texts as index arrays: texts > segments > words > n-grams."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, known: dict[bytes, np.ndarray]):
        self.labels = labels
        self.ids, counts, vocabulary = words.numbered(texts)
        known.update((w, np.asarray(subwords(w), np.int32)) for w in vocabulary if w not in known)
        rows = [known[w] for w in vocabulary]
        self.length = np.asarray([len(r) for r in rows], np.float32)[:, None]
        self.gram = np.concatenate(rows)
        self.gram_at = words.starts(np.asarray([len(r) for r in rows]))[:-1]
        self.begin, self.text = _segments(counts)
        self.size = np.diff(np.append(self.begin, len(self.ids))).astype(np.float32)[:, None]
        # the same relations the other way, to sum gradients
        self.by_gram = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[np.argsort(self.gram, kind="stable")]
        self.grams, self.grams_at = np.unique(np.sort(self.gram), return_index=True)
        self.by_word = np.repeat(np.arange(len(self.begin), dtype=np.int32), self.size[:, 0].astype(int))[np.argsort(self.ids, kind="stable")]
        self.words_at = np.unique(np.sort(self.ids), return_index=True)[1]

    def gradients(self, table: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
        word = np.add.reduceat(table[self.gram], self.gram_at) / self.length
        mean = np.add.reduceat(word[self.ids], self.begin) / self.size
        logits = mean @ soft + bias
        n = len(self.labels)
        pooled, part = _pooled(logits[:, 1] - logits[:, 0], self.text, n)
        error = np.where(np.isfinite(pooled), 1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - self.labels, 0) / n
        d_logit = ((error[self.text] * part)[:, None] * np.array([-1.0, 1.0])).astype(np.float32)
        d_mean = d_logit @ soft.T / self.size
        d_word = np.add.reduceat(d_mean[self.by_word], self.words_at) / self.length
        d_table = np.zeros_like(table)
        d_table[self.grams] = np.add.reduceat(d_word[self.by_gram], self.grams_at)
        return [d_table, mean.T @ d_logit, d_logit.sum(axis=0)]


def train(texts: list[str | None], labels: list[int], epochs: int = 8, least_steps: int = 200, rate: float = 0.05, batch: int = 100, seed: int = 7) -> Model:
    """Fit table and softmax by Adam, in ``least_steps`` steps or more.

    Without rows of both classes the model is a constant, the share of label 1.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    order = rng.permutation([i for i, t in enumerate(texts) if words.split(t)])
    known: dict[bytes, np.ndarray] = {}
    batches = [_Batch([texts[i] for i in part], y[part], known) for part in np.array_split(order, max(1, len(order) // batch))]
    theta = [rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)]
    theta = [p.astype(np.float32) for p in theta]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in theta]
    step, steps = 0, max(epochs, -(-least_steps // len(batches))) * len(batches)
    while step < steps:
        for one in rng.permutation(len(batches)):
            step += 1
            pace = rate * (1 - (step - 1) / steps)
            for k, g in enumerate(batches[one].gradients(*theta)):
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                theta[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    table, soft, bias = theta
    return Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]))


class _Gains(dict):
    def __init__(self, gain: np.ndarray):
        super().__init__()
        self.gain = gain

    def __missing__(self, word: bytes) -> float:
        value = float(self.gain[subwords(word)].mean())
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def score_texts(texts: list[str | None], gains: _Gains, bias: float) -> np.ndarray:
    """Scores in [0, 1]; a wordless text is one empty segment."""
    split = [words.split(t) for t in texts]
    counts = np.asarray([len(w) for w in split], np.int64)
    flat = np.fromiter((g for w in split for g in map(gains.__getitem__, w)), float, int(counts.sum()))
    begin, text = _segments(counts)
    size = np.diff(np.append(begin, len(flat)))
    logit = np.add.reduceat(flat, begin) / size + bias if len(begin) else np.empty(0)
    pooled, _ = _pooled(logit, text, len(texts))
    pooled = np.where(np.isfinite(pooled), pooled, bias)
    return 1 / (1 + np.exp(-np.clip(pooled, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: dict[int, int], max_text_bytes: int, label_col: str, id_col: str, text_col: str) -> list:
    """About ``max_rows[label]`` rows ``(id, text, label)`` of each class at most,
    chosen by a hash of the id and the same in every run."""
    told = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    told = told.where(may_learn)
    n = {r["_label"]: r["count"] for r in told.groupBy("_label").count().collect()}
    share = F.lit(0.0)
    for label, count in n.items():
        if label not in max_rows:
            continue
        share = F.when(F.col("_label") == label, F.lit(min(1.0, max_rows[label] / count))).otherwise(share)
    chosen = told.where(F.pmod(F.xxhash64(id_col, F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    text = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).where(F.octet_length("_text") <= max_text_bytes)
    rows = text.join(F.broadcast(chosen), id_col).select("_text", "_label", F.col(id_col).alias("_id")).collect()
    return sorted((r["_id"], r["_text"], r["_label"]) for r in rows)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, max_toxic: int = 1_000, max_clean: int = 3_000, max_text_bytes: int = 1 << 17, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text of ``docs``.

    The model learns from labelled rows for which ``held_out`` (a condition on
    ``id_col``) is false: at most about ``max_toxic`` and
    ``max_clean`` of them, with texts of at most ``max_text_bytes``; that bounds
    what the driver trains on.
    Returns ``doc_id, held_out, score`` (0 to 1) and ``predicted`` (1 from 0.5).

    * Null or wordless text: the model's bias as an empty segment.
    * Null ids are scored, never learned from; a null ``held_out`` is false.
      Repeated rows get equal scores; an id with labels 0 and 1 counts as 1.
    * No labels, or of one class only: a constant score.
    * Other columns are not read; an empty table gives no rows.
    """
    out = F.coalesce(held_out, F.lit(False))
    sample = labelled_sample(docs, labels, ~out, {1: max_toxic, 0: max_clean}, max_text_bytes, label_col, id_col, text_col)
    model = train([t for _, t, _ in sample], [y for _, _, y in sample])
    gain, bias = model.gain.astype(np.float32), model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(gain)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                scores = score_texts(part.column(2).to_pylist(), gains, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
