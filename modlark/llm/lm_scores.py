"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: of a word after the word before
it, of the word alone, and a uniform one.  The weights depend on how often the
context word was seen (in powers of two), and are learned by
expectation-maximisation on held-out counts: those of one in ten training
texts, chosen by a hash of the text, so that all copies are on one side and
the scores don't depend on how rows are laid out.  Where no text is chosen, as
in very small tables, every training token is held out of the others in turn.

How counts meet texts.  A first pass numbers the words of blocks of texts and
writes the numbers.  Each block then asks for the counts of its own distinct
words and pairs: their hashes are sorted, cut into ranges, and one message per
range goes to the task that adds up that range, which answers in the same
order.  Messages hold distinct n-grams of a block, summed before the
shuffle, so a frequent word is one entry of each block and no hot key; no
count table is ever held whole.  A block asks ``PARTS`` ranges at most.  Where
the corpus needs more, these are cut into finer ones: blocks are dealt to
teams, a task merges what a team asks of a range and asks the finer ranges in
its name, and another hands the answers out.  So there are about blocks x
``PARTS`` and teams x ranges messages, never blocks x ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import words
from modlark.llm.scratch import Scratch

#: A block's bytes of text: a hundredth of the corpus, within these bounds.
BLOCK_BYTES = (1 << 16, 1 << 23)
#: Bytes of text for each range of n-gram hashes, and so for each task that adds up.
BYTES_PER_RANGE = 1 << 24
#: Ranges that a block asks itself, and blocks of a team where there are more.
PARTS = 4096
TEAM = 1024
#: One training text in so many is held out when mixture weights are learned.
HELD_OUT = 10
#: Steps per power of two to which held-out probabilities are rounded.
STEPS = 8
CONTEXTS = 40
END = b""
#: Weights of pair, word and uniform estimates that expectation-maximisation starts from.
START = np.array([0.5, 0.4, 0.1])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, high bytes apart from low ones: compresses well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, len(planes) // width).T).view(kind).ravel()


_BLOCK = "block long, n_train long, n_held long, doc_id array<bigint>, train array<boolean>, held array<boolean>, counts binary, vocabulary binary, ids binary"


def _block(number: int, rows: list[tuple]) -> pa.RecordBatch:
    doc_id, train, held, texts = (list(c) for c in zip(*rows))
    ids, counts, vocabulary = words.numbered(texts)
    vocabulary.append(END)
    ends = np.cumsum(counts)
    ids = np.insert(ids, ends, len(vocabulary) - 1).astype(np.int32)
    n_train, n_held = (int((counts + 1)[np.asarray(flag, bool)].sum()) for flag in (train, held))
    cells = [[number], [n_train], [n_held], [doc_id], [train], [held], [_planes(counts + 1)], [words.hashes(vocabulary).tobytes()], [_planes(ids)]]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["block", "n_train", "n_held", "doc_id", "train", "held", "counts", "vocabulary", "ids"])


def _blocked(size: int):
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, n = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                n += len(row[3] or "")
                if n >= size:
                    yield _block(number, rows)
                    number, rows, n = number + 1, [], 0
        if rows:
            yield _block(number, rows)

    return block


class _Tokens:
    """A block's tokens: word hashes, contexts and whose text they are in."""

    def __init__(self, row: dict):
        self.counts = _numbers(row["counts"], "<i8")
        self.ids = _numbers(row["ids"], "<i4")
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        every = [True] * len(self.counts)
        self.train, self.held = (np.repeat(np.asarray(row.get(c, every), bool), self.counts) for c in ("train", "held"))
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[words.starts(self.counts)[:-1]] = len(self.vocabulary) - 1  # a text begins after an end
        self.before = before

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words (by number) and of each token's pair."""
        first = words.mix(self.vocabulary * np.uint64(3))
        return words.mix(self.vocabulary), words.mix(first[self.before] + self.vocabulary[self.ids])

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For words (1) and pairs (2): sorted distinct hashes, and how often
        each is in training texts and in those held out."""
        word, pair = self.keys()
        for level, keys, tokens in ((1, word, self.ids), (2, pair, None)):
            distinct, back = np.unique(keys, return_inverse=True)
            at = back if tokens is None else back[tokens]
            yield level, distinct, *(np.bincount(at[flag], minlength=len(distinct)).astype(np.uint32) for flag in (self.train, self.held))


_MESSAGE = "level int, part int, block long, keys binary, counts binary, held_at binary, held binary"


def _messages(level: int, block: int, distinct: np.ndarray, count: np.ndarray, held: np.ndarray, first: int, last: int, ranges: int) -> pa.RecordBatch:
    """Sorted hashes of the ranges ``first`` to ``last`` with training counts, a
    message for each range that has any; held-out ones among them by their
    places and held-out counts."""
    borders = np.array([(k << 64) // ranges for k in range(first + 1, last)], np.uint64)
    cuts = np.searchsorted(distinct, borders, side="left")
    parts = [slice(i, j) for i, j in zip(np.append(0, cuts), np.append(cuts, len(distinct)))]
    some = [k for k, p in enumerate(parts) if p.stop > p.start]
    places = {k: np.flatnonzero(held[parts[k]]).astype(np.uint32) for k in some}
    cells = (
        ([level] * len(some), pa.int32()), ([first + k for k in some], pa.int32()), ([block] * len(some), pa.int64()),
        ([_planes(np.diff(distinct[parts[k]], prepend=np.uint64(0))) for k in some], pa.binary()), ([_planes(count[parts[k]].astype("<u4")) for k in some], pa.binary()),
        ([_planes(places[k]) for k in some], pa.binary()), ([_planes(held[parts[k]][places[k]].astype("<u4")) for k in some], pa.binary()),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cells], names=["level", "part", "block", "keys", "counts", "held_at", "held"])


def _asked(ranges: int):
    """A block's messages."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # blocks are large: one at a time
                row = batch.slice(k, 1).to_pylist()[0]
                for level, distinct, count, held in _Tokens(row).levels():
                    yield _messages(level, row["block"], distinct, count, held, 0, ranges, ranges)

    return ask


@dataclass
class _Sums:
    """What messages of a range say together: distinct hashes, each message's
    places among them, its held-out ones, and sums of both counts."""

    distinct: np.ndarray
    own: list[np.ndarray]
    own_held: list[np.ndarray]
    total: np.ndarray
    held: np.ndarray


def _summed(table: pa.Table) -> _Sums:
    keys = [np.cumsum(_numbers(k, "<u8"), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts, places, apart = ([_numbers(x, "<u4") for x in table.column(c).to_pylist()] for c in ("counts", "held_at", "held"))
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
    own_held = [o[p] for o, p in zip(own, places)]
    total, held = (np.bincount(np.concatenate(at), np.concatenate(n), len(distinct)).astype(np.int64) for at, n in ((own, counts), (own_held, apart)))
    return _Sums(distinct, own, own_held, total, held)


def _merged(parts: int, finer: int):
    """What a team asks of a range, as messages to the finer ranges in it."""

    def merge(table: pa.Table) -> pa.Table:
        level, part, team = (table.column(c)[0].as_py() for c in ("level", "part", "team"))
        s = _summed(table)
        return pa.Table.from_batches([_messages(level, team, s.distinct, s.total, s.held, part * finer, (part + 1) * finer, parts * finer)])

    return merge


_ANSWER = "level int, part int, block long, totals binary, core binary, known long"


def _told(table: pa.Table, s: _Sums, total: np.ndarray, core: np.ndarray, known: int) -> pa.Table:
    """An answer to each message, in the order that it asked."""
    out = table.select(["level", "part", "block"]).append_column("totals", pa.array([_planes(total[o]) for o in s.own], pa.binary()))
    return out.append_column("core", pa.array([_planes(core[h]) for h in s.own_held], pa.binary())).append_column("known", pa.array([known] + [0] * (len(s.own) - 1)))


def _answered(table: pa.Table) -> pa.Table:
    """Totals of a range, for each block in the order that it asked for; for
    what it holds out, also the counts without any held-out text."""
    s = _summed(table)
    return _told(table, s, s.total, s.total - s.held, int((s.total > 0).sum()))


def _handed_out(table: pa.Table, answers: pa.Table) -> pa.Table:
    """What a team's messages to a range are answered, by the finer ranges' answers to the team."""
    s, rows = _summed(table), sorted(answers.to_pylist(), key=lambda a: a["part"])
    total, core = np.concatenate([_numbers(a["totals"], "<i8") for a in rows]), np.zeros(len(s.distinct), np.int64)
    core[s.held > 0] = np.concatenate([_numbers(a["core"], "<i8") for a in rows])
    return _told(table, s, total, core, sum(a["known"] for a in rows))


def _counts(answers: list[dict], column: str) -> dict[int, np.ndarray]:
    """A column of a block's answers by level, in the order of its hashes."""
    ordered = sorted(answers, key=lambda a: a["part"])
    return {level: np.concatenate([np.empty(0, "<i8"), *(_numbers(a[column], "<i8") for a in ordered if a["level"] == level)]) for level in (1, 2)}


def _estimates(tokens: _Tokens, got: dict[int, np.ndarray], n: float, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token's word, its context's bucket, and both estimates;
    all counts by ``less``."""
    word, pair = tokens.keys()
    c1 = np.maximum(got[1][np.unique(word, return_inverse=True)[1]] - less, 0)
    c2 = np.maximum(got[2][np.unique(pair, return_inverse=True)[1]] - less, 0)
    context = c1[tokens.before]
    bucket = np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(int), 0).clip(0, CONTEXTS - 1)
    return c1[tokens.ids], bucket, c2 / np.maximum(context, 1), c1[tokens.ids] / max(n, 1)


def _held_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the held-out texts alone, whose words are numbered anew: their
    sorted hashes are those that the block has ``core`` answers for."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            tokens = _Tokens(row)
            used, ids = np.unique(tokens.ids[tokens.held], return_inverse=True)  # the end comes last
            held = np.asarray(row["held"], bool)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary() if isinstance(c, bytes) else None) for c in (row["block"], _planes(tokens.counts[held]), tokens.vocabulary[used].tobytes(), _planes(ids.astype(np.int32)))], names=["block", "counts", "vocabulary", "ids"])


def _held_out(n: int, in_turn: bool):
    """Rounded estimates of held-out tokens, counted.  ``in_turn``: of each
    training token from all the others."""

    def count(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("bucket", "pair", "word", "n")})
        tokens = _Tokens(block.to_pylist()[0])
        _, bucket, pair, word = _estimates(tokens, _counts(answers.to_pylist(), "totals" if in_turn else "core"), n, int(in_turn))
        rounded = [np.rint(STEPS * np.log2(np.maximum(p, 2.0**-60))).astype(np.int64) for p in (pair, word)]
        rows, many = np.unique(np.stack([bucket, *rounded])[:, tokens.train], axis=1, return_counts=True)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("bucket", "pair", "word", "n"), (*rows, many))})

    return count


def mixture_weights(rows: np.ndarray, uniform: float, rounds: int = 50) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each context bucket, by
    expectation-maximisation on ``(bucket, pair, word, n)`` rows."""
    weights = np.tile(START, (CONTEXTS, 1))
    weights[0] = [0, 0.8, 0.2]
    if not len(rows):  # no training token: every count is 0, and so are the estimates but the uniform one
        return weights
    rows = rows[np.lexsort(rows.T)]
    bucket, n = rows[:, 0].astype(int), rows[:, 3].astype(float)
    p = np.stack([np.where(c <= -60 * STEPS, 0, 2.0 ** (c / STEPS)) for c in rows[:, 1:3].T] + [np.full(len(rows), uniform)], axis=1)
    for _ in range(rounds):
        part = weights[bucket] * p
        part *= (n / part.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], CONTEXTS) for k in range(3)], axis=1) + weights * 1e-3
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def _scored(weights: np.ndarray, n: int, distinct: int):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        tokens = _Tokens(row)
        count, bucket, pair, word = _estimates(tokens, _counts(answers.to_pylist(), "totals"), n)
        mixed = np.log10(weights[bucket, 0] * pair + weights[bucket, 1] * word + weights[bucket, 2] / (distinct + 1))
        base = np.log10((count + 0.5) / (n + 0.5 * (distinct + 1)))
        at = words.starts(tokens.counts)[:-1]
        sums = [np.add.reduceat(x, at) for x in ((count > 0).astype(np.int64), base, mixed)]
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), "train": pa.array(row["train"], pa.bool_()), "n_tokens": tokens.counts, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    return score


def lm_scores(docs: DataFrame, held_out_column: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts under a model of the rows whose ``held_out_column`` is false.

    Tokens are the words, A-Z lower-cased, and an end.  Returns ``doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score`` (smoothed single
    words) and ``score`` (the model), both log10 probabilities of the text.

    * Null or wordless text: the end alone.  Null ids are scored like others;
      a null ``held_out_column`` counts as false.  Repeated rows count as often
      as they occur and get equal scores.
    * No training rows: every token is unknown and gets the uniform part.  Too
      few to hold a text out: each training token is held out of the others.
    * Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    train, text = ~F.coalesce(F.col(held_out_column), F.lit(False)), F.col(text_col).cast("string")
    apart = train & (F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(HELD_OUT)) == 0)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), train.alias("train"), apart.alias("held"), text.alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = int(np.clip(total // 100, *BLOCK_BYTES))
    blocks = scratch.keep(given.mapInArrow(_blocked(size), _BLOCK), "blocks")
    n, n_held, n_blocks = (int(x or 0) for x in blocks.agg(F.sum("n_train"), F.sum("n_held"), F.count("*")).first())
    ranges = max(1, total // BYTES_PER_RANGE)
    asked = blocks.mapInArrow(_asked(min(ranges, PARTS)), _MESSAGE)
    if ranges <= PARTS:
        answers = scratch.keep(asked.groupBy("level", "part").applyInArrow(_answered, _ANSWER), "answers")
    else:
        finer = -(-ranges // PARTS)
        asked = scratch.keep(asked.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // TEAM)))), "asked")
        team = ["level", "part", "team"]
        told = asked.groupBy(*team).applyInArrow(_merged(PARTS, finer), _MESSAGE).groupBy("level", "part").applyInArrow(_answered, _ANSWER)
        told = told.withColumn("team", F.col("block")).withColumn("coarse", F.floor(F.col("part") / finer).cast("int"))
        answers = scratch.keep(asked.groupBy(*team).cogroup(told.groupBy("level", "coarse", "team")).applyInArrow(_handed_out, _ANSWER), "answers")
        scratch.drop("asked")
    distinct = answers.where("level = 1").agg(F.sum("known")).first()[0] or 0

    in_turn = not n_held
    some = blocks.where("n_train > 0") if in_turn else blocks.where("n_held > 0").mapInArrow(_held_part, "block long, counts binary, vocabulary binary, ids binary")
    told = answers.select("block", "level", "part", "totals" if in_turn else "core")
    held = some.groupBy("block").cogroup(told.groupBy("block"))
    rounded = held.applyInArrow(_held_out(n - (1 if in_turn else n_held), in_turn), "bucket long, pair long, word long, n long")
    rows = rounded.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()  # a bounded grid
    weights = mixture_weights(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4), 1 / (distinct + 1))

    asking = answers.select("block", "level", "part", "totals").groupBy("block")
    scored = blocks.groupBy("block").cogroup(asking).applyInArrow(_scored(weights, n, distinct), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias(held_out_column), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
