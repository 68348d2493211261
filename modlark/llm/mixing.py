"""Mixing sources to target weights by temperature.

Source shares p are raised to a power alpha and normalised.  Alpha is bisected
in [0, 1] (0: all sources alike, 1: shares as they are) for the flattest mix
that keeps to a repetition limit, or for a target entropy.  The budget is then
realised in passes over blocks of documents: every whole pass of a source has
all its blocks, the last one has the first blocks of a permutation of its own,
and one block is cut where the budget ends.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modlark.llm.scratch import Scratch

#: Blocks of a source, a power of two.
N_BLOCKS = 4096
#: Plans of more sources than this are joined by a shuffle, not broadcast.
MAX_BROADCAST = 50_000
_STEPS = 60
#: Columns that a mix has besides those of its documents.
ADDED = ("epoch", "mix_position", "source_weight", "alpha")


def weights(share: np.ndarray, alpha: float) -> np.ndarray:
    """Shares to the power ``alpha``, normalised; a share of 0 stays 0."""
    raised = np.where(share > 0, np.maximum(share, 1e-300) ** alpha, 0.0)
    return raised / max(raised.sum(), 1e-300)


def entropy(weight: np.ndarray) -> float:
    some = weight[weight > 0]
    return float(-(some * np.log(some)).sum())


def passes(tokens: np.ndarray, weight: np.ndarray, budget: float | None) -> np.ndarray:
    """How often each source is read.  Without a budget, the smallest one is
    taken that reads every source once at least."""
    some = tokens > 0
    if budget is None:
        budget = float((tokens[some] / weight[some]).max()) if some.any() else 0.0
    return np.where(some, weight * budget / np.maximum(tokens, 1), 1.0)


def solve(tokens: np.ndarray, max_passes: float | None, target_entropy: float | None, budget: float | None = None) -> float:
    """The smallest alpha within the repetition limit and, if one is given, not
    above the target entropy."""
    share = tokens / max(tokens.sum(), 1)

    def bisect(holds) -> float:
        low, high = 0.0, 1.0
        if holds(low):
            return low
        for _ in range(_STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if holds(mid) else (mid, high)
        return high

    found = [0.0]
    if max_passes is not None:
        found.append(bisect(lambda a: passes(tokens, weights(share, a), budget).max(initial=0) <= max_passes * (1 + 1e-12)))
    if target_entropy is not None:
        found.append(bisect(lambda a: entropy(weights(share, a)) <= target_entropy))
    return max(found) if max_passes is not None or target_entropy is not None else 1.0


def n_words(text: Column) -> Column:
    """Words of a text (null: 0), the measure of a document's tokens."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _spread(*parts: Column) -> Column:
    """A fraction in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _rank(source: Column, block: Column, turn: Column) -> Column:
    """A block's place in the permutation of its source's ``turn``-th pass."""
    factor = F.pmod(F.xxhash64(source, turn, F.lit("factor")), F.lit(N_BLOCKS)).bitwiseOR(F.lit(1))
    return F.pmod(block * factor + F.pmod(F.xxhash64(source, turn, F.lit("shift")), F.lit(N_BLOCKS)), F.lit(N_BLOCKS))


def mix(docs: DataFrame, max_passes: float | None = 2.0, target_entropy: float | None = None, budget_tokens: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Repeat and drop documents until their sources have the weights sought.

    Returns the columns of ``docs`` with ``epoch`` (from 1: the pass that a row
    belongs to), ``mix_position`` (in [0, 1): sorting by it mixes the sources),
    ``source_weight`` and ``alpha``; such columns of ``docs`` are replaced.
    Without a budget every row is returned once at least.

    * A null source is a source of its own.  A source without any words is
      read once.  Null text: no words.
    * Null ids share a block of their source, and rows that repeat an id stay
      together, in any pass.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit("block")), F.lit(N_BLOCKS))
    rows = docs.select(source.alias("source"), block.alias("block"), F.col(id_col).alias("id"), n_words(F.col(text_col).cast("string")).alias("tokens"))
    rows = scratch.keep(rows, "rows")
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()  # a row per source
    names, tokens = [r.source for r in totals], np.array([r.tokens for r in totals], float)
    alpha = solve(tokens, max_passes, target_entropy, budget_tokens)
    weight = weights(tokens / max(tokens.sum(), 1), alpha)
    turns = passes(tokens, weight, budget_tokens)
    whole = np.floor(turns + 1e-9).astype(int)
    part = np.where(turns - whole > 1e-9, (turns - whole) * tokens, 0.0)
    plan = spark.createDataFrame([(n, int(w), float(p), float(q)) for n, w, p, q in zip(names, whole, part, weight)], "source string, whole int, part double, source_weight double")

    # the last pass: its first blocks, and where it ends in the next one
    rank = _rank(F.col("source"), F.col("block"), F.col("whole") + 1)
    ranked = blocks.join(_sized(plan, len(names)), "source").withColumn("rank", rank)
    upto = Window.partitionBy("source").orderBy("rank")
    ranked = ranked.withColumn("upto", F.sum("tokens").over(upto))
    edge = ranked.where("upto > part and upto - tokens <= part").groupBy("source").agg(F.min("rank").alias("edge"), F.min_by(F.col("part") - F.col("upto") + F.col("tokens"), "rank").alias("left"), F.min_by("block", "rank").alias("block"))
    inside = rows.join(_sized(edge, len(names)), ["source", "block"])
    order = _spread(F.col("id"), F.lit("within"))
    filled = inside.withColumn("at", order).withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("at")))
    cut = filled.where("upto <= left").groupBy("source").agg(F.max("at").alias("cut"))
    plan = scratch.keep(plan.join(edge.select("source", "edge"), "source", "left").join(cut, "source", "left"), "plan")
    scratch.drop("rows")

    own = [c for c in docs.columns if c not in ADDED]
    keyed = docs.select(F.struct(*own).alias("_row"), source.alias("_source"), block.alias("_block"), _spread(F.col(id_col), F.lit("within")).alias("_at"))
    plan = plan.select(F.col("source").alias("_source"), *(F.col(c).alias(f"_{c}") for c in ("whole", "part", "edge", "cut", "source_weight")))
    met = keyed.join(_sized(plan, len(names)), "_source")
    last = _rank(F.col("_source"), F.col("_block"), F.col("_whole") + 1)
    more = (last < F.col("_edge")) | ((last == F.col("_edge")) & (F.col("_at") <= F.col("_cut")))
    n = F.col("_whole") + F.when((F.col("_part") > 0) & more, 1).otherwise(0)
    each = met.withColumn("_n", n).where("_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    place = (F.col("epoch") - 1 + (_rank(F.col("_source"), F.col("_block"), F.col("epoch")) + F.col("_at")) / N_BLOCKS) / F.ceil(F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0))
    return each.select("_row.*", "epoch", place.alias("mix_position"), F.col("_source_weight").alias("source_weight"), F.lit(float(alpha)).alias("alpha"))


def _sized(plan: DataFrame, n: int) -> DataFrame:
    """A table of a row per source, broadcast if they are few enough."""
    return F.broadcast(plan) if n <= MAX_BROADCAST else plan
