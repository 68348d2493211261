"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hooks its neighbours (``large``: those above
    it, else those below it and itself) to the smallest node that it sees.

    Minima are aggregated before the shuffle and joined back, so that a hub
    with many neighbours is not gathered in a task.
    """
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    seen = edges.unionByName(swapped) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hooked = seen.join(least, "a")
    if large:
        hooked = hooked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hooked = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hooked.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` of every node on an edge ``(a long, b long)``; the root
    is the component's smallest node.

    Each round is written to the shared folder; rounds grow with the logarithm
    of a component's width.  Self-loops and repeated edges change nothing; no
    edges give no rows.
    """
    now = scratch.keep(edges.where("a <> b").distinct(), "edges0")
    mark, n = None, 0
    while True:
        then, n = mark, n + 1
        after = scratch.keep(_star(_star(now, True), False), f"edges{n}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"edges{n - 1}")
        now = after
        if mark == then or not mark[0]:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
