"""A stratified split of exact size, without a sort.

Rows go by the hash of their message; in each class those with the smallest
hashes are for training.  The border is found by counting hash prefixes, then
the hashes below the prefix that holds it: two passes of a map-side
aggregation.  Equal messages have equal hashes; where the border lies among
copies of one message, the place of a row in its file tells which are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlark.sources.shared import written

PREFIX = 4


def _border(counts: DataFrame, by: str) -> DataFrame:
    """For each label the value of ``by`` that holds its ``wanted``-th row, and how
    many of that value's rows are wanted.  ``counts`` has a row for each value, of
    at most 65,536 prefixes or of the hashes of one prefix."""
    upto = F.sum("n").over(Window.partitionBy("label").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    return found.select("label", F.col(by).alias("border"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))


def exact_split(samples: DataFrame, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """``samples`` (message, label) with ``part``: in each class ``round(fraction * n)``
    rows are train, the others test.

    Null messages count as empty ones, null labels as a class; an empty table
    stays empty.  The same rows are split alike in every run; of equal messages
    some may be in either part."""
    hashed = samples.withColumn("_hash", F.sha2(F.concat(F.coalesce("message", F.lit("")), F.lit(f"#{seed}")), 256)).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    rows = written(hashed.withColumn("_id", F.monotonically_increasing_id()), "split")
    slim = rows.select(F.col("_label").alias("label"), F.col("_hash").alias("hash"))
    prefixes = slim.groupBy("label", F.substring("hash", 1, PREFIX).alias("prefix")).agg(F.count("*").alias("n"))
    sizes = prefixes.groupBy("label").agg(F.round(F.sum("n") * F.lit(fraction)).cast("long").alias("wanted"))
    first = written(_border(prefixes.join(F.broadcast(sizes), "label"), "prefix"), "split-prefixes")  # a row for each class
    inside = slim.join(F.broadcast(first), (slim["label"] == first["label"]) & (F.substring("hash", 1, PREFIX) == F.col("border"))).select(slim["label"], "hash", "wanted")
    last = written(_border(inside.groupBy("label", "hash", "wanted").agg(F.count("*").alias("n")), "hash"), "split-borders")
    at = last.select(F.col("label").alias("_label"), F.col("border").alias("_border"), F.col("wanted").alias("_wanted"))
    met = rows.join(F.broadcast(at), "_label", "left").withColumn("_file", F.shiftright("_id", 33))
    # copies of the border's message, numbered by file: how many there are before each one's partition
    copies = met.where("_hash = _border")
    tallies = written(copies.groupBy("_label", "_file").agg(F.count("*").alias("n"), F.max("_wanted").alias("_wanted")), "split-copies")
    before = F.sum("n").over(Window.partitionBy("_label").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    quota = tallies.select("_label", "_file", F.greatest(F.least(F.col("_wanted") - F.coalesce(before, F.lit(0)), "n"), F.lit(0)).alias("_quota"), "n")
    whole = met.join(F.broadcast(quota), ["_label", "_file"], "left")
    sure = F.when(F.col("_border").isNull() | (F.col("_hash") > F.col("_border")), "test").when(F.col("_hash") < F.col("_border"), "train").when(F.col("_quota") == F.col("n"), "train").when(F.col("_quota") == 0, "test")
    decided = written(whole.withColumn("part", sure), "split-decided")
    # one file a class is cut between copies; they are equal, and a window over that file's copies alone tells them apart
    cut = decided.where("part is null").withColumn("part", F.when(F.row_number().over(Window.partitionBy("_label", "_file").orderBy("_id")) <= F.col("_quota"), "train").otherwise("test"))
    return decided.where("part is not null").unionByName(cut).select(*samples.columns, "part")
