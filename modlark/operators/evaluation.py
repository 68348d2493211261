"""Metrics of scores and decisions, as aggregations.

Curves work on the distinct scores, which are aggregated before they are
ordered; one row holds all of a score's counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accuracy(df: DataFrame, predicted: str, label: str, by: str | None = None) -> DataFrame:
    hit = F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy")
    return (df.groupBy(by) if by else df).agg(hit)


def brier(df: DataFrame, p: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"))


def precision_at(df: DataFrame, p: str, label: str, level: float) -> DataFrame:
    """Null if nothing reaches the level."""
    reached = F.col(p) >= level
    return df.agg(F.avg(F.when(reached, F.col(label).cast("double"))).alias("precision"), F.count(F.when(reached, 1)).alias("n"))


def confusion(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """``(label, predicted_0, predicted_1)``."""
    return df.groupBy(label).agg(*(F.count(F.when(F.col(predicted) == k, 1)).alias(f"predicted_{k}") for k in (0, 1)))


def class_report(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their macro and
    weighted means; a division by 0 gives 0."""

    def one(k: int):
        tp = F.count(F.when((F.col(predicted) == k) & (F.col(label) == k), 1))
        made, there = F.count(F.when(F.col(predicted) == k, 1)), F.count(F.when(F.col(label) == k, 1))
        ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
        p, r = ratio(tp, made), ratio(tp, there)
        return F.struct(F.lit(str(k)).alias("name"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), there.alias("support"))

    rows = df.agg(F.array(one(0), one(1)).alias("c"))
    total = F.col("c")[0]["support"] + F.col("c")[1]["support"]

    def mean(name: str, weighted: bool):
        parts = []
        for f in ("precision", "recall", "f1"):
            x, y = F.col("c")[0], F.col("c")[1]
            both = F.coalesce(F.try_divide(x[f] * x["support"] + y[f] * y["support"], total), F.lit(0.0)) if weighted else (x[f] + y[f]) / 2
            parts.append(both.cast("double").alias(f))
        return F.struct(F.lit(name).alias("name"), *parts, total.alias("support"))

    return rows.select(F.explode(F.array(F.col("c")[0], F.col("c")[1], mean("macro", False), mean("weighted", True))).alias("r")).select("r.*")


def _by_score(df: DataFrame, p: str, label: str) -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def _ranged(scores: DataFrame, ranges: int = 256) -> DataFrame:
    """Add ``_range``, the scores' place among approximate quantiles: ranges
    hold about as many distinct scores each, wherever those crowd."""
    borders = sorted(set(scores.approxQuantile("p", [k / ranges for k in range(1, ranges)], 1e-3)))
    return scores.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<double>"), lambda b: b <= F.col("p"))))


def _running(scores: DataFrame, ascending: bool) -> DataFrame:
    """Sums of ``pos`` and ``neg`` over the scores before and with each one.

    Scores are cut into ranges first: sums run within a range, and the ranges'
    totals are added, so that no task holds all scores."""
    cut = _ranged(scores)
    order = F.col("p").asc() if ascending else F.col("p").desc()
    inside = Window.partitionBy("_range").orderBy(order)
    edge = F.col("_range").asc() if ascending else F.col("_range").desc()
    totals = cut.groupBy("_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    before = Window.orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select("_range", F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_pos"), F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_neg"))
    out = cut.join(F.broadcast(totals), "_range")
    return out.select("p", "pos", "neg", (F.sum("pos").over(inside) + F.col("_pos")).alias("tp"), (F.sum("neg").over(inside) + F.col("_neg")).alias("fp"), "_range")


def roc_auc(df: DataFrame, p: str, label: str) -> DataFrame:
    """The chance that a spam scores above a ham, ties counting half."""
    run = _running(_by_score(df, p, label), ascending=True)
    below = F.col("fp") - F.col("neg") / 2
    total = run.agg(F.sum(F.col("pos") * below).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return total.select(F.try_divide(F.col("u"), F.col("np") * F.col("nn")).cast("double").alias("roc_auc"))


def pr_curve(df: DataFrame, p: str, label: str) -> DataFrame:
    """``(threshold, precision, recall)`` for every distinct score."""
    return _curve(df, p, label).drop("_range")


def _curve(df: DataFrame, p: str, label: str) -> DataFrame:
    scores = _by_score(df, p, label)
    total = scores.agg(F.sum("pos").alias("_all"))
    run = _running(scores, ascending=False).crossJoin(F.broadcast(total))  # one row
    return run.select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("_all")).alias("recall"), "_range")


def pr_auc(df: DataFrame, p: str, label: str) -> DataFrame:
    """Trapezoids under the curve, which ends in precision 1 at recall 0."""
    curve = _curve(df, p, label)
    inside = Window.partitionBy("_range").orderBy(F.desc("threshold"))
    last = curve.groupBy("_range").agg(F.min_by(F.struct("precision", "recall"), "threshold").alias("_last"))
    before = F.lag("_last").over(Window.orderBy(F.desc("_range")))  # a row per range
    ends = last.select("_range", F.coalesce(before, F.struct(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))).alias("_before"))
    point = F.struct("precision", "recall")
    stepped = curve.join(F.broadcast(ends), "_range").withColumn("_prev", F.coalesce(F.lag(point).over(inside), F.col("_before")))
    area = (F.col("recall") - F.col("_prev.recall")) * (F.col("precision") + F.col("_prev.precision")) / 2
    return stepped.agg(F.sum(area).alias("pr_auc"))


def training_report(df: DataFrame, p: str, predicted: str, label: str, part: str | None = None, level: float = 0.85) -> DataFrame:
    """``(metric, value)``: rows in all, per class and per ``part``, the curves'
    areas, Brier score, precision at a level, confusion, and the report of the
    classes."""
    counts = df.groupBy(F.concat(F.lit("rows_label_"), F.col(label).cast("string")).alias("metric")).agg(F.count("*").cast("double").alias("value"))
    if part:
        counts = counts.unionByName(df.groupBy(F.concat(F.lit("rows_"), F.col(part)).alias("metric")).agg(F.count("*").cast("double").alias("value")))
    single = report(df.agg(F.count("*").alias("rows")), roc_auc(df, p, label), pr_auc(df, p, label), brier(df, p, label), precision_at(df, p, label, level).select(F.col("precision").alias("precision_at")), accuracy(df, predicted, label))
    told = lambda table, key, cols: table.select(key.alias("key"), F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("value")) for c in cols))).alias("r")).select(F.concat_ws("_", "key", "r.c").alias("metric"), "r.value")
    confused = told(confusion(df, predicted, label), F.concat(F.lit("label_"), F.col(label).cast("string")), ("predicted_0", "predicted_1"))
    classes = told(class_report(df, predicted, label), F.col("name"), ("precision", "recall", "f1", "support"))
    return reduce(DataFrame.unionByName, (counts, single, confused, classes))


def report(*metrics: DataFrame) -> DataFrame:
    """One-row metric tables as ``(metric, value)`` rows."""
    parts = [m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in m.columns))).alias("r")).select("r.*") for m in metrics]
    return reduce(DataFrame.unionByName, parts)


def error_rates(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """False-positive and false-negative rates, and the threshold steps that
    they call for: up by 0.05 above 7 % of the first, else down by 0.03 above
    14 % of the second."""
    rate = lambda wrong, there: F.coalesce(F.try_divide(F.count(F.when(wrong & there, 1)), F.count(F.when(there, 1))), F.lit(0.0))
    rates = df.agg(rate(F.col(predicted) == 1, F.col(label) == 0).alias("fp_rate"), rate(F.col(predicted) == 0, F.col(label) == 1).alias("fn_rate"))
    return rates.withColumn("step", F.when(F.col("fp_rate") > 0.07, 0.05).when(F.col("fn_rate") > 0.14, -0.03).otherwise(0.0))


def grey_zone(df: DataFrame, p: str, low: float = 0.60, high: float = 0.75) -> DataFrame:
    """Rows whose score is between two levels, the least certain first by ``priority``."""
    return df.where((F.col(p) > low) & (F.col(p) < high)).withColumn("priority", F.abs(F.col(p) - 0.5))
