"""Cleaning labelled samples, splitting, fitting and calibrating the spam model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from modlark.functions.text import strip
from modlark.operators import bayes
from modlark.sources.shared import job_folder, written


def clean(samples: DataFrame) -> DataFrame:
    """Labelled messages without nulls, blanks, contradictions and repeats.

    A message with both labels goes altogether; the labels of a message and
    the samples of a pair meet in one aggregation, on the message."""
    some = samples.where(F.col("message").isNotNull() & F.col("label").isNotNull()).where(strip(F.col("message")) != "")
    one = some.groupBy("message").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
    return one.where("label = _most").drop("_most").select("message", "label")


def class_balance(samples: DataFrame, least: int = 30) -> DataFrame:
    """``(label, n, share, enough)``."""
    counts = samples.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_total")).alias("share"), (F.col("n") >= least).alias("enough"))


def require_balance(samples: DataFrame, least: int = 30) -> None:
    rows = class_balance(samples, least).collect()  # a row per label
    if len(rows) < 2 or not all(r.enough for r in rows):
        raise ValueError(f"each label needs {least} samples: {[(r.label, r.n) for r in rows]}")


def split(samples: DataFrame, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``part``, train or test: the hash of a message decides, so that a
    split of any size needs no shuffle, is the same in every run and keeps
    classes in proportion."""
    h = F.conv(F.substring(F.sha2(F.concat(F.col("message"), F.lit(f"#{seed}")), 256), 1, 8), 16, 10).cast("long")
    return samples.withColumn("part", F.when(h < F.lit(int(fraction * 2**32)), "train").otherwise("test"))


def balanced_weights(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes x n of the class)."""
    counts = rows.groupBy(label_col).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(F.broadcast(total)).select(label_col, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label_col)  # a row per class


def fit_logistic(rows: DataFrame, features_col: str = "features", label_col: str = "label", max_iter: int = 200) -> LogisticRegressionModel:
    """A logistic model with balanced classes and an L2 penalty of 1/n."""
    data = balanced_weights(rows, label_col).select(array_to_vector(F.col(features_col)).alias("features"), F.col(label_col).cast("double").alias("label"), "weight")
    n = max(1, data.count())
    return LogisticRegression(weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(data)


def raw_score(features: Column, model: LogisticRegressionModel) -> Column:
    parts = F.zip_with(features, F.array(*(F.lit(float(c)) for c in model.coefficients)), lambda x, c: x * c)
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) + F.lit(float(model.intercept))


def fit_platt(scored: DataFrame, score_col: str = "raw", label_col: str = "label") -> tuple[float, float]:
    """Slope and intercept of a sigmoid on raw scores.

    Targets are smoothed by the classes' sizes, as two weighted rows per sample."""
    n = {int(r[label_col]): r["count"] for r in scored.groupBy(label_col).count().collect()}
    high, low = (n.get(1, 0) + 1) / (n.get(1, 0) + 2), 1 / (n.get(0, 0) + 2)
    target = F.when(F.col(label_col) == 1, high).otherwise(low)
    both = scored.select(F.col(score_col).alias("x"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w")))).alias("t")).select("x", "t.*")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(both)
    model = LogisticRegression(weightCol="w", regParam=0.0, maxIter=100).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


@dataclass
class Calibrated:
    """Logistic models with a sigmoid each; the probability is their mean."""

    parts: list[tuple[list[float], float, float, float]]

    def probability(self, features: Column) -> Column:
        total = F.lit(0.0)
        for coefficients, intercept, slope, shift in self.parts:
            z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, coefficients)), lambda x, c: x * c), F.lit(0.0), lambda a, b: a + b) + intercept
            total = total + 1.0 / (1.0 + F.exp(-(z * slope + shift)))
        return total / len(self.parts)


def calibrate(rows: DataFrame, id_col: str, folds: int = 3) -> Calibrated:
    """Fit on all folds but one, put a sigmoid on that one's scores, for each."""
    dealt = rows.withColumn("_fold", F.pmod(F.xxhash64(id_col), F.lit(folds))).persist()
    parts = []
    for k in range(folds):
        model = fit_logistic(dealt.where(F.col("_fold") != k))
        held = dealt.where(F.col("_fold") == k).withColumn("raw", raw_score(F.col("features"), model))
        parts.append(([float(c) for c in model.coefficients], float(model.intercept), *fit_platt(held)))
    dealt.unpersist()
    return Calibrated(parts)


def isotonic(fitted: DataFrame, score_col: str, applied: DataFrame, label_col: str = "label", points: int = 100_000) -> DataFrame:
    """Rows of ``applied`` with ``calibrated``, a monotone function of the score
    that is fitted to the labels of ``fitted``, between its points linear.

    Labels are averaged for each score before the fit, which gets a weighted
    point for each; of more than ``points`` scores those in one of as many
    equal ranges are one point, at their mean."""
    vector = lambda df, c: df.withColumn("_f", array_to_vector(F.array(F.col(c).cast("double"))))
    score, label = F.col(score_col).cast("double"), F.col(label_col).cast("double")
    each = written(fitted.where(score.isNotNull()).groupBy(score.alias("_x")).agg(F.avg(label).alias("_y"), F.count(label).cast("double").alias("_w")), "isotonic")
    n, low, high = each.agg(F.count("*"), F.min("_x"), F.max("_x")).first()
    if n > points:
        mean = lambda c: (F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c)
        each = written(each.groupBy(F.floor((F.col("_x") - low) * (points / (high - low))).alias("_bin")).agg(mean("_x"), mean("_y"), F.sum("_w").alias("_w")), "isotonic")
    model = IsotonicRegression(featuresCol="_f", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(vector(each, "_x"))
    return model.transform(vector(applied.where(score.isNotNull()), score_col)).drop("_f")


def predict(rows: DataFrame, model: LogisticRegressionModel, features_col: str = "features") -> DataFrame:
    """Add ``p_spam`` by the fitted pipeline stage."""
    out = model.setFeaturesCol("_v").transform(rows.withColumn("_v", array_to_vector(F.col(features_col))))
    return out.withColumn("p_spam", vector_to_array("probability")[1]).select(*rows.columns, "p_spam")


def _char_codes(text: str) -> np.ndarray:
    """The runs of `bayes.char_tokens` in a lower-cased text, words parted by blanks,
    as numbers: three code points of 21 bits each, that lie as the runs do in order."""
    words = [w for w in text.split(" ") if w]
    if not words:
        return np.zeros(0, "int64")
    s = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), "<u4").astype("int64") + 1  # 0: no character
    between = (s[:-1] == 33) & (s[1:] == 33)  # two blanks: of two words
    one, mid = s << 42, s << 21
    return np.concatenate([one, (one[:-1] | mid[1:])[~between], (one[:-2] | mid[1:-1] | s[2:])[~(between[:-1] | between[1:])]])


def _lists(lengths, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32")), pa.array(flat))


def _in_parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``terms`` and ``tfs`` in place of the text: its character runs,
    as numbers, and how often each occurs.  Each text is cut in its own row; nothing
    is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            held = [np.unique(_char_codes(t), return_counts=True) for t in batch.column(text_col).to_pylist()]
            lengths, (terms, tfs) = [len(t) for t, _ in held], map(np.concatenate, zip(*held))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), _lists(lengths, terms), _lists(lengths, tfs.astype("int32"))], names=[*others, "terms", "tfs"])

    others = [c for c in docs.columns if c != text_col]
    lowered = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"(?U)\s+", " ")
    schema = StructType([*(docs.schema[c] for c in others), *StructType.fromDDL("terms array<long>, tfs array<int>")])
    return docs.select(*others, lowered.alias(text_col)).mapInArrow(count, schema)


def char_vectors(counted: DataFrame, weights: list[tuple[int, float]], size: int) -> DataFrame:
    """Rows of `char_counts` with sparse ``features`` in place of their terms, of
    length 1: (1 + ln tf) x idf of each (term, idf) in ``weights``, at its place there."""
    order = np.argsort([t for t, _ in weights]) if weights else np.zeros(0, "int64")
    vocabulary = np.array([t for t, _ in weights], "int64")[order]
    idfs = np.array([idf for _, idf in weights], "float64")[order]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            n, terms, tfs = batch.num_rows, batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            flat, row = terms.flatten().to_numpy(), np.repeat(np.arange(n), terms.value_lengths().to_numpy())
            met = np.searchsorted(vocabulary, flat)
            known = np.flatnonzero(vocabulary[np.minimum(met, len(vocabulary) - 1)] == flat) if len(vocabulary) else np.zeros(0, "int64")
            met, row = met[known], row[known]
            w, at = (1.0 + np.log(tfs[known])) * idfs[met], order[met]
            w, by_place = w / np.sqrt(np.bincount(row, w * w, n))[row], np.lexsort((at, row))
            lengths = np.bincount(row, minlength=n)
            stored = [pa.array(np.zeros(n, "int8")), pa.array(np.full(n, size, "int32")), _lists(lengths, at[by_place].astype("int32")), _lists(lengths, w[by_place])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.StructArray.from_arrays(stored, names=["type", "size", "indices", "values"])], names=[*others, "features"])

    others = [c for c in counted.columns if c not in ("terms", "tfs")]
    schema = StructType([*(counted.schema[c] for c in others), *StructType.fromDDL("features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")])
    return counted.mapInArrow(weigh, schema)


def _as_vectors(told: DataFrame) -> DataFrame:
    """``told``, written once: a sparse vector is stored as a struct of its size,
    places and values, and read as a vector."""
    path = f"{job_folder(told.sparkSession, 'sparse')}/table"
    told.write.parquet(path)
    schema = StructType([f if f.name != "features" else StructField("features", VectorUDT()) for f in told.schema.fields])
    return told.sparkSession.read.schema(schema).parquet(path)


def char_model(docs: DataFrame, fitted_on: Column, terms: int = 10_000) -> DataFrame:
    """``(id, label, p_spam)`` of ``docs`` (id, text, label): TF-IDF of character
    runs within words (tf by its logarithm, the ``terms`` most frequent ones),
    and a balanced logistic model of the rows where ``fitted_on`` holds.

    Texts are cut once and counts are written, a row for each text; of those only
    the numbers of texts by term are shuffled."""
    counted = written(char_counts(docs.select("id", "label", fitted_on.alias("_train"), "text")), "char-counts")
    train = counted.where("_train")
    each = train.select(F.explode("terms").alias("term"))
    top = bayes.idf(each, train.count()).orderBy(F.desc("df"), "term").limit(terms).collect()  # `terms` rows
    rows = _as_vectors(char_vectors(counted, [(r["term"], r["idf"]) for r in top], terms))
    data = balanced_weights(rows.where("_train")).withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(weightCol="weight", regParam=1.0 / max(1, data.count()), standardization=False, maxIter=100).fit(data)
    return model.transform(rows).select("id", "label", F.col("_train").alias("fitted"), vector_to_array("probability")[1].alias("p_spam"))


#: What the boosted trees see of a message: pattern features alone.
PATTERN_FEATURES = (
    "has_phone", "has_url", "has_email", "has_money", "money_count", "has_age", "has_cta_plus", "has_dm", "has_contact", "has_remote", "has_legal", "has_casino", "obfuscation_ratio",
    "whitelist_hits_store", "whitelist_hits_order", "whitelist_hits_brand", "reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement", "text_length",
)


def pattern_trees(rows: DataFrame, fitted_on: Column, names: tuple[str, ...] = PATTERN_FEATURES, rounds: int = 100, depth: int = 5) -> DataFrame:
    """Rows with ``p_spam``: boosted trees on pattern features, fitted where
    ``fitted_on`` holds, on two thirds of which the trees grow and on the rest
    their scores are made probabilities by an isotonic function."""
    given = rows.withColumn("_train", fitted_on).withColumn("_third", F.pmod(F.xxhash64("id"), F.lit(3)))
    vector = array_to_vector(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in names)))
    given = written(given.withColumn("_v", vector), "trees-rows")
    grown = GBTClassifier(featuresCol="_v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=7).fit(given.where(F.col("_train") & (F.col("_third") > 0)))
    scored = grown.transform(given).withColumn("_raw", vector_to_array("probability")[1])
    out = isotonic(scored.where(F.col("_train") & (F.col("_third") == 0)), "_raw", scored)
    return out.select(*rows.columns, F.col("_train").alias("fitted"), F.col("calibrated").alias("p_spam"))


def examples(samples: DataFrame, n: int, low: int, high: int, seed: str) -> DataFrame:
    """``n`` spam examples of a middling length, in a hashed order."""
    chosen = samples.where((F.col("label") == 1) & F.length("message").between(low, high))
    return chosen.withColumn("_by", F.sha2(F.concat(F.col("message"), F.lit(seed)), 256)).orderBy("_by", "message").limit(n).drop("_by")

