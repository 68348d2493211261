"""Vectors: encoding, similarity, centroids, prototypes and the feature row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.util import inheritable_thread_target

from modlark.config import LEGIT_FAMILIES, SPAM_FAMILIES
from modlark.functions.text import encoder_text

Encoder = Callable[[list[str]], list[list[float] | None]]
#: Starts of K-means that run side by side, and vectors of one task of a step, about.
AT_ONCE, PER_TASK = 10, 20_000
#: Vectors that a Python worker holds as lists, about.
AT_HAND = 512


def hashed_encoder(dim: int = 64) -> Encoder:
    """A deterministic encoder: signed words by their MD5, of length 1."""
    from hashlib import md5

    def encode(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = int(md5(word.encode()).hexdigest()[:8], 16)
                v[h % dim] += 1 if h >> 31 else -1
            norm = float(np.sqrt(v @ v))
            out.append((v / norm).tolist() if norm else None)
        return out

    return encode


def _vectors(texts: pd.Series, run: Encoder, at_once: int) -> Iterator[pd.Series]:
    """Vectors of a batch of texts, for some `AT_HAND` of them at a time: a vector
    takes some ten times as much in Python as where it goes to."""

    def one(text: str) -> list[float] | None:
        try:
            return run([text])[0]
        except Exception:  # noqa: BLE001  one bad text must not lose the others
            return None

    rows = max(1, AT_HAND // at_once) * at_once
    for start in range(0, len(texts), rows):
        some = texts.iloc[start : start + rows]
        given = [t for t in some if t is not None]
        found: list[list[float] | None] = []
        for at in range(0, len(given), at_once):
            part = given[at : at + at_once]
            try:
                got = [*run(part)][: len(part)]
            except Exception:  # noqa: BLE001
                got = []
            got += [None] * (len(part) - len(got))
            found += [v if v is not None else one(t) for v, t in zip(got, part)]
        left = iter(found)
        yield pd.Series([None if t is None else next(left) for t in some], dtype=object)


def encode(df: DataFrame, text_col: str, encoder: Encoder | None = None, vec_col: str = "vec", at_once: int = 32) -> DataFrame:
    """Add a vector for each text, null where the encoder gives none or fails.

    The encoder gets ``at_once`` texts a call; vectors belong to texts by
    place, and one that is missing is null.  A call that fails is tried again
    text by text, and so is each text that got none.
    """
    run = encoder or hashed_encoder()

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield from _vectors(texts, run, at_once)

    return df.withColumn(vec_col, vectors(F.col(text_col)))


def encode_once(df: DataFrame, text_col: str, encoder: Encoder | None = None, vec_col: str = "vec") -> DataFrame:
    """As `encode`, each distinct text only once."""
    distinct = encode(df.select(text_col).where(F.col(text_col).isNotNull()).distinct(), text_col, encoder, vec_col)
    return df.join(distinct, text_col, "left")


def coverage(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """How many rows have a vector, their share, and whether it is low."""
    out = df.agg(F.count("*").alias("total"), F.count(vec_col).alias("valid"))
    return out.withColumn("coverage", F.coalesce(F.try_divide("valid", "total"), F.lit(0.0))).withColumn("low", F.col("coverage") < 0.8)


def run_stats(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """One row: texts given to the encoder, and how many of them got a vector."""
    return df.agg(F.count("*").alias("total"), F.count(vec_col).alias("successes"), F.count(F.when(F.col(vec_col).isNull(), 1)).alias("failures"))


class EncoderRun:
    """Figures of an encoding run, gathered by the run itself.

    `watch` the encoded rows, let one action run, then ask for the `stats`; no
    row is read a second time.  An action that is run again counts anew only
    for a new `EncoderRun`."""

    def __init__(self, spark: SparkSession, vec_col: str = "vec"):
        self.spark, self.vec_col, self.seen, self.began = spark, vec_col, Observation(), None

    def watch(self, encoded: DataFrame) -> DataFrame:
        vec = F.col(self.vec_col)
        self.began = time.monotonic()
        return encoded.observe(self.seen, F.count(F.lit(1)).alias("total"), F.count(vec).alias("successes"), F.count(F.when(vec.isNull(), 1)).alias("failures"))

    def stats(self) -> DataFrame:
        """``total, successes, failures`` and ``elapsed_ms`` since `watch`."""
        told = self.seen.get
        row = (told["total"], told["successes"], told["failures"], int(1000 * (time.monotonic() - self.began)))
        return self.spark.createDataFrame([row], "total long, successes long, failures long, elapsed_ms long")


class EncoderStreamRun(StreamingQueryListener):
    """The same figures of a stream, summed over its micro-batches.

    Watch the stream's rows, and add this to ``spark.streams``."""

    def __init__(self, name: str = "encoder", vec_col: str = "vec"):
        self.name, self.vec_col = name, vec_col
        self.total = self.successes = self.batches = self.elapsed_ms = 0

    def watch(self, encoded: DataFrame) -> DataFrame:
        return encoded.observe(self.name, F.count(F.lit(1)).alias("total"), F.count(self.vec_col).alias("successes"))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None:
            self.total, self.successes = self.total + told["total"], self.successes + told["successes"]
            self.batches, self.elapsed_ms = self.batches + 1, self.elapsed_ms + event.progress.batchDuration

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def degraded(capsule: Column, vec: Column, *others: Column) -> Column:
    """A capsule was there, its vector is missing; false where none of
    ``others``, the vectors of the same message, is there either, as then the
    whole batch failed."""
    some = vec.isNotNull()
    for other in others:
        some = some | other.isNotNull()
    return capsule.isNotNull() & vec.isNull() & some


def neutral_result(msg: Column, ctx: Column, user: Column) -> Column:
    """The vector filter's own result: never an opinion, only what was encoded."""
    return F.struct(F.lit(0.5).alias("score"), F.when(msg.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), ctx.isNotNull().alias("has_context"), user.isNotNull().alias("has_user"))


def encode_single(df: DataFrame, text_col: str, encoder: Encoder | None = None) -> DataFrame:
    """Add ``result``: the neutral result of each text by itself, prepared as the
    encoder wants it; where encoding fails its confidence is 0."""
    none = F.lit(None).cast("array<double>")
    out = encode(df.withColumn("_prepared", encoder_text(F.col(text_col))), "_prepared", encoder, "_vec", at_once=1)
    return out.withColumn("result", neutral_result(F.col("_vec"), none, none)).drop("_prepared", "_vec")


def with_vectors(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Rows whose vector is there."""
    return df.where(F.col(vec_col).isNotNull())


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda x, y: x + y)


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, unequal lengths and zero vectors."""
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot / norms)


def mean_vectors(df: DataFrame, by: str, vec_col: str = "vec") -> DataFrame:
    """``(by, vec)``: the mean vector of each group, nulls left out."""
    each = with_vectors(df, vec_col).select(by, F.posexplode(vec_col).alias("pos", "x"))
    means = each.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def artefacts(centroids: DataFrame, prototypes: DataFrame) -> DataFrame:
    """One wide row: ``spam`` and ``ham`` centroids and a vector per family.

    ``centroids`` has (is_spam, vec), ``prototypes`` (family, vec); missing
    ones are null, and similarities to them 0."""
    pick = lambda cond: F.max(F.when(cond, F.col("vec")))
    c = centroids.agg(pick(F.col("is_spam") == 1).alias("c_spam"), pick(F.col("is_spam") == 0).alias("c_ham"))
    return c.crossJoin(prototypes.agg(*(pick(F.col("family") == f).alias(f"p_{f}") for f in SPAM_FAMILIES + LEGIT_FAMILIES)))


def similarities(df: DataFrame, wide: DataFrame, vectors: dict[str, str]) -> DataFrame:
    """Add the similarity triple of every named vector column and, for ``msg``,
    those to the prototypes; ``wide`` is the row of `artefacts`."""
    out = df.crossJoin(F.broadcast(wide))  # one row
    for name, col in vectors.items():
        spam, ham = cosine(F.col(col), F.col("c_spam")), cosine(F.col(col), F.col("c_ham"))
        out = out.withColumn(f"sim_spam_{name}", spam).withColumn(f"sim_ham_{name}", ham).withColumn(f"delta_{name}", F.col(f"sim_spam_{name}") - F.col(f"sim_ham_{name}"))
    if "msg" in vectors:
        out = out.withColumns({f"sim_proto_{f}": cosine(F.col(vectors["msg"]), F.col(f"p_{f}")) for f in SPAM_FAMILIES + LEGIT_FAMILIES})
    return out.drop(*wide.columns)


# The names of the feature row and of the older one, in order.
FEATURES = (
    *(f"{k}_{v}" for v in ("msg", "ctx", "user") for k in ("sim_spam", "sim_ham", "delta")),
    *(f"sim_proto_{f}" for f in SPAM_FAMILIES + LEGIT_FAMILIES),
    "kw_score", "tfidf_score",
    "has_phone", "has_url", "has_email", "has_money", "money_count", "has_age", "has_cta_plus", "has_dm", "has_remote", "has_legal", "has_casino", "obfuscation_ratio",
    "reply_to_staff", "is_forwarded", "author_is_admin", "is_channel_announcement",
    "whitelist_hits_store", "whitelist_hits_order", "whitelist_hits_brand",
)
BASE_FEATURES = (
    "sim_spam", "sim_ham", "sim_diff", "kw_score", "tfidf_score", "has_money", "money_count", "has_age", "has_cta_plus", "has_dm", "has_contact", "has_remote", "has_legal", "has_casino", "obfuscation_ratio",
)


def feature_row(df: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Add ``features``: the named columns as an array of doubles, 0 for nulls and absent columns."""
    return df.withColumn("features", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in names)))


def linear_score(features: Column, coefficients: list[float], intercept: float) -> Column:
    """A logistic model's probability."""
    z = _sum(F.zip_with(features, F.array(*map(F.lit, coefficients)), lambda x, c: x * c)) + intercept
    return 1.0 / (1.0 + F.exp(-z))


def top_contributions(features: Column, coefficients: list[float], names: tuple[str, ...] = FEATURES, n: int = 5) -> Column:
    """The ``n`` largest contributions to a linear score by size, ties by name."""
    parts = F.zip_with(F.array(*map(F.lit, names)), F.zip_with(features, F.array(*map(F.lit, coefficients)), lambda x, c: x * c), lambda k, x: F.struct((-F.abs(x)).alias("by"), k.alias("name"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(parts), 1, n), lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))


def base_features(df: DataFrame) -> DataFrame:
    """The older row: similarities of the message, no filter scores, and patterns."""
    old = {"sim_spam": "sim_spam_msg", "sim_ham": "sim_ham_msg", "sim_diff": "delta_msg"}
    named = df.withColumns({k: F.col(v) for k, v in old.items()} | {"kw_score": F.lit(0.0), "tfidf_score": F.lit(0.0)})
    return feature_row(named, BASE_FEATURES)


def model_info(centroids: DataFrame, prototypes: DataFrame, fitted_at: Column, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: number of features, date, what is there of the artefacts, and
    whether that is enough to score."""
    c = centroids.where("is_spam in (0, 1)").agg(F.count("*").alias("centroids"))
    p = prototypes.where(F.col("family").isin(*SPAM_FAMILIES, *LEGIT_FAMILIES)).agg(F.count("*").alias("prototypes"))
    row = c.crossJoin(F.broadcast(p))  # one row each
    return row.select(F.lit(len(features)).alias("n_features"), fitted_at.alias("fitted_at"), "centroids", "prototypes", (F.col("centroids") == 2).alias("ready"))


def kmeans_prototypes(df: DataFrame, families: tuple[str, ...], vec_col: str = "vec", seed: int = 42, starts: int = 10) -> DataFrame:
    """``(family, vec)``: the centres of as many clusters as there are families,
    the best of some starts; too few rows give the mean for all of them."""
    spark = df.sparkSession
    rows = df.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col)).alias("features"))
    n = rows.count()
    parts = min(2 * spark.sparkContext.defaultParallelism, 1 + n // PER_TASK)  # a table of vectors is few files, and each step reads all of them
    rows = rows.repartition(parts).persist()
    if n < len(families):
        mean = mean_vectors(df.withColumn("all", F.lit(1)), "all", vec_col).select("vec")
        centres = None
    else:
        fit = lambda i: KMeans(k=len(families), seed=seed + i, maxIter=100, tol=1e-9).fit(rows)
        with ThreadPoolExecutor(AT_ONCE) as pool:  # a step of one start is a short job that leaves cores idle
            models = list(pool.map(inheritable_thread_target(fit), range(starts)))
        centres = min(models, key=lambda m: m.summary.trainingCost).clusterCenters()
    rows.unpersist()
    names = spark.createDataFrame([(f,) for f in families], "family string")
    if centres is None:
        return names.crossJoin(mean)
    return spark.createDataFrame([(f, c.tolist()) for f, c in zip(families, centres)], "family string, vec array<double>")


def assigned(df: DataFrame, prototypes: DataFrame, id_col: str, vec_col: str = "vec") -> DataFrame:
    """``(id, vec, family, distance)``: each vector's nearest prototype, ties by name."""
    p = prototypes.agg(F.collect_list(F.struct("family", F.col("vec").alias("centre"))).alias("_centres"))  # a struct per family
    far = lambda c: F.sqrt(_sum(F.zip_with(F.col(vec_col), c["centre"], lambda x, y: (x - y) * (x - y))))
    near = with_vectors(df, vec_col).select(id_col, vec_col).crossJoin(F.broadcast(p))  # one row
    best = near.withColumn("_b", F.array_min(F.transform("_centres", lambda c: F.struct(far(c).alias("distance"), c["family"].alias("family")))))
    return best.where(F.size("_centres") > 0).select(id_col, vec_col, F.col("_b.family").alias("family"), F.col("_b.distance").alias("distance"))


def representatives(df: DataFrame, prototypes: DataFrame, id_col: str, vec_col: str = "vec") -> DataFrame:
    """The vector nearest to each prototype, of those that have none nearer; ties by id."""
    near = assigned(df, prototypes, id_col, vec_col)
    return near.groupBy("family").agg(F.min_by(F.col(id_col), F.struct("distance", id_col)).alias(id_col), F.min("distance").alias("distance"))
