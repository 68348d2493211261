"""Fitted models as files: stored once, loaded wherever they score."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlark.operators.training import Calibrated
from modlark.sources.shared import job_folder

_STORED: dict[tuple, str] = {}


def stored(data: DataFrame, name: str, fit: Callable[[str], None]) -> str:
    """A folder in which ``fit`` has stored what it learned from ``data``.

    Within an application it is fitted once for the same files of the same
    times; it is deleted when the application ends."""
    spark = data.sparkSession
    files = sorted(set(data.inputFiles()))
    told = spark.read.format("binaryFile").load(files).agg(F.max("modificationTime"), F.sum("length"), F.count("*")).first() if files else ()
    key = (spark.sparkContext.applicationId, name, tuple(files), tuple(told))
    if key not in _STORED:
        path = job_folder(spark, name)
        fit(path)
        _STORED[key] = path
    return _STORED[key]


@dataclass(frozen=True)
class Meta:
    """A meta model as it was stored: calibrated linear models and the names of
    their features, in order."""

    calibrated: Calibrated
    features: tuple[str, ...]

    def coefficients(self) -> list[float]:
        """The mean coefficients of the linear models."""
        return [sum(c) / len(c) for c in zip(*(p[0] for p in self.calibrated.parts))]


def save_meta(spark: SparkSession, meta: Meta, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(meta)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_meta(spark: SparkSession, path: str) -> Meta | None:
    """The stored model, or None where there is none that can be read."""
    try:
        told = json.loads(spark.read.text(path).first()[0])
        return Meta(Calibrated([(list(c), float(i), float(a), float(b)) for c, i, a, b in told["calibrated"]["parts"]]), tuple(told["features"]))
    except (AnalysisException, TypeError, KeyError, ValueError):
        return None


def score(rows: DataFrame, meta: Meta | None, names: tuple[str, ...], features: Column | str = "features") -> DataFrame:
    """``rows`` with ``p_spam`` and ``error``: a probability, or 0 and why the model
    isn't ready: there is none, or it was fitted to other features."""
    error = "model_not_ready" if meta is None or not meta.calibrated.parts else "features_differ" if tuple(names) != meta.features else None
    p = F.lit(0.0) if error else meta.calibrated.probability(F.col(features) if isinstance(features, str) else features)
    return rows.withColumn("p_spam", p).withColumn("error", F.lit(error).cast("string"))
