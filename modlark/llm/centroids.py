"""Centroid clustering on an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids in a
table.  After a round a centroid has changed in some components only; the
products are updated by those changes, and nearest centroids follow from the
products and the centroids' norms.  Each round reads the table once for the
sums of clusters and once to write the updated one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlark.llm import exact
from modlark.llm.scratch import Scratch

BLOCK = 4096


def updated(x: np.ndarray, dots: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Dot products of ``x`` with ``after``, from those with ``before`` and the
    components in which a centroid has changed."""
    change = after - before
    moved = [(k, np.flatnonzero(change[k])) for k in range(len(after))]
    dots = dots.astype(np.result_type(dots, change, x))
    for k, at in moved:
        if len(at):
            dots[:, k] += exact.products(x[:, at], change[k : k + 1, at])[:, 0]
    return dots


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            for rows, x in exact.integers(exact.matrix(part["vector"], dim).astype(np.float64), scale):
                yield part.take(pa.array(rows)), x


def _stored_dots(part: pa.RecordBatch, k: int) -> np.ndarray:
    """The products kept for a block; those beyond a long are kept as decimals."""
    if not part["wide"].null_count:
        return np.array([int(v) for v in part["wide"].flatten().to_pylist()], object).reshape(-1, k)
    if not part["dots"].null_count:
        return exact.matrix(part["dots"], k)
    return np.array([[int(v) for v in w or d] for d, w in zip(part["dots"].to_pylist(), part["wide"].to_pylist())], object).reshape(-1, k)


def _row_kinds(part: pa.RecordBatch, dots: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(dots), pa.list_(kind))
    if exact.most(dots) <= exact.LONG:
        kept = [exact.lists(dots.astype(np.int64), pa.int64()), none(pa.string())]
    else:
        kept = [none(pa.int64()), exact.lists(dots.astype(str).astype(object), pa.string())]
    columns = [part["vec_id"], part["vector"], *kept, pa.array(cluster.astype(np.int32)), pa.array(exact.longs(distance))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "dots", "wide", "cluster", "distance"])


def _assigned(rows: DataFrame, before: np.ndarray | None, after: np.ndarray, dim: int, scale: int) -> DataFrame:
    """``rows`` with products with ``after`` and the nearest of them; without ``before`` the products are made anew."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, dim, scale):
            own, now = exact.fitting(x, after)
            dots = exact.products(own, now) if before is None else updated(own, _stored_dots(part, len(now)), exact.fitting(x, before)[1], now)
            yield _row_kinds(part, dots, *exact.first_least(own, now, dots.astype(own.dtype)))

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id long, vector {kind}, dots array<long>, wide array<string>, cluster int, distance long")


def _means(table: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """Centroids as the floored means of their vectors; empty ones stay."""
    k = len(centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, wide = np.zeros(k * (dim + 1), np.int64), np.zeros(k * (dim + 1), object)
        for part, x in _blocks(batches, dim, scale):
            slots = part["cluster"].to_numpy()[:, None].astype(np.int64) * (dim + 1) + np.arange(dim + 1)
            np.add.at(wide if x.dtype == object else sums, slots.reshape(-1), np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).reshape(-1))
        yield exact.pieced(sums.astype(object) + wide)

    rows = table.select("vector", "cluster").mapInArrow(add_up, exact.PIECED).groupBy("slot", "place").agg(F.sum("piece").alias("piece")).collect()
    totals = exact.put_together(rows, k * (dim + 1)).reshape(k, dim + 1)
    return exact.floors(totals[:, :dim], totals[:, dim], centroids)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest of ``k`` centroids for every vector, after ``rounds`` rounds.

    Component x becomes floor(``scale`` * x).  Centroids start as the vectors
    with the smallest sha256 of ``<seed>:<vec_id>``; each round assigns all
    vectors (of equally near centroids, the smaller number) and replaces
    centroids by floored means.
    Returns ``vec_id, cluster, distance`` (squared), ``cluster_inertia,
    inertia`` and ``centroid_sha256``.

    * Dropped: null vectors, those without ``dim`` components, and those with
      null or non-finite ones.
    * Null ids take part but come last for the starts; rows with one id are
      ordered by vector.  Repeated rows count each.  With fewer rows than
      ``k`` there are fewer centroids; an empty table gives no rows.
    * Very large components are exact; a distance beyond a long is its largest value.
    * Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    kept = vectors.where(exact.is_whole(vector_col, dim)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(place.asc_nulls_last(), "vector").limit(k).collect()
    now = exact.starts(first, dim, scale)
    if not first:
        rounds, kept = -1, kept.limit(0)
    before, table = None, kept
    for n in range(rounds + 1):
        if n:
            before, now = now, _means(table, now, dim, scale)
        table = scratch.keep(_assigned(table, before, now, dim, scale), f"round-{n}")
        if n:
            scratch.drop(f"round-{n - 1}")
    if not first:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    inertia = {r["cluster"]: int(r["total"]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.tolist()]
    of = lambda values: F.lit(values)[F.col("cluster")]
    each = F.array(*(F.lit(min(inertia.get(i, 0), exact.LONG)).cast("long") for i in range(len(first))))
    return table.select("vec_id", "cluster", "distance", each[F.col("cluster")].alias("cluster_inertia"), F.lit(min(sum(inertia.values()), exact.LONG)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))
