"""Nearest neighbours by cosine through an inverted file of vectors.

Centres of cells come from K-means on a bounded sample; every vector lies in
the cell of its nearest centre, and a query looks into the cells nearest to it
(all of them: exact).  Cells are cut into blocks of bounded size on both
sides, so that a cell that holds a third of all vectors, or of all queries, is
many tasks, and no side is broadcast.  Each block keeps the best few of each
query; these are merged by one aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from modlark.sources.shared import written

#: Vectors and queries in a block: what a task holds is these and a matrix of a slice of them.
BLOCK, QUERIES, SLICE = 2048, 4096, 256
#: Cells of an index at most: their centres go to every task.
MAX_CELLS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _dense(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


@dataclass(frozen=True)
class VectorIndex:
    """``vectors`` (cell, block, item, label, vec) and the centres of the cells."""

    vectors: DataFrame
    centres: np.ndarray
    dim: int

    def cells_of(self, vec: Column, n: int) -> Column:
        """The ``n`` cells nearest to a vector, nearest first."""
        centres, n = self.centres, min(n, len(self.centres))

        @pandas_udf("array<int>")
        def near(column: pd.Series) -> pd.Series:
            if not len(column):
                return pd.Series([], dtype=object)
            found = np.argsort(-(_unit(_dense(column)) @ centres.T), axis=1, kind="stable")[:, :n]
            return pd.Series(found.astype(np.int32).tolist())

        return near(vec)


def _whole(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x)))


def _cut(counts: DataFrame, size: int) -> Column:
    """A map of every cell to its number of blocks; there are `MAX_CELLS` cells at most."""
    rows = counts.collect()
    return F.create_map(*(F.lit(v) for r in rows for v in (r["cell"], max(1, math.ceil(r["count"] / size))))) if rows else F.create_map(F.lit(0), F.lit(1))


def build(items: DataFrame, id_col: str, vec_col: str = "vec", label_col: str | None = None, cells: int | None = None, sample: int = 20_000, seed: int = 5) -> VectorIndex:
    """An index of all vectors of ``items``, written once.

    ``cells`` (by default the square root of the number of vectors) are the
    clusters of about ``sample`` vectors at most, chosen by a hash of their
    ids.  Null vectors, and those of another length than most, are left out;
    a zero vector is in some cell and similar to nothing."""
    sizes = items.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    given = written(_whole(items, vec_col, dim).select(F.col(id_col).alias("item"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec")), "index-items")
    n = given.count()
    cells = max(1, min(cells or round(math.sqrt(n)), MAX_CELLS, n))
    centres = np.zeros((1, max(1, dim)))
    if cells > 1:
        chosen = given.where(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20))
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        rows = written(chosen.where(norm > 0).select(array_to_vector(F.transform("vec", lambda x: x / norm)).alias("features")), "index-sample")
        if rows.count() >= cells:
            centres = _unit(np.array(KMeans(k=cells, seed=seed, maxIter=15, initSteps=2).fit(rows).clusterCenters()))
    index = VectorIndex(given, centres, dim)
    celled = written(given.withColumn("cell", index.cells_of(F.col("vec"), 1)[0]), "index-cells")
    blocks = _cut(celled.groupBy("cell").count(), BLOCK)
    return VectorIndex(celled.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.element_at(blocks, F.col("cell"))).cast("int")), centres, dim)


def search(index: VectorIndex, queries: DataFrame, k: int, id_col: str, vec_col: str = "vec", probes: int | None = None, digits: int = 9) -> DataFrame:
    """Each query's ``k`` most similar vectors: ``(id, item, label, similarity,
    rank)``, of equally similar ones (to ``digits`` digits) the first by item.

    ``probes`` cells are looked into; None means all, and exact results.  Null
    vectors and those of another length find nothing."""
    asked = _whole(queries, vec_col, index.dim).select(F.col(id_col).alias("query"), F.col(vec_col).cast("array<double>").alias("vec"))
    cells = index.cells_of(F.col("vec"), probes or len(index.centres))
    asked = written(asked.withColumn("cell", F.explode(cells)), "index-queries")
    ours, theirs = _cut(index.vectors.groupBy("cell").count(), BLOCK), _cut(asked.groupBy("cell").count(), QUERIES)
    of = lambda blocks: F.coalesce(F.element_at(blocks, F.col("cell")), F.lit(0))
    every = lambda blocks: F.explode(F.when(of(blocks) > 0, F.sequence(F.lit(0), of(blocks) - 1)))
    left = asked.withColumn("part", F.pmod(F.xxhash64("query"), of(theirs)).cast("int")).withColumn("block", every(ours))
    right = index.vectors.withColumn("part", every(theirs))
    kind, label = asked.schema["query"].dataType.simpleString(), index.vectors.schema["label"].dataType.simpleString()
    item = index.vectors.schema["item"].dataType.simpleString()

    def best(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item", kind="stable")
        out = []
        if len(queries) and len(items):
            x = _unit(_dense(items["vec"])).T
            for at in range(0, len(queries), SLICE):
                part = queries.iloc[at : at + SLICE]
                similar = np.round(_unit(_dense(part["vec"])) @ x, digits)
                top = np.argsort(-similar, axis=1, kind="stable")[:, :k]  # of equal ones the first item
                rows = items.iloc[top.reshape(-1)]
                out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), top.shape[1]), "item": rows["item"].to_numpy(), "label": rows["label"].to_numpy(), "similarity": np.take_along_axis(similar, top, axis=1).reshape(-1)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "item": [], "label": [], "similarity": []})

    keys = ("cell", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query {kind}, item {item}, label {label}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("query", id_col)


def probes_for(index: VectorIndex, queries: DataFrame, k: int, id_col: str, vec_col: str = "vec", share: float = 0.95, sample: int = 200) -> int:
    """In how many cells ``share`` of the exact ``k`` neighbours are found.

    Measured on about ``sample`` queries, chosen by a hash of their ids: where,
    in the order of cells by their nearness to a query, its neighbours' cells are."""
    n = queries.count()
    some = written(queries.where(F.pmod(F.xxhash64(id_col, F.lit("probes")), F.lit(1 << 20)) < min(1.0, sample / max(1, n)) * (1 << 20)).select(id_col, vec_col), "index-sample")
    exact = search(index, some, k, id_col, vec_col)
    order = _whole(some, vec_col, index.dim).select(id_col, index.cells_of(F.col(vec_col), len(index.centres)).alias("_order"))
    met = exact.join(index.vectors.select("item", "cell"), "item").join(F.broadcast(order), id_col)  # of a bounded sample
    least = met.agg(F.percentile(F.array_position("_order", F.col("cell")), share)).first()[0]
    return len(index.centres) if least is None else max(1, math.ceil(least))


def recall(found: DataFrame, exact: DataFrame, id_col: str) -> DataFrame:
    """``queries, links`` and ``recall``: the share of exact neighbours that were found."""
    met = exact.select(id_col, "item").join(found.select(id_col, "item", F.lit(1).alias("_hit")), [id_col, "item"], "left")
    return met.agg(F.countDistinct(id_col).alias("queries"), F.count("*").alias("links"), F.coalesce(F.sum("_hit") / F.count("*"), F.lit(1.0)).alias("recall"))


def nearest(queries: DataFrame, exemplars: DataFrame, k: int, id_col: str, vec_col: str = "vec", probes: int | None = None) -> DataFrame:
    """Each row's ``k`` most similar exemplars (exemplar, label, vec) with a rank from 1."""
    index = build(exemplars, "exemplar", label_col="label", cells=None if probes else 1)
    return search(index, queries, k, id_col, vec_col, probes).withColumnRenamed("item", "exemplar")
