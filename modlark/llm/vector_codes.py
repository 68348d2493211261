"""Product quantisation with exact integer codebooks.

Vectors are scaled to integers and cut into parts; every part position has a
codebook, learned by rounds of assignment and floored means.  Distances come
from limb-split float64 matrix products (`exact`), so codes are the same on
any machine, in any order of rows.  Tasks send sums for each codebook entry,
never vectors; the driver holds the codebooks alone.
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

#: Rows of a block: 16 codebooks of 64 entries take 16 MB of distances.
BLOCK = 2048
#: Labels that may be broadcast with their sums, about 16 MB.
MAX_BROADCAST = 200_000
#: A label with over one row in so many is never a key of a shuffle.
RARE = 10_000


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            for rows, x in exact.integers(exact.matrix(part[column], dim).astype(np.float64), scale):
                yield part, rows, x


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """``(parts, n, d)``: the parts of ``n`` vectors."""
    return np.ascontiguousarray(x.reshape(len(x), parts, x.shape[1] // parts).swapaxes(0, 1))


def encode_block(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(n, parts)`` of integer vectors and their squared errors, summed over parts."""
    codes, distances = exact.nearest(_parts(x, len(codebooks)), codebooks)
    return codes.T, distances.astype(object).sum(axis=0) if exact.most(distances) * len(codebooks) > exact.LONG else distances.sum(axis=0)


def _refined(kept: DataFrame, codebooks: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """Codebooks after one round over all vectors."""
    parts, entries, d = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, wide = np.zeros(parts * entries * (d + 1), np.int64), np.zeros(parts * entries * (d + 1), object)
        for _, _, x in _blocks(batches, "vector", dim, scale):
            codes, _ = encode_block(x, codebooks)
            slots = ((np.arange(parts) * entries + codes) * (d + 1))[..., None] + np.arange(d + 1)
            counted = np.concatenate([x.reshape(len(x), parts, d), np.ones((len(x), parts, 1), x.dtype)], axis=2)
            np.add.at(wide if x.dtype == object else sums, slots.reshape(-1), counted.reshape(-1))
        yield exact.pieced(sums.astype(object) + wide)

    rows = kept.select("vector").mapInArrow(add_up, exact.PIECED).groupBy("slot", "place").agg(F.sum("piece").alias("piece")).collect()
    totals = exact.put_together(rows, parts * entries * (d + 1)).reshape(parts, entries, d + 1)
    return exact.floors(totals[..., :d], totals[..., d], codebooks.astype(object))


def learn_codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, dim: int, scale: int) -> np.ndarray:
    """``(parts, entries, dim / parts)`` integers; fewer entries where there are fewer rows."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    codebooks = _parts(exact.starts(first, dim, scale), parts)
    for _ in range(rounds if first else 0):
        codebooks = _refined(kept, codebooks, dim, scale)
    return codebooks


def _with_label_errors(coded: DataFrame, scratch: Scratch) -> DataFrame:
    """``coded`` with the ``label_error`` of its label.  Few labels are broadcast;
    of many, the frequent ones (at most `RARE`), and the rest is shuffled."""
    sums = coded.groupBy(F.col("label").alias("its")).agg(exact.long_sum("error").alias("label_error"), F.count("*").alias("rows"))
    sums = scratch.keep(sums, "labels")
    same, size = F.col("label").eqNullSafe(F.col("its")), sums.agg(F.count("*"), F.sum("rows")).first()
    if size[0] <= MAX_BROADCAST:
        return coded.join(F.broadcast(sums), same)
    often = F.col("rows") * RARE > size[1]
    hot, others = F.broadcast(sums.where(often)), sums.where(~often)
    return coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(others, same))


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all vectors by codebooks learned from all of them.

    Component x becomes floor(``scale`` * x).  The codebooks start as the parts
    of the first ``entries`` rows by id (of equal ids, by vector); each of
    ``rounds`` rounds assigns all parts to the nearest entry, the lower one of
    two, and replaces entries by floored means.
    Returns ``vec_id, code`` (two hex digits a part), ``error`` (squared),
    ``label_error`` (summed over equal labels) and ``codebooks_sha256``.

    * Dropped: null vectors, those with null or non-finite components, and
      those without ``dim`` components.
    * Null ids are coded, and come last for the codebooks' starts; null labels
      are one label.  Repeated rows count each.  With fewer rows than
      ``entries``, the codebooks have fewer entries; an empty table gives no rows.
    * Very large components are exact; an error beyond a long is its largest value.
    * Other columns are not read.
    """
    if dim % parts or entries > 256:
        raise ValueError("dim must be a multiple of parts, and an entry's number two hex digits")
    given = vectors.where(exact.is_whole(vector_col, dim))
    kept = given.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    codebooks = learn_codebooks(kept, parts, entries, rounds, dim, scale)
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _blocks(batches, "vector", dim, scale):
            codes, error = encode_block(x, codebooks)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([part["vec_id"].take(rows), pa.array(map("".join, hexes[codes].tolist()), pa.string()), pa.array(exact.longs(error)), part["label"].take(rows)], names=["vec_id", "code", "error", "label"])

    schema = f"vec_id long, code string, error long, label {kept.schema['label'].dataType.simpleString()}"
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    coded = scratch.keep(kept.mapInArrow(encode, schema), "codes")
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    return _with_label_errors(coded, scratch).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
