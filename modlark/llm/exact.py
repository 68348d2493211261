"""Exact integer geometry on float64 matrix products.

Integers are broken into limbs so small that every product of limbs, summed
over all components, stays below 2**53: float64 BLAS then makes no rounding
error.  The products are shifted into place and added in int64.  Values so
large that a distance needs more than int64 take Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
#: Sums are added up in pieces of so many bits, so that sums of many tasks fit in a long.
PIECE = 32


def most(*arrays: np.ndarray) -> int:
    """The largest absolute value."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as float64 limbs of less than ``2**bits``, lowest first; the last one has the sign."""
    out = []
    while most(x) >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def limb_bits(d: int) -> int:
    """Bits of a limb with which ``d`` products of limbs add up to less than 2**53."""
    return (53 - (max(1, d) - 1).bit_length()) // 2


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products ``(..., n, k)`` of ``x (..., n, d)`` with ``c (..., k, d)``."""
    d = x.shape[-1]
    if d * most(x) * most(c) > LONG:
        return np.matmul(x.astype(object), np.swapaxes(c.astype(object), -1, -2))
    bits = limb_bits(d)
    out = np.zeros((*x.shape[:-1], c.shape[-2]), np.int64)
    theirs = [np.swapaxes(b, -1, -2) for b in limbs(c.astype(np.int64), bits)]
    for i, a in enumerate(limbs(x.astype(np.int64), bits)):
        for j, b in enumerate(theirs):
            out += (a @ b).astype(np.int64) << bits * (i + j)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


def fitting(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 where squared distances fit in it, else both as Python integers."""
    if 4 * x.shape[-1] * most(x, c) ** 2 <= LONG:
        return x.astype(np.int64), c.astype(np.int64)
    return x.astype(object), c.astype(object)


def first_least(x: np.ndarray, c: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``c`` for each of ``x``, and its squared distance, from their dot products."""
    score = squares(c)[..., None, :] - 2 * dots
    at = score.argmin(axis=-1)
    return at, squares(x) + np.take_along_axis(score, at[..., None], axis=-1)[..., 0]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`first_least` by `products`."""
    x, c = fitting(x, c)
    return first_least(x, c, products(x, c))


def integers(values: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``floor(scale * values)`` in rows of ordinary size, as int64, and then the
    other rows, as Python integers; each with the rows' numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    small = np.abs(scaled).max(axis=1, initial=0) < 1 << 26
    if small.any():
        yield np.flatnonzero(small), scaled[small].astype(np.int64)
    if not small.all():
        # doubles from 2**53 on are whole; their multiples may be no doubles
        wide = [[int(v) * scale if abs(v) >= 1 << 53 else int(s) for v, s in zip(*row)] for row in zip(values[~small].tolist(), scaled[~small].tolist())]
        yield np.flatnonzero(~small), np.array(wide, object).reshape(-1, values.shape[1])


def narrowed(x: np.ndarray) -> np.ndarray:
    """As int64 where all values fit."""
    return x.astype(np.int64) if most(x) <= LONG else x


def floors(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``floor(sums / counts)``; rows that count nothing stay as ``before``."""
    return narrowed(np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], before))


def pieces(total: int) -> Iterator[tuple[int, int]]:
    """A sum as signed pieces of `PIECE` bits, ``(place, piece)``, none of them 0."""
    sign, rest, place = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        if low := rest & ((1 << PIECE) - 1):
            yield place, sign * low
        rest, place = rest >> PIECE, place + 1


def pieced(totals: np.ndarray) -> pa.RecordBatch:
    """Rows ``(slot, place, piece)`` of a flat array of sums, for adding up by slot and place."""
    rows = [(slot, *p) for slot in np.flatnonzero(totals).tolist() for p in pieces(int(totals[slot]))]
    slot, place, piece = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(place, pa.int32()), pa.array(piece, pa.int64())], names=["slot", "place", "piece"])


PIECED = "slot int, place int, piece long"


def put_together(rows, n: int) -> np.ndarray:
    """The ``n`` sums from rows ``(slot, place, piece)``, as Python integers."""
    out = np.zeros(n, object)
    for slot, place, piece in rows:
        out[slot] += int(piece) << PIECE * place
    return out


def starts(rows, dim: int, scale: int) -> np.ndarray:
    """The integers of collected rows' vectors, in their order."""
    out = np.zeros((len(rows), dim), object)
    for at, x in integers(np.array([r["vector"] for r in rows], np.float64).reshape(-1, dim), scale):
        out[at] = x
    return narrowed(out)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of lists of ``d`` numbers each, none of them null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow column of lists."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(rows.reshape(-1), kind))


def longs(values: np.ndarray) -> np.ndarray:
    """As int64; what is above it is its largest value."""
    return np.array([min(int(v), LONG) for v in values], np.int64) if values.dtype == object else values.astype(np.int64)


def is_whole(vector: str, d: int) -> Column:
    """Whether a vector has ``d`` components, none null, NaN or infinite."""
    return F.coalesce((F.size(vector) == d) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def long_sum(column: str) -> Column:
    """A sum of longs; what is above a long is its largest value."""
    return F.least(F.coalesce(F.sum(F.col(column).cast("decimal(19,0)")), F.lit(0)), F.lit(LONG).cast("decimal(19,0)")).cast("long")
