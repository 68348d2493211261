"""Compressed MinHash registers, as arrays: what a task computes.

Every shingle has one 64-bit hash.  Its first bits name a bucket; of the other
bits' minimum in a bucket the register keeps only the count of leading zeros
and the ``MANTISSA`` bits after the first one: 16 bits in all.  A bucket
without shingles copies the first full one of a fixed probe order, so that
registers of short texts agree as often as the sets do, too.
"""

from __future__ import annotations

import numpy as np

from modlark.llm.words import mix

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10

_rng = np.random.default_rng(20)
#: Row t: for each bucket, the bucket that it asks in its t-th probe.
_PROBES = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)], axis=1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def compress(rest: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of numbers in [0, 2^64), as 16 bits."""
    part, exponent = np.frexp(rest.astype(np.float64) * 2.0**-64)
    zeros = np.where(rest == 0, 62, np.clip(-exponent, 0, 62))
    bits = np.clip((part - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1)
    return ((zeros.astype(np.uint32) << MANTISSA) | bits.astype(np.uint32)).astype(np.uint16)


def registers(shingles: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """``n_texts`` rows of registers; ``shingles`` are sorted within each
    ``text`` number, and so a bucket's first one is its smallest."""
    slot = text * BUCKETS + (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    out = np.zeros((n_texts, BUCKETS), np.uint16)
    full = np.zeros((n_texts, BUCKETS), bool)
    out.flat[slot[first]] = compress(shingles[first] << np.uint64(BUCKET_BITS))
    full.flat[slot[first]] = True
    rows = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    given, has = out[rows], full[rows]
    filled, own = has.copy(), given.copy()
    left = np.arange(len(rows))
    for t in range(BUCKETS):
        if not len(left):
            break
        probe = _PROBES[:, t]
        take = ~filled[left] & has[left][:, probe]
        own[left] = np.where(take, given[left][:, probe], own[left])
        filled[left] |= take
        left = left[~filled[left].all(axis=1)]
    out[rows] = own
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for every ``rows`` registers; keys of different bands differ."""
    n = regs.shape[1] // rows
    parts = regs[:, : n * rows].reshape(len(regs), n, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(regs), n)).copy()
    for i in range(rows):
        keys = mix(keys * PRIME + parts[:, :, i])
    return keys


def _edges() -> np.ndarray:
    """Borders of the registers' cells in [0, 1), from the smallest up."""
    zeros = np.arange(40)[::-1]
    steps = np.arange(1 << MANTISSA) / (1 << MANTISSA)
    return np.append((2.0 ** -(zeros[:, None] + 1.0) * (1 + steps)).ravel(), 1.0)


def _collisions() -> tuple[np.ndarray, np.ndarray]:
    """``sizes`` and, for two disjoint buckets of such sizes, the chance that
    their registers agree: the sum over cells of both minima falling there."""
    sizes = 2.0 ** np.arange(0, 26)
    inside = -np.diff((1 - _edges()) ** sizes[:, None], axis=1)
    return sizes, inside @ inside.T


_SIZES, _CHANCE = _collisions()


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers and the sets' sizes: the share
    of equal registers less those that are expected to agree by accident."""
    at = [np.clip(np.rint(np.log2(np.maximum(n / BUCKETS, 1))), 0, len(_SIZES) - 1).astype(int) for n in (n_a, n_b)]
    accident = _CHANCE[at[0], at[1]]
    return np.clip(((a == b).mean(axis=1) - accident) / (1 - accident), 0, 1)
