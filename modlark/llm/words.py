"""Words of texts as arrays, the first step of most operators here.

A word is a run of bytes other than space and 0x09-0x0D, which is what
``bytes.split()`` yields.  UTF-8 never uses those bytes inside a character, so
splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SHIFT = tuple(np.uint64(x) for x in (30, 27, 31))


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def split(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text (null: none); ``lower`` maps A-Z, and nothing else, to a-z."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def numbered(texts: Iterable[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``(ids, counts, vocabulary)``: the texts' words as numbers into
    ``vocabulary``, one text after the other, and how many each text has."""
    index, parts, counts = _Index(), [], []
    for text in texts:
        words = split(text, lower)
        counts.append(len(words))
        parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return ids, np.asarray(counts, np.int64), list(index)


def hashes(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit numbers over all their bits (a bijection)."""
    x = (x ^ (x >> _SHIFT[0])) * _MIX[1]
    x = (x ^ (x >> _SHIFT[1])) * _MIX[2]
    return x ^ (x >> _SHIFT[2])


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive entries (fewer entries: empty)."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out + hashed[i : i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    return mix(out)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each text begins, and after them the total."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
