"""Word shingles as sorted arrays of 64-bit hashes, and size bands."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from tickloom.llm.worker import Remembered
from tickloom.llm.worker import cache as kept

#: Bytes of words whose hashes a worker remembers; bounds memory, not the result.
REMEMBERED = 24 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending distinct hashes of the width-word shingles; words are runs without ASCII white space, A-Z lower-cased.

    Fewer words than width make one shingle of them all; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes know ASCII case and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    known: Remembered = kept("shingles", 0, lambda: Remembered(REMEMBERED))
    here = {}
    for w in set(words):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            known.put(w, h, len(w) + 32)
        here[w] = h
    h = np.array([here[w] for w in words], np.uint64)
    if len(h) < width:
        h = np.concatenate([h, np.full(width - len(h), len(h), np.uint64)])
        tail = 0x5DEECE66D
    else:
        tail = 0
    out = np.full(len(h) - width + 1, tail, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


@cache
def bands(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) set sizes of the bands: sets that link are in one band or in neighbouring ones."""
    low, high = [], []
    at = 1
    while at <= most:
        low.append(at)
        high.append(at * den // num)
        at = high[-1] + 1
    return np.array(low), np.array(high)


def band_of(size: int, num: int, den: int) -> int:
    most = 1 << max(10, int(size).bit_length())
    return int(np.searchsorted(bands(most, num, den)[0], size, side="right") - 1)
