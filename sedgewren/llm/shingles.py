"""Word shingles as 64-bit hashes, vectorised over a text."""

from __future__ import annotations

import numpy as np
import xxhash

_SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)
_UNDO = np.uint64(pow(int(_SCRAMBLE), -1, 1 << 64))
_HALF = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _HALF)
    x *= _SCRAMBLE
    x ^= x >> _HALF
    x *= _SCRAMBLE
    x ^= x >> _HALF
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix made x of."""
    x = x ^ (x >> _HALF)
    x *= _UNDO
    x ^= x >> _HALF
    x *= _UNDO
    x ^= x >> _HALF
    return x


def ascending(x: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def words(text: str | None, fold_ascii: bool = True) -> list[bytes]:
    """Runs without ASCII white space, as UTF-8; with A-Z as a-z if fold_ascii."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if fold_ascii else raw).split()


class Shingler:
    """Hashes of a text's n-word shingles: each word is hashed by itself, a shingle by a sum weighted by place."""

    def __init__(self, n: int, fold_ascii: bool = True) -> None:
        self.n, self.fold = n, fold_ascii
        self.weights = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1) for i in range(n)]

    def hashes(self, text: str | None) -> np.ndarray:
        """Ascending distinct shingle hashes. A text of fewer than n words is one shingle; without words there is none."""
        found = words(text, self.fold)
        if not found:
            return np.empty(0, np.uint64)
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
        k = min(self.n, len(h))
        rolled = h[: len(h) - k + 1] * self.weights[0]
        for i in range(1, k):
            rolled += h[i : len(h) - k + 1 + i] * self.weights[i]
        if k < self.n:
            rolled += np.uint64(k)
        return ascending(mix(rolled))
