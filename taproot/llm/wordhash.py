"""Word and window hashes of many texts at once, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


_held = [np.zeros(0, U64), np.zeros(0, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_held[0]) < n:
        size = 1 << (n - 1).bit_length()
        _held[0], _held[1] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _held[0][:n], _held[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The runs of bytes other than space and \\t to \\r."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).split()


class Words:
    """The words of a list of texts in one row, with each word's hash and place."""

    def __init__(self, texts: list) -> None:
        self.words = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.firsts = self.ends - self.lengths
        n = int(self.lengths.sum())
        self.hashes = np.fromiter((h for w in self.words for h in map(xxhash.xxh64_intdigest, w)), U64, n)
        self.place = np.arange(n) - np.repeat(self.firsts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - self.place
        up, self.down = powers(max(n, 1))
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.hashes * up[:n], dtype=U64)])

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each position; the caller sees to it that they lie in one text."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def windows2(self, at: np.ndarray, size: int) -> np.ndarray:
        """A second hash of the same windows, from another hash of the words' bytes."""
        if not hasattr(self, "_sums2"):
            up, _ = powers(max(len(self.hashes), 1))
            second = np.fromiter((h for w in self.words for h in map(xxhash.xxh3_64_intdigest, w)), U64, len(self.hashes))
            self._sums2 = np.concatenate([np.zeros(1, U64), np.cumsum(second * up[: len(second)], dtype=U64)])
        return mix((self._sums2[at + size] - self._sums2[at]) * self.down[at])
