"""Prefix polynomial hashes of many texts at once: span equality and longest common extensions.

With prefix sums H[i] of code point times base**position, modulo the Mersenne prime 2**31 - 1, the hash of a span is
(H[end] - H[start]) / base**start, whatever the span's place. Two bases make a 62-bit hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from newslens.llm.common import code_points

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_019, 1_728_364_291)
_SHIFT = np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def reduce(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for ``x`` below 2**62."""
    x = (x & PRIME) + (x >> _SHIFT)
    x = (x & PRIME) + (x >> _SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling; kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, np.uint64)
        while len(got) < n:
            got = np.concatenate([got, reduce(got * np.uint64(pow(base, len(got), int(PRIME))))])
        _powers[base] = got
    return got[:n]


class PrefixHashes:
    """Prefix arrays over several texts, laid end to end; positions are those of the whole."""

    def __init__(self, texts: Sequence[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        c = code_points("".join(texts)).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self._sums, self._back = [], []
        for base in BASES:
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(reduce(c * powers(base, self.n)), out=h[1:])  # below 2**31 each: no overflow before 2**33 terms
            self._sums.append(reduce(h))
            self._back.append(powers(pow(base, -1, int(PRIME)), self.n + 1))

    def spans(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """The 31-bit hashes of the spans [a, b)."""
        h = self._sums[which]
        return reduce(reduce(h[b] + PRIME - h[a]) * self._back[which][a])

    def whole(self) -> np.ndarray:
        """The 62-bit hash of every text."""
        one, two = (self.spans(self.start, self.start + self.size, k) for k in (0, 1))
        return (one << _SHIFT) | two

    def windows(self, width: int) -> np.ndarray:
        """The hash of the window of ``width`` characters at every position; those that end in a later text too."""
        h, n = self._sums[0], self.n - width + 1
        return reduce(reduce(h[width:] + PRIME - h[:n]) * self._back[0][:n]) if n > 0 else np.empty(0, np.uint64)

    def extension(self, other: "PrefixHashes") -> np.ndarray:
        """How many characters each text and the other's text of the same number share from their starts: a binary
        search for the longest equal prefixes, all texts in step."""
        low, high = np.zeros(len(self.size), np.int64), np.minimum(self.size, other.size)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = np.ones(len(mid), bool)
            for k in (0, 1):
                same &= self.spans(self.start, self.start + mid, k) == other.spans(other.start, other.start + mid, k)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low
