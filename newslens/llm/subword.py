"""Hashed subword embeddings averaged over bags of words into a linear softmax, in numpy.

A bag's vector is the mean of its character n-grams' embeddings; n-grams lie within a word and its two
borders. Once trained, an n-gram's part in the scores is its embedding times the output layer, so scoring gathers one
number per n-gram and class and sums them by bag.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from newslens.llm.common import code_points

_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def fold_table(digits: bool = False) -> np.ndarray:
    """Code point to lower-cased letter (or digit, if asked for); anything else is a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha() or digits and ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class Bags:
    """N-gram buckets with the bag each belongs to (in runs of ascending bags, one run per n-gram size), the number of
    bags, and the text that each bag is cut from."""

    ids: np.ndarray
    bag: np.ndarray
    n: int
    text: np.ndarray

    def count(self) -> np.ndarray:
        return np.bincount(self.bag, minlength=self.n)


def _repeats(c: np.ndarray, at: np.ndarray, of_word: np.ndarray, letter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether each word equals the word before it in its text (by a hash of its letters)."""
    if len(at) < 2:
        return np.zeros(len(at), bool)
    p = np.flatnonzero(letter)
    place = (p - at[word[p]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (c[p].astype(np.uint64) * _MULT) ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))
        h = np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * _MULT, np.searchsorted(p, at))
    return np.concatenate(([False], (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])))


def cut_bags(texts: Sequence[str], sizes: Sequence[int], bits: int, words: int = 0, digits: bool = False) -> Bags:
    """N-gram buckets of ``texts``; a bag is a whole text, or every ``words`` words of it, in which a word that only
    repeats the one before does not count. Each text has a bag at least, if only an empty one."""
    c = fold_table(digits)[code_points(" " + "  ".join(texts) + " ")]
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    letter = c != 32
    start = letter & ~np.concatenate(([False], letter[:-1]))
    word = np.cumsum(start) - 1  # of a letter; a space has the word before it
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.append(owner, np.full(len(c) - len(owner), len(texts) - 1)) if len(c) > len(owner) else owner[:len(c)]
    at = np.flatnonzero(start)
    of_word = owner[at]
    if words:
        again = _repeats(c, at, of_word, letter, word)
        if again.any():
            letter &= ~(letter & again[np.maximum(word, 0)])
            start = start & letter
            word, at = np.cumsum(start) - 1, np.flatnonzero(start)
            of_word = owner[at]
        first = np.searchsorted(of_word, np.arange(len(texts)))
        per = np.maximum(1, -(-np.bincount(of_word, minlength=len(texts)) // words))
        base = np.cumsum(per) - per
        bag_of_word = base[of_word] + (np.arange(len(of_word)) - first[of_word]) // words
        text = np.repeat(np.arange(len(texts)), per)
    else:
        bag_of_word, text = of_word, np.arange(len(texts))
    spaces = np.cumsum(~letter)
    ids, bags, h = [], [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            if n > len(c):
                break
            h = h[:len(c) - n + 1] * _MULT + c[n - 1:].astype(np.uint64)
            if n not in sizes:
                continue
            m = len(h)
            if n <= 2:
                good = letter[:m] if n == 1 else letter[:m] | letter[1:m + 1]
            else:
                good = spaces[n - 2:n - 2 + m] == spaces[:m]  # no space among the inner characters
            at = np.flatnonzero(good)
            ids.append((((h[at] + np.uint64(n)) * _MULT) >> np.uint64(64 - bits)).astype(np.int32))
            bags.append(bag_of_word[word[at + ~letter[at]]].astype(np.int32))
    none = np.empty(0, np.int32)
    return Bags(np.concatenate([none, *ids]), np.concatenate([none, *bags]), len(text), text)


class SubwordSoftmax:
    """Embeddings (2**bits x dim) and a linear softmax over ``classes``, trained jointly."""

    def __init__(self, classes: int, sizes: Sequence[int], bits: int, dim: int, words: int = 0, digits: bool = False,
                 seed: int = 0):
        r = np.random.default_rng(seed)
        self.sizes, self.bits, self.words, self.digits = tuple(sizes), bits, words, digits
        self.embed = r.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
        self.out = r.normal(0, 0.1, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self.table: np.ndarray | None = None
        self._seen = np.zeros((1 << bits, 1), np.float32)

    def bags(self, texts: Sequence[str]) -> Bags:
        return cut_bags(texts, self.sizes, self.bits, self.words, self.digits)

    def freeze(self) -> "SubwordSoftmax":
        """Fold the output layer into the embeddings; what is left is all that scoring needs."""
        self.table = self.embed @ self.out
        self.embed = self._seen = None
        return self

    def logits(self, bags: Bags) -> np.ndarray:
        """(bags x classes); a bag without n-grams has the bias alone."""
        table = self.embed @ self.out if self.table is None else self.table
        total = np.zeros((bags.n, table.shape[1]))
        if len(bags.ids):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(bags.bag)) + 1))
            np.add.at(total, bags.bag[starts], np.add.reduceat(np.take(table, bags.ids, axis=0), starts))
        return total / np.maximum(bags.count(), 1)[:, None] + self.bias

    def step(self, bags: Bags, error: np.ndarray, rate: float) -> None:
        """One gradient step: ``error`` (bags x classes) is the loss's gradient at the logits. The step of a bucket is
        scaled down by its past gradients (Adagrad), so rare n-grams learn as fast as common ones."""
        share = error / np.maximum(bags.count(), 1)[:, None]
        live = np.flatnonzero(np.abs(share).max(1) > 0)
        if not len(live):
            return
        on = np.zeros(bags.n, bool)
        on[live] = True
        pick = on[bags.bag]
        ids, bag = bags.ids[pick], bags.bag[pick]
        touched = np.flatnonzero(np.bincount(ids, minlength=len(self.embed)))
        pull = np.stack([np.bincount(ids, share[bag, k], len(self.embed))[touched] for k in range(share.shape[1])], 1)
        old = self.embed[touched]
        grad = (pull @ self.out.T).astype(np.float32)
        self.out -= (rate * 0.1 * (old.T @ pull)).astype(np.float32)
        self.bias -= (rate * 0.1 * error.sum(0)).astype(np.float32)
        self._seen[touched] += (grad ** 2).mean(1, keepdims=True)
        self.embed[touched] = old - rate * grad / np.sqrt(self._seen[touched] + 1e-10)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def batches(n: int, size: int, rnd: np.random.Generator) -> Iterator[np.ndarray]:
    order = rnd.permutation(n)
    for a in range(0, n, size):
        yield order[a:a + size]


def take(bags: Sequence[Bags], which: Sequence[int]) -> Bags:
    """Several texts' bags as one, texts renumbered in order."""
    parts, base = [bags[i] for i in which], 0
    bag, text = [], []
    for k, b in enumerate(parts):
        bag.append(b.bag + base)
        text.append(np.full(b.n, k))
        base += b.n
    return Bags(np.concatenate([b.ids for b in parts]), np.concatenate(bag), base, np.concatenate(text))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The factor on the logits that gives held-out examples the least log loss (a search over a grid)."""
    grid = np.exp(np.linspace(-2.5, 2.5, 101))
    loss = [-np.log(np.maximum(softmax(z * s)[np.arange(len(y)), y], 1e-12)).mean() for s in grid]
    return float(grid[int(np.argmin(loss))])
