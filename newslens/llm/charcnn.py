"""A small character convolutional network in numpy: embed, convolve, pool, logistic output."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np

EMBED, KERNEL, FILTERS = 8, 5, 24
#: Characters of a padded row (a longer candidate is cut into overlapping rows that are pooled together), and rows that are
#: convolved at once.
ROW, BLOCK_ROWS = 192, 256
OTHER, PAD = 128, 129


@dataclass
class Example:
    """A candidate with the text before and behind it."""

    left: str
    body: str
    right: str


def _codes(s: str) -> np.ndarray:
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, OTHER).astype(np.int64)


def _cut(x: Example) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and flags (1 inside the candidate) of the rows of an example. They overlap by KERNEL - 1 characters, so that
    every window of the example lies in one of them."""
    text, body = x.left + x.body + x.right, (len(x.left), len(x.left) + len(x.body))
    for a in range(0, max(1, len(text) - KERNEL + 1), ROW - KERNEL + 1):
        c = _codes(text[a:a + ROW])
        at = np.arange(a, a + len(c))
        yield c, ((at >= body[0]) & (at < body[1])).astype(float)


def _blocks(examples: Sequence[Example], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Padded codes, flags and the example of every row, in blocks of at most ``most`` rows."""
    rows = ((i, c, f) for i, x in enumerate(examples) for c, f in _cut(x))
    while block := list(islice(rows, most)):
        width = max([KERNEL, *(len(c) for _, c, _ in block)])
        out, inside = np.full((len(block), width), PAD), np.zeros((len(block), width))
        for k, (_, c, f) in enumerate(block):
            out[k, :len(c)], inside[k, :len(c)] = c, f
        yield out, inside, np.array([i for i, _, _ in block])


class CharCNN:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        wide = KERNEL * (EMBED + 1)
        self.p = {"E": r.normal(0, 0.3, (PAD + 1, EMBED)), "W": r.normal(0, wide ** -0.5, (wide, FILTERS)),
                  "b": np.zeros(FILTERS), "w": r.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
        self.p["E"][PAD] = 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes, inside):
        x = np.concatenate([self.p["E"][codes], inside[..., None]], 2)
        n = codes.shape[1] - KERNEL + 1
        cols = np.concatenate([x[:, k:k + n] for k in range(KERNEL)], 2)
        h = np.maximum(cols @ self.p["W"] + self.p["b"], 0)
        real = (codes[:, KERNEL - 1:] != PAD) | (np.arange(n) == 0)
        return cols, np.where(real[..., None], h, 0), real

    def logits(self, examples: Sequence[Example]) -> np.ndarray:
        n = len(examples)
        top, total, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
        for codes, inside, owner in _blocks(examples, BLOCK_ROWS):
            _, h, real = self._forward(codes, inside)
            np.maximum.at(top, owner, h.max(1))  # activations are never negative
            np.add.at(total, owner, h.sum(1))
            np.add.at(count, owner, real.sum(1))
        return np.concatenate([top, total / np.maximum(count, 1)[:, None]], 1) @ self.p["w"] + self.p["c"][0]

    def probability(self, examples: Sequence[Example]) -> np.ndarray:
        """Calibrated probability of a secret."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(examples) + self.shift, -30, 30)))

    def fit(self, examples: Sequence[Example], y: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64,
            seed: int = 0) -> "CharCNN":
        """Adam on the log loss. Training examples must fit one row each."""
        rnd, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rnd.permutation(len(examples))
            for a in range(0, len(order), batch):
                at = order[a:a + batch]
                for k, g in self._gradients([examples[i] for i in at], y[at]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    fix = (1 - 0.999 ** (step + 1)) ** 0.5 / (1 - 0.9 ** (step + 1))
                    self.p[k] -= rate * fix * m[k] / (np.sqrt(v[k]) + 1e-8)
                step += 1
        return self

    def _gradients(self, examples, y):
        (codes, inside, owner), *more = _blocks(examples, len(examples))
        if more or len(set(owner.tolist())) != len(examples):
            raise ValueError("a training example is longer than a row")
        cols, h, real = self._forward(codes, inside)
        best, count = h.argmax(1), real.sum(1)
        z = np.concatenate([np.take_along_axis(h, best[:, None], 1)[:, 0], h.sum(1) / count[:, None]], 1)
        e = (1 / (1 + np.exp(-np.clip(z @ self.p["w"] + self.p["c"][0], -30, 30))) - y) / len(y)
        dz = e[:, None] * self.p["w"]
        dh = np.repeat((dz[:, FILTERS:] / count[:, None])[:, None], h.shape[1], 1)
        rows, filters = np.indices(best.shape)
        dh[rows, best, filters] += dz[:, :FILTERS]
        dh *= h > 0
        dcols = dh @ self.p["W"].T
        dx = np.zeros((*codes.shape, EMBED + 1))
        for k in range(KERNEL):
            dx[:, k:k + h.shape[1]] += dcols[..., k * (EMBED + 1):(k + 1) * (EMBED + 1)]
        de = np.zeros_like(self.p["E"])
        np.add.at(de, codes, dx[..., :EMBED])
        de[PAD] = 0
        return {"E": de, "W": np.tensordot(cols, dh, ((0, 1), (0, 1))), "b": dh.sum((0, 1)), "w": e @ z,
                "c": np.array([e.sum()])}

    def calibrate(self, examples: Sequence[Example], y: np.ndarray, recall: float) -> "CharCNN":
        """Platt scaling on held-out findings; the threshold is the highest that ``recall`` of the secrets among them
        reach."""
        s = self.logits(examples)
        a, b = 1.0, 0.0
        for _ in range(500):
            e = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30))) - y
            a, b = a - 0.05 * (e @ s) / len(s), b - 0.05 * e.mean()
        self.scale, self.shift = float(a), float(b)
        found = np.sort(self.probability([x for x, t in zip(examples, y) if t]))
        self.threshold = float(found[int((1 - recall) * len(found))]) if len(found) else 0.5
        return self
