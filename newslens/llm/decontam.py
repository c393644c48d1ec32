"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in a normal form: letters and digits in lower case, everything else one space. Every stretch of
``WINDOW`` characters of a benchmark item is a window, whatever its start; a shorter item is one window. If a stretch
of a document is within ``k`` edits of a window of ``m`` characters, the two share at least ``m - q + 1 - k*q`` q-grams
(an edit destroys at most ``q`` of them), all on diagonals at most ``k`` apart. So, per document:

1. every position whose q-gram occurs in the benchmark is a hit, and every hit lies on a diagonal of the
   items that hold its q-gram;
2. hits are collected per item in diagonal bands of width ``2k + 1`` that overlap by ``k`` or more, so that some
   band has all of a match's diagonals; the windows that hold enough of a band's hits stay, as ranges of starts;
   Of equal windows of an item one is kept, and hits are collected in overlapping stretches of bounded hit count;
3. the same bound with shorter q-grams, all of which the band itself shows, drops most of the other windows;
4. a banded alignment decides on every window that is left: the furthest rows reached with 0, 1, .. ``k`` edits.

An item of fewer than ``q`` characters matches where it stands between word borders, letter for letter.

The work per document is linear in its hits; documents never meet each other. A long repetition of a few characters (rows
of zeros, ruled lines) is shortened to what any window can see of its two ends. The benchmark is read in blocks of bounded
size (a stated query set against all rows), each of which a task holds whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import char_chunks, code_points, cut_lineage, distinct_names, map_batches
from newslens.sources.tables import table

Q = 10
#: Characters of a window, and the step from one window's start to the next: every start is one.
WINDOW, STRIDE = 100, 1
#: Edits per character of a window.
RATE = 0.08
#: Benchmark characters in one block: the index that tasks hold grows with this, not with the benchmark.
BLOCK_CHARS = 1 << 22
#: Characters hashed at once: their arrays stay in a core's cache.
CHUNK = 1 << 17
#: Length of the q-grams that are counted inside a band, starts of a range and rows of bands that are looked at together.
SHORT, RANGE, ROWS = 5, 256, 1 << 14
#: Hits that are held at once, and the longest period of a repetition that is shortened.
HITS, PERIOD = 1 << 19, 8
#: Blocks of the benchmark that follow each other in one task of the filter.
CHAIN = 4
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MAP_BITS = 22


def fold_table() -> np.ndarray:
    """Code point to its normal form: letters and digits in lower case, anything else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalize(codes: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normal form, position of each of its characters): runs of spaces are one, none is left at the start."""
    c = fold[codes]
    keep = np.flatnonzero((c != 32) | (np.concatenate(([32], c[:-1])) != 32)) if len(c) else np.empty(0, np.int64)
    return c[keep], keep


def qgram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, built by doubling."""
    h, width, parts = c.astype(np.uint64) + np.uint64(1), 1, []
    power = _MULT
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    todo, at = q, 0
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        while todo:
            if todo & 1:
                total = total * power + h[at:at + n]
                at += width
            todo >>= 1
            if todo:
                h = h[:-width] * power + h[width:]
                power, width = power * power, width * 2
        return total ^ (total >> np.uint64(29))


def edit_budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a window of ``m`` characters: the rate, but few enough that the bound is at least 1."""
    return min(int(m * rate), (m - q) // q)


def _distinct_windows(c: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Per position of an item: does one of its windows start there, and is it the first of its content?"""
    out, h = np.zeros(len(c), bool), qgram_hashes(c, size)
    starts = np.unique(np.append(np.arange(0, len(h), stride), len(h) - 1))
    out[starts[np.unique(h[starts], return_index=True)[1]]] = True
    return out


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Positions less than ``n`` behind a start."""
    total = np.cumsum(starts)
    return total > np.concatenate((np.zeros(min(n, len(starts)), total.dtype), total[:-n]))


def squeezed(c: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Positions of ``c`` that stay when long repetitions of up to ``PERIOD`` characters lose their middle, by whole
    periods: ``reach`` characters stay at either end, so any stretch of that length that was there is still there, and
    none is new. Repetitions end at the documents' ``ends``."""
    keep = np.ones(len(c), bool)
    for p in range(1, PERIOD + 1):
        same = np.zeros(len(c) + 1, bool)
        same[p:-1] = c[p:] == c[:-p]
        same[np.minimum(ends[:, None] + np.arange(p), len(c)).ravel()] = False
        edges = np.flatnonzero(same[1:] != same[:-1]) + 1
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            gone = (b - a - 2 * reach) // p * p
            if gone > 0 and keep[a:b].all():
                keep[a + reach:a + reach + gone] = False
    return np.flatnonzero(keep)


class Index:
    """Some benchmark items and their q-grams."""

    def __init__(self, items: Sequence[tuple], q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE):
        self.q, self.stride, self.fold, self.ids = q, stride, fold_table(), []
        texts: list[np.ndarray] = []
        short: list[np.ndarray] = []
        short_ids: list = []
        for item, text in items:
            c, _ = normalize(code_points(text or ""), self.fold)
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if len(c):
                (texts if len(c) >= q else short).append(c)
                (self.ids if len(c) >= q else short_ids).append(item)
        self.short_text = {len(self.ids) + n: c for n, c in enumerate(short)}
        self.short: dict[int, dict[bytes, list[int]]] = {}  # length -> text -> numbers of the items
        for n, c in self.short_text.items():
            self.short.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(n)
        self.ids += short_ids
        none = np.empty(0, np.int64)
        kept = [_distinct_windows(c, min(len(c), window), stride) for c in texts]
        hashes = [qgram_hashes(c, q) for c in texts]
        inside = [_covered(k, min(len(c), window) - q + 1)[:len(h)] for c, k, h in zip(texts, kept, hashes)]
        h = np.concatenate([np.empty(0, np.uint64), *(x[i] for x, i in zip(hashes, inside))])
        order = np.argsort(h, kind="stable")
        self.at = np.concatenate([none, *map(np.flatnonzero, inside)])[order]
        self.item = np.repeat(np.arange(len(hashes)), [int(i.sum()) for i in inside])[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.entry = np.repeat(np.arange(len(self.keys)), self.count) * (len(texts) + 1) + self.item
        self.start = np.concatenate([np.empty(0, bool), *kept])
        self.reach = window + int(window * rate) + q
        self.seen = np.zeros(1 << _MAP_BITS, bool)
        self.seen[self._slot(self.keys)] = True
        self.text = np.concatenate([np.empty(0, np.uint32), *texts])
        self.length = np.array([len(c) for c in texts], np.int64)
        self.base = np.cumsum(self.length) - self.length
        self.size = np.minimum(self.length, window)
        self.budget = np.array([edit_budget(int(m), q, rate) for m in self.size], np.int64)
        self.least = self.size - q + 1 - self.budget * q

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * _MULT) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)

    def lookup(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``c``, number of the q-gram) of every q-gram that the items hold."""
        h = qgram_hashes(c, self.q)
        j = np.flatnonzero(self.seen[self._slot(h)]) if len(self.keys) else np.empty(0, np.int64)
        k = np.searchsorted(self.keys, h[j])
        ok = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] == h[j]) if len(j) else j
        return j[ok], k[ok]

    def hits(self, j: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the document, item, position in the item) of every shared q-gram, in parts of about ``HITS``
        that hold all hits of any match: stretches of the document that overlap by a match's length, and of a stretch
        with more hits some of the items."""
        total = np.cumsum(self.count[k])
        a, n = 0, len(self.length)
        while a < len(j):
            b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
            b = max(b, int(np.searchsorted(j, j[a] + 2 * self.reach)))
            ranges = [(0, n)]
            while ranges:
                lo, hi = ranges.pop()
                first = np.searchsorted(self.entry, k[a:b] * (n + 1) + lo)
                many = np.searchsorted(self.entry, k[a:b] * (n + 1) + hi) - first
                if many.sum() > HITS and hi - lo > 1:
                    ranges += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                    continue
                entry = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield np.repeat(j[a:b], many), self.item[entry], self.at[entry]
            if b >= len(j):
                return
            a = max(a + 1, int(np.searchsorted(j, j[b] - self.reach)))

    def regions(self, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, first diagonal, first start, last start): the bands and ranges of windows that hold enough distinct
        q-grams of each window of the range."""
        parts = [self._bands(*hits) for hits in self.hits(*self.lookup(c))]
        none = np.empty(0, np.int64)
        return tuple(map(np.concatenate, zip(*parts))) if parts else (none, none, none, none)

    def _bands(self, j: np.ndarray, w: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
        k = self.budget[w]
        step = k + 1
        diagonal = j - i
        # bands of 2k+1 diagonals start every k+1: a match spreads over at most k+1 and lies in one of two bands
        band = np.concatenate([diagonal // step, diagonal // step - 1])
        w2, i2 = np.concatenate([w, w]), np.concatenate([i, i])
        inside = np.concatenate([np.ones(len(w), bool), diagonal % step < k])
        w2, i2, band = w2[inside], i2[inside], band[inside]
        if not len(w2):
            return w2, band, i2, i2
        order = np.lexsort((i2, band, w2))
        w2, i2, band = w2[order], i2[order], band[order]
        same = (w2[1:] == w2[:-1]) & (band[1:] == band[:-1])
        fresh = np.concatenate(([True], ~same | (i2[1:] != i2[:-1])))  # a q-gram of the item counts once in a band
        w2, i2, band = w2[fresh], i2[fresh], band[fresh]
        # a window has enough of them if it holds some hit and the one that is least - 1 places behind it
        behind = np.arange(len(w2)) + self.least[w2] - 1
        last = np.minimum(behind, len(w2) - 1)
        reach = self.size[w2] - self.q
        good = np.flatnonzero((behind < len(w2)) & (w2[last] == w2) & (band[last] == band) & (i2[last] - i2 <= reach))
        if not len(good):
            return good, good, good, good
        w2, band, last, reach, i2 = w2[good], band[good], i2[last[good]], reach[good], i2[good]
        low, high = np.maximum(last - reach, 0), np.minimum(i2, self.length[w2] - self.size[w2])
        head = np.concatenate(([True], (w2[1:] != w2[:-1]) | (band[1:] != band[:-1]) | (low[1:] > high[:-1] + 1)))
        heads = np.flatnonzero(head)
        low, high = low[heads], high[np.append(heads[1:], len(w2)) - 1]
        parts = (high - low) // RANGE + 1
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads, low, high = (np.repeat(x, parts) for x in (heads, low, high))
        low = low + part * RANGE
        return w2[heads], band[heads] * (self.budget[w2[heads]] + 1), low, np.minimum(high, low + RANGE - 1)


def align(index: Index, c: np.ndarray, item: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray,
          lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(range, edits, start, end) of the best alignment, with the document ``c[lo:hi]`` and inside the band of the 2k+1
    diagonals from ``first``, of each window within its budget that starts from ``low`` to ``high`` in the item.

    A window is aligned whole; where it starts and ends in ``c`` is free within the band. Of alignments with equally
    few edits a short stretch of ``c`` is taken. The ranges' rows (item characters) are laid end to end, each range
    closed by a row that matches nothing.
    """
    k, m = index.budget[item], index.size[item]
    rows = high - low + m + 1
    top, n = np.cumsum(rows) - rows, int(rows.sum())
    of, row, cols = np.repeat(np.arange(len(item)), rows), np.arange(n), np.arange(2 * int(k.max()) + 1)
    i = row - top[of] + low[of]
    char = index.text[np.minimum(index.base[item][of] + i, len(index.text) - 1)]
    at = (first[of] + i)[:, None] + cols
    miss = np.append(c, 0)[np.clip(at, 0, len(c))] != char[:, None]
    miss |= (at < lo[of, None]) | (at >= hi[of, None]) | (cols > 2 * k[of, None]) | (i == (high + m)[of])[:, None]
    stop = np.minimum.accumulate(np.where(miss, row[:, None], n)[::-1])[::-1]  # the next row that does not match
    shared = np.concatenate(([0], np.cumsum((stop - row[:, None] >= SHORT).any(1))))
    x = np.flatnonzero((i <= high[of]) & index.start[np.minimum(index.base[item][of] + i, len(index.start) - 1)])
    r = of[x]
    grams = np.maximum(m[r] - SHORT + 1, 0)
    kept = shared[x + grams] - shared[x] >= grams - k[r] * SHORT
    x, r = x[kept], r[kept]
    begin = (first[of] + i)[x, None] + cols
    # the furthest row reached on each diagonal, and the diagonal it was started from; later starts win
    scale = len(cols)
    key = np.where((begin >= lo[r, None]) & (begin <= hi[r, None]) & (cols <= 2 * k[r, None]), x[:, None] * scale + cols, -scale)
    out = []
    for edits in range(int(k.max()) + 1):
        if edits:
            # a substitution keeps the diagonal; leaving out the window's character moves one down, an extra character
            # of the document one up, and both substitution and extra character need one that is there
            f = key // scale
            there = (f >= 0) & (begin + (f - x[:, None]) < hi[r, None])
            gone = np.where(f >= 0, key + scale, -scale)[:, 1:]
            extra = np.where(there, key, -scale)[:, :-1]
            key = np.where(there, key + scale, key)
            key[:, :-1] = np.maximum(key[:, :-1], gone)
            key[:, 1:] = np.maximum(key[:, 1:], extra)
            key = np.where(cols <= 2 * k[r, None], key, -scale)
        f, cap = key // scale, (x + m[r])[:, None]
        f = np.where(f >= 0, np.minimum(stop[np.maximum(f, 0), cols], cap), -1)
        key = f * scale + key % scale
        done = f == cap
        got = np.flatnonzero(done.any(1))
        if len(got):
            gain = np.where(done[got], cols - key[got] % scale, 2 * scale)
            best = gain.argmin(1)
            started = key[got, best] % scale
            out.append((r[got], np.full(len(got), edits), begin[got, started], begin[got, best] + m[r[got]]))
        rest = np.flatnonzero(~done.any(1) & (k[r] > edits))
        if not len(rest):
            break
        x, r, begin, key = x[rest], r[rest], begin[rest], key[rest]
    none = np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*out))) if out else (none, none, none, none)


def matches(c: np.ndarray, ends: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(document, item, start, end, edits) of the windows found in the normalized documents ``c``, which end at
    ``ends``. A band may reach over a border between documents; it is then tried in each of them."""
    item, first, low, high = index.regions(c)
    far = first + high + 2 * index.budget[item] + index.size[item]
    doc = np.searchsorted(ends, np.maximum(first + low, 0), "right")
    n = np.maximum(np.minimum(np.searchsorted(ends, far, "right") + 1, len(ends)) - doc, 0)
    doc = np.repeat(doc, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, first, low, high, far = (np.repeat(x, n) for x in (item, first, low, high, far))
    stops = ends - (np.append(0, c)[ends] == 32)  # a document's last space is not part of its normal form
    lo, hi = np.concatenate(([0], ends))[doc], stops[doc]
    need = index.size[item] - index.budget[item]
    kept = np.flatnonzero(np.minimum(hi, far) - np.maximum(lo, first + low) >= need)
    part = np.cumsum((high - low + index.size[item] + 1)[kept]) // ROWS
    out = [(np.empty(0, np.int64),) * 5]
    for at in np.split(kept, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(kept) else ():
        r, edits, s, t = align(index, c, item[at], first[at], low[at], high[at], lo[at], hi[at])
        out.append((doc[at][r], item[at][r], s, t, edits))
    return tuple(map(np.concatenate, zip(*out)))


def _verbatim(c: np.ndarray, short: dict[int, dict[bytes, list[int]]]) -> Iterator[tuple[int, int]]:
    """(item, position) of the short items that stand in ``c`` between word borders."""
    if not short:
        return
    gap = np.concatenate(([True], c == 32, [True]))  # before position 0, the positions, behind the last
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1]) if len(c) else np.empty(0, np.int64)
    for n, known in short.items():
        some = starts[starts + n <= len(c)]
        some = some[gap[some + n + 1]]
        wanted = np.isin(qgram_hashes(c, n)[some], np.concatenate([qgram_hashes(np.frombuffer(k, np.uint32), n) for k in known]))
        for s in some[wanted].tolist():
            for w in known.get(c[s:s + n].tobytes(), ()):
                yield w, s


def scan(texts: Sequence[str], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Per text, (item, start, end, edits) of its regions in code points: the windows of an item that touch or
    overlap are one region, with the edits of the worst of them."""
    out: list[list] = [[] for _ in texts]
    for a, b in char_chunks(texts, CHUNK) if index.ids else ():
        c, position = normalize(code_points("\n".join(texts[a:b])), index.fold)
        border = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        ends = np.searchsorted(position, border[1:])
        for w, s in _verbatim(c, index.short):
            d = int(np.searchsorted(ends, s, "right"))
            x, y = int(position[s] - border[d]), int(position[s + len(index.short_text[w]) - 1] + 1 - border[d])
            out[a + d].append((w, x, y, 0))
        if index.count[index.lookup(c)[1]].sum() > HITS:
            left = squeezed(c, ends, index.reach)
            c, position = c[left], position[left]
            ends = np.searchsorted(position, border[1:])
        doc, item, s, t, edits = matches(c, ends, index)
        if not len(doc):
            continue
        s, t = position[s], position[t - 1] + 1
        order = np.lexsort((s, item, doc))
        doc, item, s, t, edits = (x[order] for x in (doc, item, s, t, edits))
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        group = np.cumsum(new) * (border[-1] + 1)
        reach = np.maximum.accumulate(t + group)  # the furthest end before, within the document and item
        new[1:] |= s[1:] + group[1:] > reach[:-1]
        heads = np.flatnonzero(new)
        for d, w, x, y, e in zip(doc[heads].tolist(), item[heads].tolist(), (s - border[doc])[heads].tolist(),
                                 np.maximum.reduceat(t - border[doc], heads).tolist(), np.maximum.reduceat(edits, heads).tolist()):
            out[a + d].append((w, x, min(y, len(texts[a + d])), e))
    return out


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                     block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark's items, in blocks by hash that hold about ``block_chars`` characters or less."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + 2 * total // block_chars
    mine = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for b in range(n):
        yield [(r.i, r.t) for r in mine.where(F.col("b") == b).select("i", "t").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = RATE,
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item, start, end, edits): the regions of documents, in code points of the whole text, that hold a
    stretch of a benchmark item; ``edits`` is that of the region's worst window.

    Items shorter than ``q`` characters in normal form match letter for letter between word borders; NULL ones and those
    without a letter or digit match nothing. Result columns that would share a name (also of the two keys) get
    underscores, the later ones first. A document without a match has no row. NULL and empty texts match nothing. Repeated documents or items give
    repeated rows. Rows without a key take part. Further columns are not read.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("i", benchmark.schema[item].dataType),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                           T.StructField("edits", T.LongType())])
    narrow, out = docs.select(F.col(key), F.col(text)).where(F.length(text) > 0), []
    for items in benchmark_blocks(benchmark, item, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, q, window, stride, rate))

        def run(b: pa.RecordBatch, shared=shared) -> dict:
            index = shared.value
            found = [(i, *m) for i, ms in enumerate(scan(b.column(1).to_pylist(), index)) for m in ms]
            return {"k": b.column(0).take(pa.array([f[0] for f in found], pa.int64())), "i": [index.ids[f[1]] for f in found],
                    "start": [f[2] for f in found], "end": [f[3] for f in found], "edits": [f[4] for f in found]}

        out.append(map_batches(narrow, run, schema))
    return reduce(DataFrame.unionAll, out).toDF(*distinct_names(key, item, "start", "end", "edits"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                          item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found, unchanged and without a shuffle. NULL and empty
    texts stay. A task holds the indexes of ``CHAIN`` blocks at most; after those the rows left are written."""
    at, types = docs.columns.index(text), docs.schema
    for n, items in enumerate(benchmark_blocks(benchmark, item, item_text, block_chars)):
        docs = cut_lineage(docs) if n and n % CHAIN == 0 else docs
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = scan([t or "" for t in b.column(at).to_pylist()], shared.value)
            return b.filter(pa.array([not f for f in found]))

        docs = map_batches(docs, run, types)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
