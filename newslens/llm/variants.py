"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and the acceptor again.

The composition starts in states that stand for a part that both words share. A pair of words one edit apart has the edit
either behind the first half of the shorter word, then both share that half as a prefix, or inside it, then they share the
rest as a suffix. So every word starts in four partitions (as the shorter or equal, or as the longer word of a pair; by
prefix or by suffix), and each pair is accepted in exactly one of them. A partition that is too large for a task is
started again from states one half further on, until one code point is left between the shared parts; nothing is dropped.

Inside a partition the words' middle parts are made into minimal acceptors (states are what they accept, so those of the
shorter and the longer words are shared). The transducer copies a common beginning, makes one edit - another code point for
the next one, or one more in front of a different one - and copies the rest, so there is one path for every pair. Paths
are followed only where both sides can still reach their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm.common import cut_lineage
from newslens.sources.tables import table

LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
#: Most words, and most code points between the shared parts, of a partition that is composed at once.
BLOCK, BLOCK_CHARS = 4096, 1 << 17

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Acceptor:
    """Minimal automata of word lists, each of one length. A state is the number of its row of arcs; state 0 accepts the
    empty word. Equal languages have equal states, also between lists."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self._known: dict[tuple, int] = {(): 0}
        self._meet: dict[tuple[int, int], bool] = {}

    def add(self, words: list[str]) -> int:
        """The initial state for sorted, distinct words of one length."""
        length = len(words[0])
        share = [0]
        for x, y in zip(words, words[1:]):
            n = 0
            while x[n] == y[n]:
                n += 1
            share.append(n)
        nodes = [(i, 0) for i in range(len(words))]  # (first word, state) of every prefix of the present length
        for depth in range(length - 1, -1, -1):
            above, arcs, first = [], [], 0
            for i, state in nodes:
                if i and share[i] < depth:  # a new prefix begins
                    above.append((first, self._state(arcs)))
                    arcs, first = [], i
                arcs.append((words[i][depth], state))
            above.append((first, self._state(arcs)))
            nodes = above
        return nodes[0][1]

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        row = tuple(arcs)
        state = self._known.get(row)
        if state is None:
            state = self._known[row] = len(self.arcs)
            self.arcs.append(dict(row))
        return state

    def meet(self, p: int, q: int) -> bool:
        """Do the two states accept a common word?"""
        memo, stack = self._meet, [(p, q)]
        while stack:
            x, y = pair = stack[-1]
            if pair in memo:
                stack.pop()
                continue
            if x == y:
                memo[pair] = True
                continue
            other = self.arcs[y]
            after = [(s, other[c]) for c, s in self.arcs[x].items() if c in other]
            if any(memo.get(a) for a in after):
                memo[pair] = True
            elif todo := [a for a in after if a not in memo]:
                stack.append(todo[0])
            else:
                memo[pair] = False
        return memo[p, q]

    def common(self, p: int, q: int, not_first: str = "") -> Iterator[str]:
        """The words that both states accept, without those that begin with ``not_first``."""
        stack = [(p, q, [], not_first)]
        while stack:
            x, y, path, barred = stack.pop()
            while x:  # along the arcs; only a fork copies the path
                other = self.arcs[y]
                after = [(c, s, other[c]) for c, s in self.arcs[x].items()
                         if c in other and c != barred and self.meet(s, other[c])]
                if not after:
                    break
                stack += [(s, t, [*path, c], "") for c, s, t in after[1:]]
                c, x, y = after[0]
                path.append(c)
                barred = ""
            else:
                yield "".join(path)


def one_edit_pairs(shorter: list[str], longer: list[str], at_end: bool) -> Iterator[tuple[str, str, bool]]:
    """(x, y, y is longer) for every pair one edit apart: x and y of ``shorter`` (words of one length; each pair once),
    or x of ``shorter`` and y of ``longer`` (one code point more). ``at_end``: also where y is x and one more."""
    if not shorter:
        return
    machine = Acceptor()
    arcs, root = machine.arcs, machine.add(shorter)
    swaps: dict[int, list] = {}
    inserts: dict[tuple[int, int], list] = {}
    path: list[str] = []
    stack = [(root, machine.add(longer) if longer else None, 0, "")]
    while stack:
        q, s, depth, c = stack.pop()
        path[max(depth - 1, 0):] = [c] if depth else []
        if q not in swaps:
            out = list(arcs[q].items())
            swaps[q] = [(a + w, b + w) for i, (a, x) in enumerate(out) for b, y in out[i + 1:] if machine.meet(x, y)
                        for w in machine.common(x, y)]
        here = swaps[q]
        more = []
        if s is not None:
            if (q, s) not in inserts:
                inserts[q, s] = [(w, b + w) for b, y in arcs[s].items() if machine.meet(q, y)
                                 for w in machine.common(q, y, b) if w or at_end]
            more = inserts[q, s]
        if here or more:
            begin = "".join(path)
            for x, y in here:
                yield begin + x, begin + y, False
            for x, y in more:
                yield begin + x, begin + y, True
        for a, x in arcs[q].items():
            stack.append((x, arcs[s].get(a) if s is not None else None, depth + 1, a))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points and ``least_count`` occurrences.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Let h be the crc32 of ``<key>:<word>``:
    if ``damage`` divides it, the word's code point h modulo its length is deleted first (typing errors to find). A NULL
    text has no words; a NULL key counts as empty.
    """
    run = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
                      F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("r"))
    low = run.where(F.length("r") >= least_length).select("k", F.when(
        F.col("r").rlike("[A-Z]"), F.translate("r", _UPPER, _UPPER.lower())).otherwise(F.col("r")).alias("r"))
    h = low.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "r").cast("binary")))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    return h.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("r")).alias("word")) \
        .where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _started(rows: DataFrame) -> DataFrame:
    """Rows (word, n, long, a, b) - the word's middle part is [a, b) - with the number of their partition: equal outer
    parts, equal length between them (``long`` words have one code point more)."""
    parts = [F.length("word") - F.col("long").cast("int"), F.col("a"), F.substring("word", F.lit(1), F.col("a")),
             F.substring("word", F.col("b") + 1, F.length("word"))]
    return rows.withColumn("part", F.xxhash64(*parts))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row in the partition of its first half and in that of its second half."""
    long, half = F.col("long").cast("int"), F.floor((F.col("b") - F.col("a") - F.col("long").cast("int")) / 2).cast("int")
    behind = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    inside = F.struct(F.col("a").alias("a"), (F.col("a") + half + long).alias("b"))
    return rows.select("word", "n", "long", F.explode(F.array(behind, inside)).alias("m")) \
        .select("word", "n", "long", "m.a", "m.b")


def _partitions(words: DataFrame, block: int, chars: int) -> DataFrame:
    """(part, word, n, long, a, b) of partitions that hold at most ``block`` words and ``chars`` code points between the
    shared parts, or only one code point between them (then the alphabet bounds them)."""
    rows = _halved(words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("long"),
                                F.lit(0).alias("a"), F.length("word").alias("b")))
    out = []
    while True:
        rows = _started(rows)
        sizes = rows.groupBy("part").agg(F.count("*").alias("words"), F.sum(F.col("b") - F.col("a")).alias("chars"),
                                         F.max((~F.col("long")).cast("int")).alias("has")).where("words > 1 and has = 1")
        rows = cut_lineage(rows.join(sizes.drop("has"), "part"))
        fits = ((F.col("words") <= block) & (F.col("chars") <= chars)) | (F.col("b") - F.col("a") - F.col("long").cast("int") <= 1)
        out.append(rows.where(fits).select("part", "word", "n", "long", "a", "b"))
        rows = rows.where(~fits)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rows = _halved(rows)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one partition after the other, from rows sorted by partition."""
    part, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != part:
                if len(held) > 1:
                    yield held
                part, held = row[0], []
            held.append(row[1:])
    if len(held) > 1:
        yield held


def _accepted(group: list[tuple]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """((word, n), (word, n)) for every accepted pair of one partition's rows (word, n, long, a, b)."""
    apart: dict[tuple, tuple[dict, dict]] = {}  # equal numbers of different partitions are told apart
    for word, n, long, a, b in group:
        apart.setdefault((len(word) - long, word[:a], word[b:]), ({}, {}))[long][word[a:b]] = (word, n)
    for (_, _, end), (short, more) in apart.items():
        for x, y, longer in one_edit_pairs(sorted(short), sorted(more), not end):
            yield short[x], (more if longer else short)[y]


def _composed(words: DataFrame, run, schema: str, block: int, chars: int) -> DataFrame:
    return _partitions(words, block, chars).repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def near_pairs(words: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """(x, y): every two of the distinct words (word, n) that differ by exactly one inserted, deleted or replaced code
    point, once; x is the shorter, or of equal length and smaller in code-point order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            pairs = list(_accepted(group))
            for i in range(0, len(pairs), 1 << 14):
                some = pairs[i:i + (1 << 14)]
                yield pa.RecordBatch.from_pydict({"x": [x[0] for x, _ in some], "y": [y[0] for _, y in some]})

    return _composed(words, run, "x string, y string", block, chars)


def near_words(words: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, n_near, best_n, best) for the words that have near ones: how many, and the near word of largest n (ties: the
    smallest). Pairs are added up in their partition before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def rows():
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["word", "n_near", "best_n", "best"])

        for group in _groups(batches):
            seen: dict[str, list] = {}
            for pair in _accepted(group):
                for (w, _), (v, m) in (pair, pair[::-1]):
                    s = seen.get(w)
                    if s is None:
                        seen[w] = [1, -m, v]
                    else:
                        s[0] += 1
                        if (-m, v) < (s[1], s[2]):
                            s[1], s[2] = -m, v
            out += [(w, k, -m, v) for w, (k, m, v) in seen.items()]
            if len(out) >= 1 << 14:
                yield rows()
                out = []
        if out:
            yield rows()

    parts = _composed(words, run, "word string, n_near long, best_n long, best string", block, chars)
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(
        (-F.col("best_n")).alias("m"), F.col("best").alias("v"))).alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.v").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): the last of the forms that follow each other. Every round doubles the steps
    taken; counts rise along forms, so they end."""
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut_lineage(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")))
        steps = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return steps


def group_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the distinct words (word, n).

    Words one inserted, deleted or replaced code point apart are near. ``form`` is the near word of largest n (ties:
    smallest in code-point order) if that is at least ``ratio`` times the word's n, else NULL; ``root`` is the last of
    the forms that follow each other from the word (itself, if it has none). Words of any length take part. No words: no
    rows.
    """
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, block, chars)
    fits = F.col("best_n") >= ratio * F.col("n")
    columns: list[Column] = [F.col("word"), F.col("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")]
    known = cut_lineage(words.join(near, "word", "left").select(*columns))
    roots = _roots(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda a, b:
      CASE WHEN (a & 1) = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (
  SELECT r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(k || ':' || r, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS UBIGINT)]
              ELSE [CAST(195 AS UBIGINT), CAST(unicode(c) - 64 AS UBIGINT)] END))),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT DISTINCT word, n, length(word) AS len, left(word, CAST(i AS BIGINT)) || substr(word, CAST(i AS BIGINT) + 2) AS rest, i
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word AS x, x.n AS n, y.word AS y, y.n AS m FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.len = y.len AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word),
best AS (
  SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS y, max(m) AS m, any_value(n) AS n FROM near GROUP BY x),
forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN y END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.x),
walk AS (
  SELECT word, word AS at_ FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at_ AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.at_ AND e.form IS NULL"""
