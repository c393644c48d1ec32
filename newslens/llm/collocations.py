"""Phrase collocations per language by Toivonen's mining of frequent phrases.

A sample of the documents proposes phrases, level by level and at a lowered support. One full pass then counts every phrase
whose two parts without the last and without the first word are proposed: that is the proposals together with their
negative border. It counts by a 48-bit hash, so two phrases that share one count as one: that can only add to what looks
frequent. If a phrase that was not proposed looks frequent, its extensions may be frequent too, so the missed phrases join
the proposals. The second pass counts what looks frequent by the phrases themselves, which makes all counts exact, and with it
what the missed phrases add: every phrase that the first pass did not count and whose two parts are proposed, missed or such
phrases themselves. No frequent phrase is left out: its parts are frequent, so (shortest first) the first pass has counted
them, and they are proposed or missed, or they are counted here.

Sets of phrases reach the tasks as a bitmap of hashes of bounded size; a phrase that is in it by chance is counted as well,
which costs time and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslens.llm.common import bound_batches, cut_lineage
from newslens.sources.tables import table

SUPPORT, LONGEST, COVER_PERCENT, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: One document in so many proposes phrases (picked by a hash of its key).
SAMPLE_PART = 4
#: Bits of a set's bitmap: about so many for each phrase, and at most (32 MB); a power of two from 2^15.
BITS_EACH, MOST_BITS = 32, 1 << 28
#: Bytes of text that a task counts at once (longer texts are counted in slices), and words whose hashes it remembers.
CHUNK, CACHE_WORDS = 4 << 20, 400_000
#: Candidates of a language are first ranked in so many parts.
RANK_PARTS = 64

_UPPER = bytes(range(65, 91))
_PLAIN = bytes.maketrans(_UPPER + b",;:!?\n\v\f\r\t", _UPPER.lower() + b"." * 9 + b" ")
_MULT, _KEPT = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 48) - 4)
_BREAK = b"."  # cannot be a word: it separates pieces


def words(plain: bytes) -> list[bytes]:
    """The words of a translated text, with a break wherever a piece ends."""
    return plain.replace(_BREAK, b" . ").split()


def numbered(plain: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(number of every word in order, the distinct words): ``words`` by Arrow."""
    text = pa.array([plain.replace(_BREAK, b" . ")], pa.binary()).cast(pa.string())
    coded = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    ids, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    return (ids[ids != names.index(b"")] if b"" in names else ids), names


def slices(plain: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """(context, part) of consecutive parts of a text, cut between words; the first ``context`` words of each belong to
    the part before (phrases that end in them have been counted)."""
    a, before = 0, []
    while a < len(plain):
        b = len(plain)
        if b - a > limit:
            cut = max(plain.rfind(b" ", a, a + limit), plain.rfind(_BREAK, a, a + limit))
            if cut < a:  # a word longer than the slice: to its end
                cut = min((p for p in (plain.find(b" ", a + limit), plain.find(_BREAK, a + limit)) if p >= 0), default=b - 1)
            b = cut + 1
        own = plain[a:b]
        yield len(before), b" ".join([*before, own])
        before, a = (before + words(own))[1 - LONGEST:], b


class Words(dict):
    """The hash of every word met: 0 for a break, never for a word. Forgets all when it has ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = 0 if word == _BREAK else xxhash.xxh64_intdigest(word) or 1
        return h


class Bitmap:
    """Set of phrase hashes, with false positives."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap_size(phrases: DataFrame, most: int = MOST_BITS) -> int:
    """Bits for a set of as many phrases, ``most`` at most."""
    return min(most, max(1 << 15, 1 << (BITS_EACH * phrases.count()).bit_length()))


def bitmap(phrases: DataFrame, size: int) -> Bitmap:
    """The bitmap of the rows (h), built by the executors in blocks of 2^15 bits."""
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    blocks = phrases.select(at.alias("p")).groupBy(F.shiftright("p", 15).alias("block")) \
        .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for b in blocks:
        bits[b["block"]] = np.frombuffer(b["bits"], np.uint8)
    return Bitmap(bits.reshape(-1))


def phrase_hashes(lang: bytes, words_: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, there) for the phrases of 1 to ``longest`` words that start at every token: the hash of language and
    words, of 48 bits (what tasks exchange is mostly hashes), whose two lowest are k - 1, and whether no break is among the
    words."""
    h = np.full(len(words_), xxhash.xxh64_intdigest(lang, 42), np.uint64)
    there = np.ones(len(words_), bool)
    for k in range(1, longest + 1):
        if k > 1:
            h, there = h[:-1], there[:-1]
        last = words_[k - 1:]
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * _MULT + last
        there = there & (last != 0)
        yield k, ((h ^ (h >> np.uint64(32))) & _KEPT) | np.uint64(k - 1), there


def count_hashes(lang: bytes, words_: np.ndarray, context: int, lengths: range, new: Bitmap | None,
                 old: Bitmap | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the phrases of the given lengths that end after the first ``context`` tokens, whose two parts
    one word shorter are both in ``new``, and not both in ``old``. Single words need no parts."""
    known = past = None
    for k, h, there in phrase_hashes(lang, words_, lengths.stop - 1):
        go = there if known is None else known[:-1] & known[1:]
        done = (np.full(len(go), old is not None) if k == 1 else past[:-1] & past[1:]) if old is not None else None
        if k in lengths:
            counted = go if done is None else go & ~done
            counted = counted & (np.arange(len(go)) + k > context) if context else counted
            yield np.unique(h[counted], return_counts=True)
        if k + 1 < lengths.stop:
            known = go & new.holds(h)
            past = done & there & old.holds(h) if old is not None else None


def count_exactly(lang: bytes, ids: np.ndarray, names: list[bytes], words_: np.ndarray, context: int, longest: int,
                  frequent: Bitmap, new: Bitmap | None, old: Bitmap | None) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(k, phrases, counts), told apart by their words, of the phrases that look frequent and of those that ``new`` adds: whose
    two parts one word shorter are in ``new`` or added themselves, and which were not counted by ``old``. A phrase whose
    beginning is neither cannot be frequent and is left out."""
    at, phrases = np.zeros(len(ids), np.int64), [b""]  # number of the phrase that starts at a token (0: none)
    known = past = None
    for k, h, there in phrase_hashes(lang, words_, longest):
        fresh = np.zeros(len(h), bool)
        if new is not None:
            go, done = (there, there) if k == 1 else (known[:-1] & known[1:], past[:-1] & past[1:])
            fresh = go & ~done
            known, past = go & (new.holds(h) | ~done), done & old.holds(h)
        at = at[:len(h)]
        some = np.flatnonzero((fresh | (there & frequent.holds(h))) & ((at > 0) | (k == 1)))
        pair, uniq = pd.factorize(at[some] * len(names) + ids[some + k - 1])
        first, last = uniq // len(names), uniq % len(names)
        phrases = [b"", *(names[v] if k == 1 else phrases[u] + b" " + names[v] for u, v in zip(first.tolist(), last.tolist()))]
        at = np.zeros(len(h), np.int64)
        at[some] = pair + 1
        n = np.bincount(pair[some + k > context], minlength=len(uniq))
        counted = np.flatnonzero(n)
        yield k, [phrases[i + 1] for i in counted.tolist()], n[counted]


def _map_texts(docs: DataFrame, fn, schema: str, chunk: int) -> DataFrame:
    """``fn(lang, context, ids, names, words)`` on chunks of the texts of rows (lang, text): the words by number, the names
    of the numbers, and the words' hashes. A chunk is of one language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cache = {}, 0, Words()

        def hashed(lang, context, plain):
            ids, names = numbered(plain)
            return fn(lang, context, ids, names, np.fromiter(map(cache.__getitem__, names), np.uint64, len(names))[ids])

        def flush():
            for lang, texts in held.items():
                yield from hashed(lang, 0, _BREAK.join(texts))

        for b in batches:
            for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                plain = text.translate(_PLAIN)
                if len(plain) > chunk:
                    for context, part in slices(plain, chunk):
                        yield from hashed(lang, context, part)
                    continue
                held.setdefault(lang, []).append(plain)
                size += len(plain)
                if size > chunk:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return bound_batches(docs).mapInArrow(run, schema)


def hash_counts(docs: DataFrame, least: int, lengths: range, new: Bitmap | None = None, old: Bitmap | None = None,
                chunk: int = CHUNK) -> DataFrame:
    """(h, f): ``count_hashes`` over the rows (lang, text), of the phrases that occur ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast((new, old))

    def fn(lang, context, ids, names, words_):
        for h, n in count_hashes(lang, words_, context, lengths, *shared.value):
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "f"])

    counts = _map_texts(docs, fn, "h long, f long", chunk).groupBy("h").agg(F.sum("f").alias("f"))
    return _written(counts.where(F.col("f") >= least), shared)


def _written(df: DataFrame, shared: Broadcast) -> DataFrame:
    """``df`` checkpointed; the bitmaps that its tasks read are of no more use."""
    df = cut_lineage(df)
    shared.destroy()
    return df


def phrase_counts(docs: DataFrame, least: int, frequent: Bitmap, new: Bitmap | None = None, old: Bitmap | None = None,
                  longest: int = LONGEST, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, k, f): ``count_exactly`` over the rows (lang, text), of the phrases that occur ``least`` times, and the
    empty phrase (k = 0) of every language with the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, new, old))

    def fn(lang, context, ids, names, words_):
        rows = count_exactly(lang, ids, names, words_, context, longest, *shared.value)
        for k, phrases, n in [(0, [b""], np.array([np.count_nonzero(words_[context:])])), *rows]:
            if n.sum():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(len(n), np.int32))),
                     pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(n), k, np.int32)),
                     pa.array(n.astype(np.int64))], names=["lang", "phrase", "k", "f"])

    counts = _map_texts(docs, fn, "lang string, phrase string, k int, f long", chunk) \
        .groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return _written(counts.where((F.col("f") >= least) | (F.col("k") == 0)), shared)


def lowered(support: int, part: int) -> int:
    """Support in a sample of one document in ``part`` that few phrases of the given support miss."""
    mean = support / part
    return max(1, math.ceil(mean - 1.645 * math.sqrt(mean)))


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def propose(sample: DataFrame, least: int, longest: int = LONGEST, bits: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(h): hashes of phrases of up to ``longest - 1`` words with ``least`` occurrences in the sample, level by level."""
    found = None
    for k in range(1, longest):
        seen = bitmap(found, bitmap_size(found, bits)) if found is not None else None
        level = hash_counts(sample, least, range(k, k + 1), seen, None, chunk).select("h")
        found = level if found is None else found.unionByName(level)
    return found


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, key: str = "doc_id", lang: str = "lang",
                     text: str = "text", part: int = SAMPLE_PART, bits: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, k, f): all phrases of 1 to ``longest`` words (4 at most) with at least ``support`` occurrences, and
    for every language the empty phrase (k = 0) with the number of all words. See ``collocations`` for the words."""
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words at most")
    sample = docs.where(F.pmod(F.xxhash64(key, F.lit(13)), F.lit(part)) == 0)
    proposed = propose(_texts(sample, lang, text), lowered(support, part), longest, bits, chunk)
    docs, size = _texts(docs, lang, text), bitmap_size(proposed, bits)  # of one size, a larger set's bitmap holds a smaller's
    new = bitmap(proposed, size)
    seen = hash_counts(docs, support, range(1, longest + 1), new, None, chunk)
    frequent = bitmap(seen, bitmap_size(seen, bits))
    missed = cut_lineage(seen.where(F.col("h").bitwiseAND(F.lit(3)) < longest - 1).select("h").join(proposed, "h", "left_anti"))
    if missed.isEmpty():
        return phrase_counts(docs, support, frequent, None, None, longest, chunk)
    return phrase_counts(docs, support, frequent, bitmap(proposed.unionByName(missed), size), new, longest, chunk)


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,0)")


def _part(start: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", start, n), " ")


def score_phrases(frequent: DataFrame, scale: int = SCALE, cover: int = COVER_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score): every phrase of two words or more with its lowest-scoring cut, but for those that
    lie inside a longer one with at least ``cover`` percent of their occurrences."""
    held = frequent.where(F.col("k") > 0)
    phrases = held.where(F.col("k") > 1).withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")) \
        .select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"),
                _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = held.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = held.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]) \
        .withColumn("x", _exact("a") * F.lit(scale).cast("decimal(10,0)")).withColumn("y", _exact("l") + _exact("r")) \
        .withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(i, n))))
    covers = phrases.where(F.col("k") > 2).select("lang", F.col("a").alias("f"), F.explode(inner).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    hundred, share = F.lit(100).cast("decimal(3,0)"), F.lit(cover).cast("decimal(3,0)")
    return best.join(covers, ["lang", "phrase"], "left") \
        .where(F.col("most").isNull() | (hundred * _exact("most") < share * _exact("a"))) \
        .select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, key: str = "doc_id", lang: str = "lang",
                 text: str = "text", part: int = SAMPLE_PART, bits: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of every language.

    A-Z are lower-cased, texts split at ``. , ; : ! ?`` and line ends (code points 10 to 13) into pieces, pieces at blanks
    and tabs into words. Phrases lie inside a piece; occurrences may overlap. ``a`` is a phrase's number of occurrences
    (at least ``support``), ``l`` and ``r`` those of the parts of its lowest-scoring cut, ``n`` the language's words.
    Ranked by score, then ``a``, then phrase. A NULL text is empty; a NULL language is ``und``; a row without a key is
    sampled like any other; repeated rows count each time; no rows: no rows. Further columns are not read.
    """
    frequent = frequent_phrases(docs, support, LONGEST, key, lang, text, part, bits, chunk)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = score_phrases(frequent).withColumn("s", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order))) \
        .where(F.col("rank") <= top).drop("rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top)
    totals = frequent.where(F.col("k") == 0).select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.cut, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * cut.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:cut.cut], ' ')
           JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.cut + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
inner_ AS (
  SELECT c.lang, c.a, unnest(flatten(list_transform(range(2, c.k), lambda m:
    list_transform(range(1, c.k - m + 2), lambda i: array_to_string(c.w[i:i + m - 1], ' '))))) AS phrase
  FROM c WHERE c.k > 2),
cover AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN cover USING (lang, phrase)
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * b.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000"""
