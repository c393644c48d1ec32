"""Best-fit packing of tokenized documents into sequences, planned on the histogram of piece lengths.

1. Every document is tokenized and closed with an end id; longer ones are cut into pieces.
2. The pieces are counted by length. That histogram has at most ``size`` entries, whatever the corpus.
3. Best-fit decreasing runs over the counts: equal lengths meet equal free spaces in bulk, so the plan is a
   list of slot ranges (length, first rank, first sequence, copies per sequence, offset), not of documents.
4. Every piece gets its rank within its length and takes the planned slot of that rank by a join. Ranks
   are counted within (length, salt) and shifted by the counts of the salts before, so a length that a
   third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslens.llm.common import cut_lineage, map_batches
from newslens.sources.tables import table

SIZE = 4096
END_ID = 1
#: Words whose ids a worker remembers at most; a full memory is emptied. Longer words are not kept.
CACHE_WORDS = 800_000
CACHE_CHARS = 48
SIGNS = ".,;:!?()*%&$#|/\\\"-+=_<>[]{}@~^"
MARKS = re.compile("[\u0130\u0300-\U0010ffff]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class WordTokenizer(dict):
    """Token ids of texts as little-endian uint32 bytes, for a lower-case vocabulary that never joins across a space
    or a newline: each stretch between them is encoded when first met and remembered (word -> bytes).

    A stretch that is letters alone is one word to the vocabulary's pattern, and goes straight to the merge model;
    signs behind a letter or digit are words of their own. All else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # it meets lower-cased words; special tokens are split off before
        self._model, self._letters = self._tok.model, _byte_letters()
        special = {t.content: i for i, t in self._tok.get_added_tokens_decoder().items()}
        self._special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _ids(self, word: str) -> bytes:
        low = None if MARKS.search(word) else word.lower()
        if low and low.isalpha():
            ids = [t.id for t in self._model.tokenize(low if low.isascii() else
                                                      low.encode().decode("latin-1").translate(self._letters))]
        else:
            core = word.rstrip(SIGNS)
            if low is not None and core != word and core[-1:].isalnum():
                return self[core] + self[word[len(core):]]
            ids = self._tok.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self._ids(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text``; a special token's string in it is that token."""
        if self._split is None or not self._split.search(text):
            return self._plain(text)
        return b"".join(self._special[t] if n % 2 else self._plain(t) for n, t in enumerate(self._split.split(text)))

    def _plain(self, text: str) -> bytes:
        # Lower-casing first merges words in the memory; it is left to the tokenizer where combining marks could make
        # the order of the two steps matter.
        text = text if MARKS.search(text) else text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: One tokenizer per Python worker, so that its memory of words outlives a task.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE,
                 end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32 (and ids, if asked for). A document's ids are those of
    its whole text, then ``end_id``; NULL and empty texts have the end id alone. Every piece but the last of a
    document has ``size`` ids."""
    path = path or tokenizer_path()
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    tail = np.array([end_id], "<u4").tobytes()

    def run(b: pa.RecordBatch) -> dict:
        tok = _tokenizer(path)
        ids = [tok.encode(t or "") + tail for t in b.column(1).to_pylist()]
        cuts = [(i, s) for i, x in enumerate(ids) for s in range(0, len(x), 4 * size)]
        parts = [ids[i][s:s + 4 * size] for i, s in cuts]
        out = {key: b.column(0).take(pa.array([i for i, _ in cuts])), "piece": [s // (4 * size) for _, s in cuts],
               "start": [s // 4 for _, s in cuts], "length": [len(p) // 4 for p in parts],
               "ids_crc32": [zlib.crc32(p) for p in parts]}
        return out | ({"ids": [np.frombuffer(p, "<i4") for p in parts]} if keep_ids else {})

    return map_batches(docs.select(F.col(key), F.col(text)), run, T.StructType(fields))


def best_fit_plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length, by best-fit decreasing over the histogram.

    A plan row (length, rank, n, sequence, copies, offset) places the pieces of ranks rank..rank+n-1: piece ``i`` of
    the row goes to sequence + i // copies, at offset + (i % copies) * length. Sequences with equal free space are
    kept as ranges. The tightest space that takes a length is also the tightest after taking one copy, so a
    sequence is given all the copies it holds at once.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    plan, nxt = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first, n = size, nxt, -(-left // (size // length))
                nxt += n
            copies = min(space // length, left)
            used = min(n, left // copies)
            plan.append((length, rank, used * copies, first, copies, size - space))
            put(space - copies * length, first, used)
            put(space, first + used, n - used)
            rank, left = rank + used * copies, left - used * copies
    return plan


_PLAN = "length long, lo long, n long, first long, copies long, base long"


def pack(pieces: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``size``) with sequence_id and offset. Offsets of a sequence are gapless
    from 0. ``order`` names columns that, with the length, fix the order of ranks; rows equal in all of them may
    swap slots. ``pieces`` is read twice: pass a checkpointed table. No pieces: no rows."""
    spark = pieces.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = cut_lineage(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    plan = best_fit_plan({r["length"]: r["n"] for r in
                          counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, size)
    slots = F.broadcast(spark.createDataFrame(plan, _PLAN))  # one row per slot range: bounded by the lengths, not rows
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))) \
        .join(shift, ["length", "_salt"]).withColumn("_rank", F.col("_shift") + F.col("_row") - 1)
    at = F.col("_rank") - F.col("lo")
    return ranked.join(slots, (ranked["length"] == slots["length"]) & (at >= 0) & (at < F.col("n"))) \
        .select(*[ranked[c] for c in pieces.columns],
                (F.col("first") + F.floor(at / F.col("copies"))).alias("sequence_id"),
                (F.col("base") + at % F.col("copies") * ranked["length"]).alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                   size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack every row of ``docs``: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset.
    Repeated rows and rows without a key are packed like any other. Further columns are not read."""
    pieces = cut_lineage(token_pieces(docs, key, text, path, size, end_id, keep_ids))
    return pack(pieces, [key, "piece", "ids_crc32"], size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
