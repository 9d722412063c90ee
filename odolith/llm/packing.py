"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed token capacity.

Lengths are whole numbers up to the capacity, so bins with the same room left, and documents of the same length, are
interchangeable. Best-fit decreasing therefore runs over the histogram of lengths (at most ``capacity`` rows, whatever the
input): a segment tree over remaining capacities finds the tightest class of open bins in logarithmic time, and one step
places a whole run of equal documents. The outcome is that of placing the documents one by one. The plan, some tens of
thousands of runs at most, is broadcast; each document finds its run by (length, rank among equal lengths). Ranks are
taken inside buckets of about ``BUCKET`` rows, so no length, however common, is one task; a number that each piece gets when it is made keeps rows apart that are equal.

A null text counts as empty: the document is the end id alone. Only documents over the capacity are cut. Rows that repeat
are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut, give_back

CAPACITY = 4096
END_ID = 1
BUCKET = 512
#: words, and parts of words that are no ASCII letters, that a worker keeps: at most about 110 and 15 MB
_CACHE, _MARKS = 500_000, 87_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


class _WordIds(dict):
    """Ids of words, as little-endian bytes; words never span a space, so a text's ids are its words' ids in a row.

    Words of printable ASCII are split here, all others and those that may hold a special token by the tokenizer itself. What the pre-tokenizer leaves in one
    piece is a word of its own, so words and the pieces of longer ones share one cache; pieces that as words would be split again are in ``marks``.
    """

    #: fixed values: the vocabulary's own pre-tokens, for lower-case printable ASCII
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.marks: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.marks.clear()
        self[""] = b""

    def _ids(self, piece: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(piece)], "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a part of a word, of lower-case letters or of something else."""
        if piece.isascii() and piece.isalpha():
            return self[piece]
        ids = self.marks.get(piece)
        if ids is None:
            ids = self._ids(piece)
            if len(self.marks) >= _MARKS:
                self.marks.clear()
            if len(piece) <= 64:
                self.marks[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if "<|" in word:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        elif word.isascii() and word.isprintable():
            low = word.lower()
            if low.isalpha():
                ids = self._ids(low) if low == word else self[low]
            else:
                ids = b"".join(map(self._piece, self.SPLIT.findall(low)))
        else:
            low = self.tokenizer.normalizer.normalize_str(word)
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(low)]
            ids = self._ids(word) if parts == [word] else b"".join(map(self._piece, parts))
        if len(word) <= 64:
            if len(self) >= _CACHE:
                self.forget()
            self[word] = ids
        return ids


@lru_cache(2)
def _word_ids(vocabulary: str) -> _WordIds:
    return _WordIds(vocabulary)


def token_bytes(texts: list[str | None], vocabulary: str) -> list[bytes]:
    """Ids of each text, without the end id, as little-endian unsigned 32-bit integers."""
    of = _word_ids(vocabulary).__getitem__
    return [b"".join(map(of, (t or "").replace("\n", " ").split(" "))) for t in texts]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows of ``PIECE``: every document of ``docs`` (doc_id, text) as ids and an end id, cut only where it is over the capacity.

    ``vocabulary`` is the content of the tokenizer file, of fixed size, so that executors need no file of their own.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        made = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                cols: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), token_bytes(part.column(1).to_pylist(), sent.value), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        for c, v in zip(cols, (doc_id, k, s // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                cols.append([k & 0x7FFFFFFF for k in range(made, made + len(cols[0]))])
                made += len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
            give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the open bins with that much room, as id ranges."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.bins[room].append((first, count))
            k = room + self.size
            while k and not self.any[k]:
                self.any[k] = 1
                k >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        if not self.bins[room]:
            k = room + self.size
            self.any[k] = 0
            while k > 1 and not self.any[k ^ 1]:
                k >>= 1
                self.any[k] = 0
        return got

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open bin has."""
        k = need + self.size
        if self.any[k]:
            return need
        while k > 1 and not (k & 1 == 0 and self.any[k + 1]):
            k >>= 1
        if k <= 1:
            return None
        k += 1
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}, as runs (length, lo, hi, bin, each, base).

    The documents of ``length`` with ranks lo..hi-1 go into bins bin, bin+1, ..., ``each`` to a bin, from offset base on.
    """
    tree, runs, opened = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = tree.pop(room)
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                tree.push(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                runs.append((length, rank, rank + left, first + full, left, capacity - room))
                tree.push(room - left * length, first + full, 1)
                left, full = 0, full + 1
            if full < count:
                tree.push(room, first + full, count - full)
    return runs


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (``PIECE``) with sequence_id and offset in place of salt."""
    spark = rows.sparkSession
    done = cut(rows, "pieces")
    counts = {r[0]: r[1] for r in done.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, bin long, each long, base long").coalesce(1)
    shares = spark.createDataFrame([(k, -(-v // BUCKET)) for k, v in counts.items()], "length long, n_buckets long").coalesce(1)
    dealt = done.join(F.broadcast(shares), "length").withColumn("bucket", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32, salt), n_buckets)"))
    before = dealt.groupBy("length", "bucket").count().select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    inside = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")) - 1)
    ranked = inside.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "length").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("bin + (rank - lo) div each").alias("sequence_id"), F.expr("base + (rank - lo) % each * length").alias("offset"))
