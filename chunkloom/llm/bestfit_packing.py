"""Best-two-fit packing of tokenised documents into sequences of bounded length.

Tokens come from a word-level cache in front of the tokenizer: its pre-tokenizer splits texts
into words whose ids do not depend on their neighbours, so each distinct word is encoded once
a worker. Texts outside the cache's alphabet go through the tokenizer whole.

The packing works on the histogram of piece lengths, which has one bin per length whatever the
input's size: the driver fills a bin greedily, swaps its smallest document for two unpacked ones
that fit the gap more tightly, and repeats the pattern as long as its lengths last. The plan is
a short list of rank ranges per length; a broadcast range join places every piece.

Defined results: a null or empty text has the closing id alone; repeated rows are packed one
by one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch, _powers, mix64, slices, table
from chunkloom.llm.kk_sharding import slots

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Distinct words that a worker remembers; beyond, it starts afresh.
CACHE_WORDS = 1_500_000

# Byte classes of the cache's alphabet: blanks, letters, digits (a word each), other printable
# ASCII (in runs), and what sends a text to the tokenizer whole. Two-byte characters that start
# with 0xC3 are letters, but for the signs of multiplication and division.
_BLANK, _LETTER, _DIGIT, _OTHER, _AWAY = range(5)
_CLASS = np.full(256, _AWAY, np.uint8)
_CLASS[32:127] = _OTHER
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER
_CLASS[ord("'")] = _AWAY  # contractions
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Ids of texts by a cache, keyed by a 64-bit hash, over the tokenizer's words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.first = self.len = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode distinct words in one string; blanks keep them apart and have no ids."""
        e = self.tok.encode(" ".join(words), add_special_tokens=False)
        n = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(words))
        first = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, np.asarray(e.ids, np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.len = np.insert(self.len, at, n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each text) of the texts data[off[i]:off[i+1]], as the tokenizer gives them."""
        n_docs = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        kind = _CLASS[data]
        bad = kind == _AWAY
        two = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        bad[two] = True
        bad[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = True
        away = np.zeros(n_docs, bool)
        at = np.flatnonzero(bad)
        if len(at):
            away[np.searchsorted(off, at, side="right") - 1] = True
        low = _LOW[data]
        upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[:-1] == 0xC3)) + 1
        low[upper] += 32
        edge = off[(off > 0) & (off < len(data))]
        starts = np.ones(len(data), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        starts[edge] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], len(data))
        owner = np.searchsorted(off, begin, side="right") - 1
        word = (kind[begin] != _BLANK) & ~away[owner]
        begin, end, owner = begin[word], end[word], owner[word]
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        p, q = _powers(len(data) + 1)
        acc = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
        h = mix64((acc[end] - acc[begin]) * q[begin] + (end - begin).astype(np.uint64))
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = low.tobytes()
            self._learn(keys[new], [raw[begin[w] : end[w]].decode() for w in where[new]])
            at = np.searchsorted(self.keys, keys)
        n = self.len[at][back]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.first[at][back] - ends + n, n)]
        counts = np.bincount(owner, weights=n, minlength=n_docs).astype(np.int64)
        if away.any():
            raw = data.tobytes()
            cut = np.concatenate([[0], np.cumsum(counts)])
            parts = [flat[cut[i] : cut[i + 1]] for i in range(n_docs)]
            for i in np.flatnonzero(away):
                parts[i] = np.asarray(self.tok.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, counts


_CACHES: dict[str, WordCache] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = tokenizer_path(path)
        cache = _CACHES.get(full) or _CACHES.setdefault(full, WordCache(full))
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            docs = batch.column(0).to_pylist()
            for i, j, data, off in slices(batch, "text"):
                flat, counts = cache.encode(data, off)
                last = np.cumsum(counts)
                closed = np.insert(flat, last, END_ID).astype("<u4")
                bounds = np.concatenate([[0], last + np.arange(1, j - i + 1)]).tolist()
                raw = memoryview(closed).cast("B")
                for k in range(j - i):
                    a, b = bounds[k], bounds[k + 1]
                    for p, at in enumerate(range(a, b, capacity)):
                        to = min(at + capacity, b)
                        for col, x in zip(rows, (docs[i + k], p, at - a, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenised_pieces(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    return documents.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity), PIECES)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin, longest first) and how often each is used.

    counts[l] is the number of pieces of length l; index 0 is not used.
    """
    c = counts.astype(np.int64).copy()
    index = np.arange(capacity + 1)
    fit = np.maximum.accumulate(np.where(c > 0, index, 0))  # the longest length at hand up to l
    plan: list[tuple[list[int], int]] = []

    def take(n: int, by: int = 1) -> None:
        nonlocal fit
        had = c[n] > 0
        c[n] -= by
        if (c[n] > 0) != had:
            fit = np.maximum.accumulate(np.where(c > 0, index, 0))

    while fit[capacity]:
        bin_, gap = [], capacity
        while gap and fit[gap]:
            n = int(fit[gap])
            bin_.append(n)
            gap -= n
            take(n)
        while gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            x = index[1 : room + 1][c[1 : room + 1] > 0]
            if not len(x):
                break
            y = np.minimum(fit[room - x], x)
            y = np.where((y == x) & (c[x] < 2), fit[np.maximum(x - 1, 0)], fit[y])
            best = np.where(y > 0, x + y, 0)
            k = int(best.argmax())
            if best[k] <= small:
                break
            bin_.pop()
            take(small, -1)
            for n in (int(x[k]), int(y[k])):
                take(n)
                bin_.append(n)
            bin_.sort(reverse=True)
            gap = capacity - sum(bin_)
        need = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(need)
        more = int((c[used] // need[used]).min())
        if more:
            for n in used:
                take(int(n), more * int(need[n]))
        plan.append((bin_, 1 + more))
    return plan


def plan_ranges(plan: list[tuple[list[int], int]], capacity: int) -> pd.DataFrame:
    """For each pattern and length: the ranks that it takes, its first sequence and place."""
    cursor = np.zeros(capacity + 1, np.int64)
    out, seq = [], 0
    for bin_, times in plan:
        at = 0
        for n in dict.fromkeys(bin_):
            m = bin_.count(n)
            out.append((n, int(cursor[n]), int(cursor[n]) + m * times, seq, m, at))
            cursor[n] += m * times
            at += m * n
        seq += times
    return pd.DataFrame(out, columns=["len", "rank_from", "rank_to", "seq_from", "per_seq", "place"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.keep(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    ranges = plan_ranges(plan_bins(counts, capacity), capacity)
    table_ = spark.createDataFrame(ranges, "len long, rank_from long, rank_to long, seq_from long, per_seq long, place long")
    parts = min(256, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranked = slots(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], parts)
    hit = (F.col("length") == F.col("len")) & (F.col("slot") >= F.col("rank_from")) & (F.col("slot") < F.col("rank_to"))
    j = ranked.join(F.broadcast(table_), hit)
    k = F.col("slot") - F.col("rank_from")
    return j.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq_from") + F.floor(k / F.col("per_seq"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(k, F.col("per_seq")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    return pack(tokenised_pieces(documents, tokenizer, capacity), capacity)


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bestfit_packing": op6_bestfit_packing}
