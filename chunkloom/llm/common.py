"""Shared pieces: scratch tables, table access, byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of a-z, 0-9 and all non-ASCII characters, after lower-casing A-Z.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only on a single machine whose session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="chunkloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/chunkloom-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        w = df.write
        if partition_by:
            w = w.partitionBy(partition_by)
        # Nothing reads the shuffles behind a written table again: their files go at once.
        was = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            w.parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in kept:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the bitmaps that let rows pass by a join; their size is fixed, whatever the number of rows.
BITMAP_BITS = 1 << 26


def bit_of(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS))


def bitmap_of(rows: DataFrame, *keys: str) -> np.ndarray:
    """A bitmap of fixed size with the hashes of the rows' keys."""
    bit = bit_of(*map(F.col, keys)) + 1  # the bitmap functions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in parts:  # at most BITMAP_BITS / 32768 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def bits_set(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def has_bit(bitmap: np.ndarray):
    """A column function: whether the bit is set. Only the numbers of bits go through Python."""
    packed = zlib.compress(bitmap.tobytes(), 1)
    cache: list[np.ndarray] = []

    def test(bit: pd.Series) -> pd.Series:
        if not cache:
            cache.append(np.frombuffer(zlib.decompress(packed), np.uint8))
        return pd.Series(bits_set(cache[0], bit.to_numpy()))

    return F.pandas_udf(test, "boolean")


_KIND = np.zeros(256, dtype=bool)
_KIND[ord("0") : ord("9") + 1] = True
_KIND[ord("a") : ord("z") + 1] = True
_KIND[ord("A") : ord("Z") + 1] = True
_KIND[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def is_word(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return _KIND[data]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` text bytes (or one row) as (first, last, bytes, offsets).

    Offsets have one entry more than rows and start at 0. Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, dtype=np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; a document boundary also ends a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    inside = _KIND[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[(off > 0) & (off < len(data))]
    at_start = inside & ~before
    at_start[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(at_start), np.flatnonzero(ends) + 1


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each lower-cased word, from prefix sums of a polynomial modulo 2**64.

    Works through blocks of bytes, so that its temporary arrays stay small.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + block, side="right")))
        part = data[at : ends[j - 1]]
        p, q = _powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((acc[e] - acc[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, per_doc: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each document and their counts.

    A document of fewer than k words, but not none, has one shingle of all its words.
    Returns (hashes sorted within each document, number per document).
    """
    n_docs = len(per_doc)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    n_sh = np.where(per_doc >= k, per_doc - k + 1, (per_doc > 0).astype(np.int64))
    sh_first = np.concatenate([[0], np.cumsum(n_sh)])
    total = int(sh_first[-1])
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    owner = np.repeat(np.arange(n_docs), n_sh)
    at = first[owner] + (np.arange(total) - sh_first[owner])
    h = np.zeros(total, np.uint64)
    left = per_doc[owner]
    for j in range(k):
        w = words[np.minimum(at + j, len(words) - 1)]
        h = np.where(j < left, mix64(h * np.uint64(0x100000001B3) + w + np.uint64(j + 1)), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(total, bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n_docs)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, type=kind))
