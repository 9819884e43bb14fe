"""Byte ranges of files, read by position in the tasks that need them.

Local files are mapped into memory; stores that Arrow's file systems reach are read in blocks.
Other stores have to be read whole, through Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import mmap
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

#: Schemes that can be read by position; others go through Spark.
BY_POSITION = ("", "file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")
BLOCK = 1 << 20
#: Blocks kept of one file, files kept open, and bytes in one batch of results.
KEPT_BLOCKS, KEPT_FILES, BATCH_BYTES = 64, 16, 32 << 20


def scheme(path: str) -> str:
    found = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found[1].lower() if found else ""


def local_path(path: str) -> str:
    """The path of a ``file:`` URI, or the path itself."""
    return re.sub(r"^file:/*", "/", path)


class Ranged:
    """A file that reads like bytes: length, slices and searches, in cached blocks."""

    def __init__(self, source, size: int):
        self.source, self.size, self.blocks = source, size, OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.source.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
            if len(self.blocks) > KEPT_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, at: int | slice):
        if isinstance(at, int):
            at += self.size if at < 0 else 0
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._block(at // BLOCK)[at % BLOCK]
        start, stop, step = at.indices(self.size)
        if step != 1:
            raise ValueError("only whole ranges can be read")
        if stop - start > BLOCK:
            return bytes(self.source.read_at(stop - start, start))
        parts = [self._block(k) for k in range(start // BLOCK, -(-stop // BLOCK))] if stop > start else []
        whole = b"".join(parts)
        return whole[start % BLOCK : start % BLOCK + stop - start] if parts else b""

    def find(self, what: bytes, start: int = 0) -> int:
        at = start
        while at < self.size:
            part = self[at : min(self.size, at + BLOCK + len(what) - 1)]
            k = part.find(what)
            if k >= 0:
                return at + k
            at += BLOCK
        return -1

    def index(self, what: bytes, start: int = 0) -> int:
        at = self.find(what, start)
        if at < 0:
            raise ValueError("not found")
        return at


@contextmanager
def opened(path: str) -> Iterator:
    """Something that reads like bytes: a map of a local file, or blocks of a remote one."""
    kind = scheme(path)
    if kind in ("", "file"):
        with open(local_path(path), "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                yield b""
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
                yield m
        return
    if kind not in BY_POSITION:
        raise ValueError(f"files of {kind}: can't be read by position")
    fs, inner = pa.fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
    with fs.open_input_file(inner) as f:
        yield Ranged(f, f.size())


class Files:
    """The files that a task reads ranges of; the last few stay open."""

    def __init__(self):
        self.open: OrderedDict = OrderedDict()

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *_) -> None:
        while self.open:
            self.open.popitem()[1][0].__exit__(None, None, None)

    def read(self, path: str, offset: int, size: int) -> bytes:
        """The range, or all of the file at size 0."""
        if path not in self.open:
            manager = opened(path)
            self.open[path] = (manager, manager.__enter__())
            if len(self.open) > KEPT_FILES:
                self.open.popitem(last=False)[1][0].__exit__(None, None, None)
        self.open.move_to_end(path)
        data = self.open[path][1]
        if not size:
            return bytes(data[:])
        if offset < 0 or offset + size > len(data):
            raise ValueError(f"{path} has no bytes {offset} to {offset + size}")
        return bytes(data[offset : offset + size])


def fill_raw(refs: DataFrame) -> DataFrame:
    """``raw`` of rows that have a path and no bytes yet, read by position; no shuffle, no whole files.

    A missing file or range is an error. Other columns pass through.
    """
    names = refs.columns
    at = {c: names.index(c) for c in ("path", "offset", "size", "raw")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Files() as files:
            for batch in batches:
                paths, offsets, sizes = (batch.column(at[c]).to_pylist() for c in ("path", "offset", "size"))
                raw = batch.column(at["raw"])
                first, total, out = 0, 0, []
                for i in range(batch.num_rows):
                    v = raw[i].as_py()
                    if v is None and paths[i] is not None:
                        v = files.read(paths[i], offsets[i] or 0, sizes[i] or 0)
                    out.append(v)
                    total += len(v or b"")
                    if total > BATCH_BYTES or i + 1 == batch.num_rows:
                        part = batch.slice(first, i + 1 - first)
                        cols = [pa.array(out, raw.type) if k == at["raw"] else part.column(k) for k in range(len(names))]
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        first, total, out = i + 1, 0, []

    return refs.mapInArrow(run, refs.schema)
