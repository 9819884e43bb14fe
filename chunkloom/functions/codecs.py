"""Decoding of chunks: bytes to values, and chunks to long rows of cells."""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def _deflate_member(raw: bytes) -> bytes:
    """A zip member with its local header in front."""
    n = 30 + int.from_bytes(raw[26:28], "little") + int.from_bytes(raw[28:30], "little") if raw[:4] == b"PK\3\4" else 0
    return zlib.decompressobj(-15).decompress(raw[n:])


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _shuffle(raw: bytes, size: int) -> bytes:
    n = len(raw) // size
    a = np.frombuffer(raw[: n * size], np.uint8).reshape(size, n)
    return a.T.tobytes() + raw[n * size :]


def _unshuffle_blocks(raw: bytes, size: int) -> bytes:
    return _shuffle(raw, size) if size > 1 else raw


def _blosclz(raw: bytes, n: int) -> bytes:
    """A stream of literal runs and matches of the codec's own format."""
    out, i, ctrl = bytearray(), 1, raw[0] & 31
    while True:
        if ctrl >= 32:
            length, far = (ctrl >> 5) - 1, (ctrl & 31) << 8
            if length == 6:
                while True:
                    code = raw[i]
                    i += 1
                    length += code
                    if code != 255:
                        break
            code = raw[i]
            i += 1
            length += 3
            distance = far + code
            if code == 255 and far == 31 << 8:
                distance = (raw[i] << 8 | raw[i + 1]) + 8191
                i += 2
            at = len(out) - distance - 1
            for k in range(length):
                out.append(out[at + k])
        else:
            out += raw[i : i + ctrl + 1]
            i += ctrl + 1
        if i >= len(raw) or len(out) >= n:
            return bytes(out[:n])
        ctrl = raw[i]
        i += 1


def _blosc(raw: bytes) -> bytes:
    """A container of version 1 or 2: blocks, each split by byte of the elements if it is worth it."""
    flags, typesize = raw[2], raw[3]
    nbytes, blocksize, cbytes = struct.unpack("<III", raw[4:16])
    if flags & 2:  # stored
        return raw[16 : 16 + nbytes]
    if flags & 4:
        raise ValueError("bit-shuffled blosc chunks can't be decoded")
    inner = {0: _blosclz, 1: lambda b, n: pa.decompress(b, n, codec="lz4_raw", asbytes=True), 3: lambda b, n: zlib.decompress(b), 4: lambda b, n: _zstd(b)}.get(flags >> 5)
    if inner is None:
        raise ValueError(f"blosc codec {flags >> 5} can't be decoded")
    blocks = -(-nbytes // blocksize)
    starts = struct.unpack(f"<{blocks}I", raw[16 : 16 + 4 * blocks])
    out = []
    for k, at in enumerate(starts):
        size = min(blocksize, nbytes - k * blocksize)
        whole = size == blocksize
        parts = typesize if not flags & 16 and whole and 1 < typesize <= 16 and size // typesize >= 128 else 1
        block = b""
        for _ in range(parts):
            (n,) = struct.unpack("<i", raw[at : at + 4])
            piece = raw[at + 4 : at + 4 + n]
            block += piece if n == size // parts else inner(piece, size // parts)
            at += 4 + n
        out.append(_unshuffle_blocks(block, typesize) if flags & 1 else block)
    return b"".join(out)


def _lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    table: list[bytes] = []
    out, last, width, have, bits = [], b"", 9, 0, 0
    for byte in raw:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            last, width = b"", 9
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


BYTES: dict[str, Callable[..., bytes]] = {
    "zlib": lambda raw, **_: zlib.decompress(raw),
    "gzip": lambda raw, **_: gzip.decompress(raw),
    "deflate": lambda raw, **_: _deflate_member(raw),
    "zstd": lambda raw, **_: _zstd(raw),
    "blosc": lambda raw, **_: _blosc(raw),
    "lzw": lambda raw, **_: _lzw(raw),
    "packbits": lambda raw, **_: _packbits(raw),
    "shuffle": lambda raw, elementsize=4, **_: _shuffle(raw, elementsize),
    "fletcher32": lambda raw, **_: raw[:-4],
}


def _zstd_packed(raw: bytes, level: int = 1, **_) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


PACK: dict[str, Callable[..., bytes]] = {
    "zlib": lambda raw, level=1, **_: zlib.compress(raw, level),
    "gzip": lambda raw, level=1, **_: gzip.compress(raw, level, mtime=0),
    "zstd": _zstd_packed,
    "shuffle": lambda raw, elementsize=4, **_: np.frombuffer(raw, np.uint8).reshape(-1, elementsize).T.tobytes(),
}


def record_member(raw: bytes, dtype: list, member: str) -> np.ndarray:
    """One field of an array of records."""
    return np.frombuffer(raw, np.dtype([tuple(tuple(x) if isinstance(x, list) else x for x in f) for f in dtype]))[member]


def ascii_table(raw: bytes, width: int, columns: list[tuple[str, str, int]]) -> dict[str, np.ndarray]:
    """Columns (name, dtype like '|S8', first byte) of fixed-width text rows."""
    rows = np.frombuffer(raw[: len(raw) // width * width], f"S{width}")
    text = np.char.ljust(rows, width).view("S1").reshape(len(rows), width) if len(rows) else np.zeros((0, width), "S1")
    return {n: np.ascontiguousarray(text[:, at : at + int(d[2:])]).view(f"S{int(d[2:])}").reshape(-1) for n, d, at in columns}


def heap_arrays(raw: bytes, rows: int, width: int, at: int, letter: str, heap: int, wide: bool = False) -> list[np.ndarray]:
    """Arrays of variable length: (count, offset) at byte ``at`` of each row, values in the heap."""
    dtype = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}[letter]
    pair = np.dtype(">i8" if wide else ">i4")
    out = []
    for r in range(rows):
        n, off = np.frombuffer(raw, pair, 2, r * width + at)
        out.append(np.frombuffer(raw, dtype, int(n), heap + int(off)))
    return out


def fill_strings(raw: bytes, labels: dict[str, str] | str | None) -> list[str | None]:
    """16-byte ids to labels: by a map, all one constant, or null."""
    ids = [raw[i : i + 16].hex() for i in range(0, len(raw) - len(raw) % 16, 16)]
    return [labels.get(i) if isinstance(labels, dict) else labels for i in ids]


def numpy_dtype(dtype) -> np.dtype:
    """The dtype that metadata name: text, or a list of fields."""
    return np.dtype(dtype) if isinstance(dtype, str) else np.dtype([tuple(tuple(x) if isinstance(x, list) else x for x in f) for f in dtype])


def encode_chunk(a: np.ndarray, meta: dict) -> bytes:
    """The bytes of one chunk by its array's metadata."""
    raw = np.ascontiguousarray(a, numpy_dtype(meta["dtype"])).tobytes(order=meta.get("order", "C"))
    for codec in [*(meta.get("filters") or []), *([meta["compressor"]] if meta.get("compressor") else [])]:
        if codec["id"] not in PACK:
            raise ValueError(f"{codec['id']} can't be encoded")
        raw = PACK[codec["id"]](raw, **{k: v for k, v in codec.items() if k != "id"})
    return raw


def _ascii_rows(raw: bytes, meta: dict, f: dict) -> np.ndarray:
    cols = ascii_table(raw, int(meta["dtype"][2:]), [tuple(c) for c in f["columns"]])
    out = np.zeros(len(next(iter(cols.values()), ())), [(n, d) for n, d, _ in f["columns"]])
    for n, v in cols.items():
        out[n] = v
    return out


def _heap_rows(raw: bytes, meta: dict, f: dict) -> np.ndarray:
    """Records whose fields of variable length hold arrays."""
    stored = numpy_dtype(meta["dtype"])
    n = meta["chunks"][0]
    rows = np.frombuffer(raw, stored, n)
    letters = f.get("letters") or {}
    out = np.empty(n, [(name, object if name in letters else stored[name]) for name in stored.names])
    for name in stored.names:
        if name in letters:
            wide = stored[name].base.itemsize == 8
            out[name] = heap_arrays(raw, n, stored.itemsize, stored.fields[name][1], letters[name], f["start"], wide)
        else:
            out[name] = rows[name]
    return out


def _physical(a: np.ndarray, scale: float, zero: float, field: str | None = None) -> np.ndarray:
    """Stored values to physical ones, raw * scale + zero: of an array, or of one field of its records."""
    if field is None:
        return a * scale + zero
    out = np.empty(a.shape, [(n, np.float64 if n == field else a.dtype[n]) for n in a.dtype.names])
    for n in a.dtype.names:
        out[n] = a[n] * scale + zero if n == field else a[n]
    return out


def decode_chunk(raw: bytes, meta: dict) -> np.ndarray:
    """Values of one whole chunk by its array's metadata."""
    filters = list(reversed(meta.get("filters") or []))
    for codec in [c for c in [meta.get("compressor")] if c] + [f for f in filters if f["id"] in BYTES]:
        if codec["id"] not in BYTES:
            raise ValueError(f"unknown codec {codec['id']}")
        raw = BYTES[codec["id"]](raw, **{k: v for k, v in codec.items() if k != "id"})
    shape, order = meta["chunks"], meta.get("order", "C")
    a: np.ndarray | None = None
    for f in filters:
        if f["id"] in BYTES:
            continue
        if f["id"] == "grib":
            from chunkloom.sources.grib2 import decoded

            a = decoded(raw, f["var"], f.get("field", 0)).astype(f.get("dtype") or meta["dtype"])
        elif f["id"] == "ascii_table":
            a = _ascii_rows(raw, meta, f)
        elif f["id"] == "heap":
            a = _heap_rows(raw, meta, f)
        elif f["id"] == "vlen_labels":
            a = np.array(fill_strings(raw, f.get("labels")), object)
        elif f["id"] == "record_member":
            a = record_member(raw, f["dtype"], f["member"])
        elif f["id"] == "delta_rows":
            a = np.frombuffer(raw, numpy_dtype(meta["dtype"]))
            a = np.cumsum(a[: int(np.prod(shape))].reshape(shape), axis=1, dtype=a.dtype)
        elif f["id"] == "physical":
            a = _physical(np.frombuffer(raw, numpy_dtype(meta["dtype"])) if a is None else a, f["scale"], f["zero"], f.get("field"))
        else:
            raise ValueError(f"unknown codec {f['id']}")
    if a is None:
        a = np.frombuffer(raw, numpy_dtype(meta["dtype"]))
    return a.reshape(-1)[: int(np.prod(shape))].reshape(shape, order=order)


def trimmed(a: np.ndarray, meta: dict, index) -> np.ndarray:
    """A chunk less its cells outside the array."""
    if not meta["shape"]:
        return a
    return a[tuple(slice(0, max(0, s - i * c)) for s, i, c in zip(meta["shape"], index, meta["chunks"], strict=True))]


def _long(chunks: DataFrame, kinds: str, schema: str, value: Callable) -> DataFrame:
    """(var, position, value) of the cells whose dtype is of one of the kinds; fields of records are var/field."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for var, text, index, raw in zip(b["var"], b["meta"], b["index"], b["raw"], strict=True):
                meta = json.loads(text)
                whole = decode_chunk(bytes(raw), meta)
                first = np.array(index) * np.array(meta["chunks"]) if meta["shape"] else np.zeros(0, np.int64)
                whole = trimmed(whole, meta, index) if meta["shape"] else whole.reshape(-1)[:1].reshape(())
                for name in whole.dtype.names or (None,):
                    a = whole if name is None else whole[name]
                    if a.dtype.kind not in kinds:
                        continue
                    at = np.indices(a.shape).reshape(a.ndim, -1).T
                    at[:, : len(first)] += first.astype(np.int64)
                    v, ok = value(a.reshape(-1), meta.get("fill_value") if name is None else None)
                    if not ok.any():
                        continue
                    yield pd.DataFrame({"var": var if name is None else f"{var}/{name}", "position": list(at[ok]), "value": v[ok]})

    return chunks.select("var", "meta", "index", "raw").mapInPandas(run, schema)


def cells(chunks: DataFrame) -> DataFrame:
    """(var, position array, value) of numeric arrays from chunks(var, meta json, index, raw).

    Cells outside the array, in chunks that reach over its edge, and cells equal to the fill
    value go. A missing chunk is all fill values, so it has no cells either. Numeric fields of
    records are variables of their own, ``var/field``; text is left to ``texts``.
    """

    def value(a: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
        v = a.astype(float)
        return v, ~np.isnan(v) if fill in (None, "NaN") else (v != float(fill)) & ~np.isnan(v)

    return _long(chunks, "biuf", "var string, position array<bigint>, value double", value)


def texts(chunks: DataFrame) -> DataFrame:
    """(var, position array, value) of arrays of text, without trailing NULs; null and empty cells go."""

    def value(a: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
        v = np.array([x.decode("utf-8", "replace").rstrip("\0") if isinstance(x, bytes) else x if isinstance(x, str) else None for x in a.tolist()], object)
        return v, np.array([x is not None and x != "" for x in v], bool)

    return _long(chunks, "SUO", "var string, position array<bigint>, value string", value)


def records(chunks: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row for each record of arrays of records from chunks(var, meta json, index, raw): ``var``, and its numeric or boolean fields.

    fields: the fields' names and Spark types. Records outside the array go; all others stay, with
    whatever they hold. A chunk is a batch of rows, and no row is handled by itself.
    """
    to = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    schema = pa.schema([("var", pa.string()), *((n, to[t]) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas: dict[str, dict] = {}
        for b in batches:
            for var, text, index, raw in zip(*(b.column(c).to_pylist() for c in ("var", "meta", "index", "raw")), strict=True):
                meta = metas.get(text) or metas.setdefault(text, json.loads(text))
                a = trimmed(decode_chunk(raw, meta), meta, index).reshape(-1)
                columns = [pa.array(a[n].astype(a.dtype[n].newbyteorder("="))).cast(to[t]) for n, t in fields.items()]
                yield pa.RecordBatch.from_arrays([pa.repeat(var, len(a)), *columns], schema=schema)

    return chunks.select("var", "meta", "index", "raw").mapInArrow(run, ", ".join(["var string", *(f"`{n}` {t}" for n, t in fields.items())]))
