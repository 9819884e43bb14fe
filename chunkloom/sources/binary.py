"""Parsers of binary formats: bytes of a file to (key, value) pairs.

A value is inline bytes, or (offset, size) in the file. Metadata follow version 2 of the array
store: ``.zgroup``, ``.zattrs``, ``.zarray``. Standard library and numpy only.
"""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from math import prod

Pair = tuple[str, bytes | tuple[int, int]]


def _unpack(fmt: str, data, at: int) -> tuple:
    """struct.unpack_from for anything that can be sliced."""
    return struct.unpack(fmt, data[at : at + struct.calcsize(fmt)])


def _json(x) -> bytes:
    return json.dumps(x, separators=(",", ":"), sort_keys=True).encode()


def _array(name: str, shape: list[int], chunks: list[int], dtype, dims: list[str] | None, attrs: dict | None = None, fill=None, compressor=None, filters=None) -> list[Pair]:
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "fill_value": fill, "order": "C", "compressor": compressor, "filters": filters}
    a = dict(attrs or {})
    if dims is not None:
        a["_ARRAY_DIMENSIONS"] = dims
    at = f"{name}/" if name else ""
    return [(f"{at}.zarray", _json(meta)), (f"{at}.zattrs", _json(a))]


def _group(path: str = "", attrs: dict | None = None) -> list[Pair]:
    at = f"{path}/" if path else ""
    return [(f"{at}.zgroup", _json({"zarr_format": 2})), (f"{at}.zattrs", _json(attrs or {}))]


# --- NetCDF classic ---------------------------------------------------------------------------

#: External type numbers of the format, with their dtype and size. Fixed values.
NC_TYPES = {1: ("|i1", 1), 2: ("|S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8), 7: ("|u1", 1), 8: (">u2", 2), 9: (">u4", 4), 10: (">i8", 8), 11: (">u8", 8)}


def netcdf3(data: bytes) -> Iterator[Pair]:
    """Classic, 64-bit offset and 64-bit data files.

    A fixed variable is one chunk, a record variable one chunk a record. Records of byte, char
    and short variables are padded to four bytes, but not if there is one record variable only.
    """
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a NetCDF classic file")
    version = data[3]
    pos = 4

    def number(fmt: str) -> int:
        nonlocal pos
        (x,) = _unpack(">" + fmt, data, pos)
        pos += struct.calcsize(fmt)
        return x

    count = lambda: number("q" if version == 5 else "i")
    address = lambda: number("i" if version == 1 else "q")

    def text() -> str:
        nonlocal pos
        n = count()
        s = data[pos : pos + n].decode("utf-8", "replace")
        pos += n + (-n) % 4
        return s

    def attributes() -> dict:
        nonlocal pos
        tag, n = number("i"), count()
        out = {}
        for _ in range(n if tag else 0):
            name, kind, k = text(), number("i"), count()
            dtype, size = NC_TYPES[kind]
            raw = data[pos : pos + k * size]
            pos += k * size + (-k * size) % 4
            if kind == 2:
                out[name] = raw.rstrip(b"\0").decode("utf-8", "replace")
            else:
                v = list(struct.unpack(">" + str(k) + {1: "b", 3: "h", 4: "i", 5: "f", 6: "d", 7: "B", 8: "H", 9: "I", 10: "q", 11: "Q"}[kind], raw))
                out[name] = v[0] if k == 1 else v
        return out

    records = number("q" if version == 5 else "i")
    tag, n = number("i"), count()
    dims = [(text(), count()) for _ in range(n if tag else 0)]
    attrs = attributes()
    tag, n = number("i"), count()
    variables = []
    for _ in range(n if tag else 0):
        name, rank = text(), count()
        ids = [count() for _ in range(rank)]
        va, kind = attributes(), number("i")
        count()  # the stored size overflows for large variables; it is worked out below
        variables.append((name, ids, va, kind, address()))
    rec = [v for v in variables if v[1] and dims[v[1][0]][1] == 0]
    one = lambda v: prod(dims[i][1] for i in v[1][1:]) * NC_TYPES[v[3]][1]
    step = one(rec[0]) if len(rec) == 1 else sum(one(v) + (-one(v)) % 4 for v in rec)
    if records < 0:
        records = max(0, (len(data) - min(v[4] for v in rec)) // step) if rec and step else 0
    yield from _group("", attrs)
    for v in variables:
        name, ids, va, kind, begin = v
        dtype, size = NC_TYPES[kind]
        names = [dims[i][0] for i in ids]
        fill = va.pop("missing_value", None) if "missing_value" in va else va.get("_FillValue")
        va.pop("_FillValue", None)
        if isinstance(fill, list):
            fill = fill[0] if fill else None
        if fill is not None and kind != 2:
            fill = float(fill) if kind in (5, 6) else int(fill)
            fill = "NaN" if fill != fill else fill
        if v in rec:
            shape = [records] + [dims[i][1] for i in ids[1:]]
            yield from _array(name, shape, [1] + shape[1:], dtype, names, va, fill)
            tail = ".0" * (len(ids) - 1)
            for k in range(records):
                yield f"{name}/{k}{tail}", (begin + k * step, one(v))
        else:
            shape = [dims[i][1] for i in ids]
            yield from _array(name, shape, shape, dtype, names, va, fill)
            yield f"{name}/" + (".".join("0" * len(shape)) or "0"), (begin, prod(shape) * size)


# --- FITS -------------------------------------------------------------------------------------

#: BITPIX numbers of the format with their dtype. Fixed values.
FITS_BITPIX = {8: "|u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Column letters of binary tables with dtype and size. Fixed values.
FITS_COLUMNS = {"L": ("|S1", 1), "B": ("|u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "A": ("|S", 1), "E": (">f4", 4), "D": (">f8", 8), "C": (">c8", 8), "M": (">c16", 16), "P": (">i4", 8), "Q": (">i8", 16)}


def _cards(data: bytes, at: int) -> tuple[dict, int]:
    """Header values and the place after the header."""
    head: dict = {}
    while at + 80 <= len(data):
        card = data[at : at + 80].decode("ascii", "replace")
        at += 80
        key, body = card[:8].strip(), card[10:]
        if key == "END":
            return head, at + (-at) % 2880
        if card[8:10] != "= ":
            continue
        if body.lstrip().startswith("'"):
            s, i = "", body.index("'") + 1
            while i < len(body):
                if body[i] == "'":
                    if body[i + 1 : i + 2] != "'":
                        break
                    i += 1
                s += body[i]
                i += 1
            head[key] = s.rstrip()
        else:
            v = body.split("/")[0].strip()
            try:
                head[key] = True if v == "T" else False if v == "F" else int(v) if v.lstrip("+-").isdigit() else float(v.replace("D", "E"))
            except ValueError:
                head[key] = v
    raise ValueError("a FITS header without END")


def fits_units(data: bytes) -> Iterator[tuple[int, dict, int, int]]:
    """(number, header, first byte of the data, bytes) of each header and data unit."""
    at = n = 0
    while at < len(data) and data[at : at + 80].strip(b" \0"):
        head, start = _cards(data, at)
        axes = [head.get(f"NAXIS{i}", 0) for i in range(1, head.get("NAXIS", 0) + 1)]
        size = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1) * (head.get("PCOUNT", 0) + prod(axes)) if axes else 0
        yield n, head, start, size
        at = start + size + (-size) % 2880
        n += 1


def fits(data: bytes, extension: int | str | list | None = None) -> Iterator[Pair]:
    """Images and tables; without ``extension`` the first unit with data."""
    units = list(fits_units(data))
    if extension is None:
        picked = [u for u in units if u[1].get("NAXIS", 0) > 0 and u[3]][:1]
    else:
        wanted = extension if isinstance(extension, list) else [extension]
        picked = [u for u in units if u[0] in wanted or u[1].get("EXTNAME") in wanted]
    if not picked:
        raise ValueError("No data HDU found")
    yield from _group("", {k: v for k, v in units[0][1].items() if isinstance(v, (str, int, float, bool))})
    for n, h, start, _ in picked:
        name = h.get("EXTNAME") or ("PRIMARY" if n == 0 else str(n))
        attrs = {k: v for k, v in h.items() if isinstance(v, (str, int, float, bool))}
        axes = [h[f"NAXIS{i}"] for i in range(h["NAXIS"], 0, -1)]
        if h.get("XTENSION") in ("BINTABLE", "TABLE"):
            rows, width = h["NAXIS2"], h["NAXIS1"]
            fields: list = []
            for i in range(1, h["TFIELDS"] + 1):
                form, label = str(h[f"TFORM{i}"]), h.get(f"TTYPE{i}", f"col{i}")
                if h["XTENSION"] == "TABLE":
                    fields.append([label, "|S" + form[1:].split(".")[0], h[f"TBCOL{i}"] - 1])
                    continue
                repeat = int("".join(c for c in form[: next(k for k, c in enumerate(form) if c.isalpha())]) or 1)
                letter = form.lstrip("0123456789")[0]
                dtype, _size = FITS_COLUMNS[letter]
                fields.append([label, f"|S{repeat}"] if letter == "A" else [label, dtype, [2]] if letter in "PQ" else [label, dtype] if repeat == 1 else [label, dtype, [repeat]])
            if h["XTENSION"] == "TABLE":
                filters = [{"id": "ascii_table", "columns": fields}]
                yield from _array(name, [rows], [rows], f"|V{width}", ["x"], attrs, filters=filters)
            else:
                forms = [(h.get(f"TTYPE{i}", f"col{i}"), str(h[f"TFORM{i}"]).lstrip("0123456789")) for i in range(1, h["TFIELDS"] + 1)]
                letters = {label: form[1] for label, form in forms if form[0] in "PQ"}
                yield from _array(name, [rows], [rows], fields, ["x"], attrs, filters=[{"id": "heap", "start": h.get("THEAP", rows * width), "letters": letters}] if letters else None)
            yield f"{name}/0", (start, rows * width + h.get("PCOUNT", 0))
            continue
        filters = [{"id": "physical", "scale": h.get("BSCALE", 1.0), "zero": h.get("BZERO", 0.0)}] if "BSCALE" in h or "BZERO" in h else None
        dims = ["z", "y", "x"][-len(axes) :] if len(axes) < 4 else [f"d{i}" for i in range(len(axes))]
        yield from _array(name, axes, axes, FITS_BITPIX[h["BITPIX"]], dims, attrs, filters=filters)
        yield f"{name}/" + ".".join("0" * len(axes)), (start, prod(axes) * abs(h["BITPIX"]) // 8)


# --- TIFF -------------------------------------------------------------------------------------

#: Field types of the format with struct letters. Fixed values.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tiff_directories(data: bytes) -> list[dict[int, tuple]]:
    """Tags of each directory, sub-directories included."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None:
        raise ValueError("not a TIFF file")
    big = _unpack(end + "H", data, 2)[0] == 43
    word, size = ("Q", 8) if big else ("I", 4)
    out, todo = [], [_unpack(end + word, data, 8 if big else 4)[0]]
    seen = set()
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        n = _unpack(end + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind, count = _unpack(end + "HH" + word, data, at)
            letters = TIFF_TYPES.get(kind, "B")
            total = struct.calcsize("=" + letters) * count
            where = at + 4 + size if total <= size else _unpack(end + word, data, at + 4 + size)[0]
            if letters == "s":
                tags[tag] = (data[where : where + count],)
            else:
                v = _unpack(end + letters * count, data, where)
                tags[tag] = tuple(v[i] / v[i + 1] if v[i + 1] else 0.0 for i in range(0, len(v), 2)) if len(letters) == 2 else v
            at += 12 if not big else 20
        out.append(tags)
        todo += [_unpack(end + word, data, at)[0], *tags.get(330, ())]
    return out


#: Compression numbers that can be named as a codec. Fixed values.
TIFF_CODECS = {1: None, 8: {"id": "zlib"}, 32946: {"id": "zlib"}, 50000: {"id": "zstd"}, 5: {"id": "lzw"}, 32773: {"id": "packbits"}}


def tiff(data: bytes) -> Iterator[Pair]:
    """Strips or tiles as chunks; several directories as groups 0, 1, 2 (a pyramid)."""
    pages = [p for p in tiff_directories(data) if 256 in p]
    end = "<" if data[:2] == b"II" else ">"
    attrs = {}
    for tag, name in ((33550, "ModelPixelScale"), (33922, "ModelTiepoint"), (34735, "GeoKeyDirectory"), (34264, "ModelTransformation")):
        if pages and tag in pages[0]:
            attrs[name] = list(pages[0][tag])
    if len(pages) > 1:
        attrs["multiscales"] = [{"datasets": [{"path": str(i)} for i in range(len(pages))]}]
    many = len(pages) > 1
    if many:
        yield from _group("", attrs)
    for i, p in enumerate(pages):
        w, h = p[256][0], p[257][0]
        bits, samples = p.get(258, (1,))[0], p.get(277, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}.get(p.get(339, (1,))[0], "u")
        dtype = f"{end if bits > 8 else '|'}{kind}{max(1, bits // 8)}"
        tiled = 322 in p
        cw, ch = (p[322][0], p[323][0]) if tiled else (w, min(h, p.get(278, (h,))[0]))
        offsets, sizes = (p[324], p[325]) if tiled else (p[273], p[279])
        shape, chunks, dims = [h, w], [ch, cw], ["Y", "X"]
        planes = p.get(284, (1,))[0] == 2 and samples > 1
        if planes:  # one chunk a plane and strip or tile
            shape, chunks, dims = [samples, *shape], [1, *chunks], ["S", *dims]
        elif samples > 1:
            shape, chunks, dims = shape + [samples], chunks + [samples], dims + ["S"]
        codec = TIFF_CODECS.get(p.get(259, (1,))[0], {"id": f"tiff_{p.get(259, (1,))[0]}"})
        predictor = p.get(317, (1,))[0]
        if predictor not in (1, 2) or (predictor == 2 and planes):
            raise ValueError(f"predictor {predictor} is not supported")
        filters = [{"id": "delta_rows"}] if predictor == 2 else None
        name = str(i) if many else ""
        yield from _array(name, shape, chunks, dtype, dims, attrs if not many else None, 0, codec, filters)
        across, down = -(-w // cw), -(-h // ch)
        for k, (o, s) in enumerate(zip(offsets, sizes, strict=True)):
            plane, k = divmod(k, across * down) if planes else (None, k)
            if s:
                yield (f"{name}/" if name else "") + (f"{plane}." if planes else "") + f"{k // across}.{k % across}" + (".0" if samples > 1 and not planes else ""), (o, s)


# --- GRIB -------------------------------------------------------------------------------------


def grib_messages(data: bytes, skip: int = 0) -> Iterator[tuple[int, int, int, int | None, str | None]]:
    """(offset, size, edition, discipline, reference time) of each message; at most ``skip`` of them if positive."""
    at = n = 0
    while True:
        at = data.find(b"GRIB", at)
        if at < 0 or at + 16 > len(data):
            return
        edition = data[at + 7]
        size = int.from_bytes(data[at + 8 : at + 16], "big") if edition == 2 else int.from_bytes(data[at + 4 : at + 7], "big")
        if size < 12 or at + size > len(data):
            at += 4
            continue
        time = None
        if edition == 2 and size >= 37:
            y, mo, d, h, mi, s = _unpack(">HBBBBB", data, at + 16 + 12)
            time = f"{y:04d}-{mo:02d}-{d:02d} {h:02d}:{mi:02d}:{s:02d}"
        yield at, size, edition, data[at + 6] if edition == 2 else None, time
        at += size
        n += 1
        if skip and n >= skip:
            return


# --- archives ---------------------------------------------------------------------------------


def archive_members(data: bytes, name: str) -> Iterator[tuple[str, int, int, int]]:
    """(member, offset of its bytes, stored size, method) of a zip or tar file, by its real local headers."""
    if name.endswith(".tar"):
        with tarfile.open(fileobj=io.BytesIO(data[:])) as t:
            for m in t.getmembers():
                if m.isfile():
                    yield m.name, m.offset_data, m.size, 0
        return
    with zipfile.ZipFile(io.BytesIO(data[:])) as z:
        for i in z.infolist():
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"unsupported compression of {i.filename}")
            n, x = _unpack("<HH", data, i.header_offset + 26)
            yield i.filename, i.header_offset + 30 + n + x, i.compress_size, i.compress_type
