"""A parser of HDF4 files after the published format: data descriptors, groups, tables and chunked data.

Groups become groups, scientific data sets arrays; contiguous and linked-block data, and chunked
data with or without deflate, give chunk references. Tables of one field named ``VALUES`` are
attributes; those of the archive's core, archive and structure metadata are read line by line.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from chunkloom.sources.binary import Pair, _array, _group

#: Tag numbers of the format. Fixed values.
TAGS = {1: "NULL", 20: "LINKED", 30: "VERSION", 40: "COMPRESSED", 61: "CHUNK", 106: "NT", 701: "SDD", 702: "SD", 720: "NDG", 1962: "VH", 1963: "VS", 1965: "VG"}
#: Codes of extended elements. Fixed values.
SPECIAL = {1: "LINKED", 2: "EXTERNAL", 3: "COMP", 5: "CHUNKED"}
#: Number types of the format with their dtype. Fixed values.
DTYPES = {3: "|u1", 4: "|S1", 5: ">f4", 6: ">f8", 20: "|i1", 21: "|u1", 22: ">i2", 23: ">u2", 24: ">i4", 25: ">u4"}
#: Number of the deflate coder. Fixed value.
DEFLATE = 4
#: Names of attributes that hold metadata as lines of text. Fixed values.
LINED = ("CoreMetadata.", "ArchiveMetadata.", "StructMetadata.")

Ref = tuple[str | int, int]


class Unsupported(RuntimeError):
    """A feature of the format that this parser doesn't read."""


def descriptors(data) -> Iterator[tuple[int, int, int, int, bool]]:
    """(tag, ref, offset, length, extended) by walking the linked blocks of data descriptors."""
    if data[:4] != b"\x0e\x03\x13\x01":
        raise ValueError("not an HDF4 file")
    at, seen = 4, set()
    while at and at not in seen:
        seen.add(at)
        n, nxt = struct.unpack(">HI", data[at : at + 6])
        for k in range(n):
            tag, ref, off, length = struct.unpack(">HHii", data[at + 6 + 12 * k : at + 18 + 12 * k])
            if tag != 1:  # an empty one
                yield tag & ~0x4000, ref, off, length, bool(tag & 0x4000)
        at = nxt


class File:
    def __init__(self, data):
        self.data = data
        self.elements: dict[Ref, tuple[int, int, bool]] = {}
        for tag, ref, off, length, extended in descriptors(data):
            self.elements[TAGS.get(tag, tag), ref] = (off, length, extended)

    def numbers(self, fmt: str, at: int) -> tuple:
        return struct.unpack(">" + fmt, self.data[at : at + struct.calcsize(">" + fmt)])

    def text(self, at: int) -> tuple[str, int]:
        """(a counted string up to its first NUL, place after it)."""
        (n,) = self.numbers("H", at)
        return bytes(self.data[at + 2 : at + 2 + n]).split(b"\0", 1)[0].decode("utf-8", "replace"), at + 2 + n

    def of(self, tag: str) -> list[int]:
        return sorted(r for t, r in self.elements if t == tag)

    def group(self, ref: int) -> tuple[str, str, list[Ref]]:
        """(name, class, members) of a group."""
        at = self.elements["VG", ref][0]
        (n,) = self.numbers("H", at)
        tags, refs = self.numbers(f"{n}H", at + 2), self.numbers(f"{n}H", at + 2 + 2 * n)
        name, at = self.text(at + 2 + 4 * n)
        return name, self.text(at)[0], [(TAGS.get(t, t), r) for t, r in zip(tags, refs, strict=True)]

    def table(self, ref: int) -> dict:
        """Header of a table: rows, fields, name, class."""
        at = self.elements["VH", ref][0]
        _, rows, width, n = self.numbers("HIHH", at)
        at += 10
        types, sizes, offsets, orders = (self.numbers(f"{n}H", at + 2 * n * k) for k in range(4))
        at += 8 * n
        names = []
        for _ in range(n):
            name, at = self.text(at)
            names.append(name)
        name, at = self.text(at)
        return {"rows": rows, "width": width, "types": types, "sizes": sizes, "offsets": offsets, "orders": orders, "names": names, "name": name, "class": self.text(at)[0]}

    def linked(self, at: int) -> bytes:
        """Bytes of an element in linked blocks, from behind its special code."""
        length, _, _, ref = self.numbers("IIIH", at)
        parts = []
        while ref:
            off, size, _ = self.elements["LINKED", ref]
            ref, *blocks = self.numbers(f"{size // 2}H", off)
            for b in blocks:
                if b:
                    o, n, _ = self.elements["LINKED", b]
                    parts.append(bytes(self.data[o : o + n]))
        return b"".join(parts)[:length]

    def content(self, tag: str, ref: int) -> bytes:
        """The bytes of an element, whether plain or in linked blocks."""
        off, length, extended = self.elements[tag, ref]
        if not extended:
            return bytes(self.data[off : off + length])
        if SPECIAL.get(self.numbers("H", off)[0]) != "LINKED":
            raise Unsupported("an extended element that is not in linked blocks")
        return self.linked(off + 2)

    def compressed(self, at: int) -> tuple[int, int, dict]:
        """(offset, bytes, codec) of a compressed element, from behind its special code."""
        _, _, ref, _, coder = self.numbers("HIHHH", at)
        if coder != DEFLATE:
            raise Unsupported(f"coder {coder}")
        off, size, _ = self.elements["COMPRESSED", ref]
        return off, size, {"id": "zlib"}

    def chunked(self, at: int) -> tuple[list[int], list[tuple[str, int, int]], dict | None]:
        """(chunk shape, [(key, offset, bytes)], codec) of a chunked element, from behind its special code."""
        _, ref = self.numbers("HH", at + 21)
        (rank,) = self.numbers("I", at + 29)
        sizes = [self.numbers("III", at + 33 + 12 * k)[2] for k in range(rank)]
        rows = self.table(ref)["rows"]
        raw = self.content("VS", ref)
        table = np.frombuffer(raw, [("at", ">u4", (rank,)), ("tag", ">u2"), ("ref", ">u2")], rows)
        out, codec = [], None
        for origin, _, chunk in table:
            off, size, extended = self.elements["CHUNK", int(chunk)]
            if extended:
                if SPECIAL.get(self.numbers("H", off)[0]) != "COMP":
                    raise Unsupported("a chunk that is neither plain nor compressed")
                off, size, codec = self.compressed(off + 2)
            out.append((".".join(str(int(x)) for x in origin), off, size))
        return sizes, out, codec

    def array(self, path: str, members: list[Ref], attrs: dict) -> Iterator[Pair]:
        """Metadata and chunks of a scientific data set."""
        shape, dtype = None, None
        for t, r in members:
            if t == "SDD":
                at = self.elements[t, r][0]
                (rank,) = self.numbers("H", at)
                shape = list(self.numbers(f"{rank}I", at + 2))
                number_type = self.numbers("HH", at + 2 + 4 * rank)
                dtype = dtype or self.number_type(number_type[1])
            elif t == "NT":
                dtype = self.number_type(r)
        if shape is None or dtype is None:
            return
        dims = [f"{path.rsplit('/', 1)[-1]}_{'xyzuvw'[k] if k < 6 else k}" for k in range(len(shape))]
        chunks, rows, codec, inline = shape, [], None, None
        zero = ".".join("0" * len(shape)) or "0"
        for t, r in members:
            if t != "SD" or (t, r) not in self.elements:
                continue
            off, size, extended = self.elements[t, r]
            if not extended:
                rows = [(zero, off, size)]
                continue
            kind = SPECIAL.get(self.numbers("H", off)[0])
            if kind == "CHUNKED":
                chunks, rows, codec = self.chunked(off + 2)
            elif kind == "COMP":
                o, n, codec = self.compressed(off + 2)
                rows = [(zero, o, n)]
            elif kind == "LINKED":
                inline = self.linked(off + 2)
            else:
                raise Unsupported(f"special element {kind}")
        yield from _array(path, shape, chunks, dtype, dims, attrs, None, codec)
        if inline is not None:
            yield f"{path}/{zero}", inline
        for key, off, size in rows:
            yield f"{path}/{key}", (off, size)

    def number_type(self, ref: int) -> str:
        kind = self.data[self.elements["NT", ref][0] + 1]
        if kind not in DTYPES:
            raise Unsupported(f"number type {kind}")
        return DTYPES[kind]

    def value(self, ref: int) -> tuple[str, object] | None:
        """(name, value) of a table that stands for an attribute."""
        head = self.table(ref)
        if len(head["names"]) != 1 or head["names"][0].upper() != "VALUES" or ("VS", ref) not in self.elements:
            return None
        raw = self.content("VS", ref)
        dtype = DTYPES.get(head["types"][0])
        if dtype is None or dtype == "|S1":
            return head["name"], raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip('"')
        v = np.frombuffer(raw, dtype)
        return head["name"], v[0].item() if len(v) == 1 else v.tolist()


def lined_values(text: str) -> dict[str, str]:
    """The VALUE of each OBJECT in metadata written as lines ``NAME = content``."""
    out, name = {}, None
    for line in text.split("\n"):
        if "OBJECT" in line and "=" in line and "END_OBJECT" not in line:
            name = line.split("=", 1)[1].strip()
        elif "VALUE" in line and "=" in line and "NUM_VAL" not in line and name:
            out[name] = line.split("=", 1)[1].strip().strip('"')
    return out


def hdf4(data, error: str = "raise") -> Iterator[Pair]:
    """Groups, arrays and attributes; error='skip' leaves out arrays that can't be read."""
    f = File(data)
    groups = {r: f.group(r) for r in f.of("VG")}
    children = {r for _, _, members in groups.values() for t, r in members if t == "VG"}
    roots = [r for r in groups if r not in children]
    attrs: dict = {}
    for r in f.of("VH"):
        found = f.value(r)
        if found and found[0].startswith(LINED):
            attrs |= lined_values(str(found[1]))
    rows: list[Pair] = []

    def own_attrs(members: list[Ref]) -> dict:
        found = [f.value(r) for t, r in members if t == "VH" and (t, r) in f.elements]
        return {n: v for n, v in filter(None, found) if not n.startswith(LINED)}

    def walk(ref: int, path: str, seen: frozenset) -> None:
        _, _, members = groups[ref]
        kinds = {t for t, _ in members}
        mine = own_attrs(members)
        if "SDD" in kinds or "SD" in kinds:
            try:
                rows.extend(list(f.array(path, members, mine)))
            except Unsupported:
                if error == "raise":
                    raise
            return
        if path:
            rows.extend(_group(path, mine))
        else:
            attrs.update(mine)
        for t, r in members:
            if t == "VG" and r in groups and r not in seen:
                walk(r, f"{path}/{groups[r][0]}" if path else groups[r][0], seen | {r})

    # One root is usual; of several the last holds the data sets. Dimensions and other bookkeeping stay out.
    if roots:
        walk(roots[-1], "", frozenset({roots[-1]}))
    yield from _group("", attrs)
    yield from rows
