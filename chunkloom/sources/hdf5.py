"""A parser of HDF5 files after the published file format, for what scans need.

Superblocks 0 to 3; object headers 1 and 2; groups by symbol table, compact or dense links; compact
and dense attributes; contiguous, compact and chunked layouts with every chunk index (version 1 and
2 B-trees, single, implicit, fixed and extensible arrays, paged or not); fixed, float, string,
enum, array, compound and variable-length string types; filters that can be decoded. Anything
else raises ``Unsupported`` for its object, which error='skip' leaves out, one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from math import prod

import numpy as np

from chunkloom.functions.codecs import BYTES, encode_chunk
from chunkloom.operators.scanning import FILTERS, HIDDEN_ATTRS
from chunkloom.sources.binary import Pair, _array, _group

SIGNATURE = b"\x89HDF\r\n\x1a\n"


class Unsupported(RuntimeError):
    """A feature of the format that this parser doesn't read."""


class File:
    def __init__(self, data: bytes):
        self.data = data
        at = 0
        while data[at : at + 8] != SIGNATURE:
            at = 512 if not at else at * 2
            if at >= len(data):
                raise ValueError("not an HDF5 file")
        version = data[at + 8]
        if version < 2:
            self.o, self.l = data[at + 13], data[at + 14]
            p = at + 24 + (4 if version == 1 else 0)
            self.base = self.num(p, self.o)
            self.root = self.num(p + 5 * self.o, self.o)  # four addresses, then the root entry's name offset
        else:
            self.o, self.l = data[at + 9], data[at + 10]
            self.base = self.num(at + 12, self.o)
            self.root = self.num(at + 12 + 3 * self.o, self.o)
        self.none = (1 << 8 * self.o) - 1
        self.names: dict[int, str] = {}
        self.unlimited: int | None = None
        self.limits: list[int] = []
        self.heaps: dict[int, dict[int, bytes]] = {}

    def num(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], "little")

    def messages(self, addr: int) -> list[tuple[int, int, int]]:
        """(type, place, size) of an object header's messages."""
        d, at = self.data, addr + self.base
        out: list[tuple[int, int, int]] = []
        if d[at : at + 4] == b"OHDR":
            flags = d[at + 5]
            p = at + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            w = 1 << (flags & 3)
            todo = [(p + w, self.num(p, w))]
            head = 4 + (2 if flags & 4 else 0)
            while todo:
                p, size = todo.pop(0)
                end = p + size
                while p + head <= end:
                    kind, n = d[p], self.num(p + 1, 2)
                    p += head
                    if kind == 0x10:
                        where, length = self.num(p, self.o) + self.base, self.num(p + self.o, self.l)
                        todo.append((where + 4, length - 8))  # without signature and checksum
                    else:
                        out.append((kind, p, n))
                    p += n
            return out
        if d[at] != 1:
            raise Unsupported(f"object header version {d[at]}")
        left = self.num(at + 2, 2)
        todo = [(at + 16, self.num(at + 8, 4))]
        while todo:
            p, size = todo.pop(0)
            end = p + size
            while p + 8 <= end and left:
                kind, n = self.num(p, 2), self.num(p + 2, 2)
                p += 8
                left -= 1
                if kind == 0x10:
                    todo.append((self.num(p, self.o) + self.base, self.num(p + self.o, self.l)))
                else:
                    out.append((kind, p, n))
                p += n
        return out

    # --- groups ---------------------------------------------------------------------------

    def children(self, messages: list[tuple[int, int, int]]) -> Iterator[tuple[str, int]]:
        for kind, p, _ in messages:
            if kind == 0x11:
                yield from self._symbols(self.num(p, self.o), self.num(p + self.o, self.o))
            elif kind == 0x06:
                link = self._link(p)
                if link:
                    yield link
            elif kind == 0x02:
                q = p + 2 + (8 if self.data[p + 1] & 1 else 0)
                heap, names = self.num(q, self.o), self.num(q + self.o, self.o)
                if heap != self.none and names != self.none:
                    found = Heap(self, heap)
                    for record, _ in self.records(names):
                        link = self._link(found.place(record + 4)[0])
                        if link:
                            yield link

    def _link(self, p: int) -> tuple[str, int] | None:
        flags = self.data[p + 1]
        p += 2
        kind = 0
        if flags & 8:
            kind = self.data[p]
            p += 1
        p += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        w = 1 << (flags & 3)
        n = self.num(p, w)
        name = self.data[p + w : p + w + n].decode()
        return None if kind else (name, self.num(p + w + n, self.o))  # soft and external links are passed over

    def _symbols(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        text = self.num(heap + self.base + 8 + 2 * self.l, self.o) + self.base
        for node in self._leaves(tree, self.l):
            p = node + self.base
            if self.data[p : p + 4] != b"SNOD":
                raise ValueError("a broken symbol table")
            for k in range(self.num(p + 6, 2)):
                e = p + 8 + k * (2 * self.o + 24)
                at = text + self.num(e, self.o)
                if self.num(e + 2 * self.o, 4) != 2:  # not a soft link
                    yield self.data[at : self.data.index(b"\0", at)].decode(), self.num(e + self.o, self.o)

    def _leaves(self, tree: int, key: int) -> Iterator[int]:
        """Children of the lowest nodes of a B-tree whose keys have ``key`` bytes."""
        p = tree + self.base
        if self.data[p : p + 4] != b"TREE":
            raise ValueError("a broken B-tree")
        level, n = self.data[p + 5], self.num(p + 6, 2)
        p += 8 + 2 * self.o
        for k in range(n):
            child = self.num(p + key + k * (key + self.o), self.o)
            if level:
                yield from self._leaves(child, key)
            else:
                yield child

    # --- version 2 B-trees --------------------------------------------------------------------

    def records(self, tree: int) -> Iterator[tuple[int, int]]:
        """(place, size) of a version 2 B-tree's records, in order."""
        p = tree + self.base
        if self.data[p : p + 4] != b"BTHD":
            raise ValueError("a broken version 2 B-tree")
        node, size, depth = self.num(p + 6, 4), self.num(p + 10, 2), self.num(p + 12, 2)
        root, n = self.num(p + 16, self.o), self.num(p + 16 + self.o, 2)
        width = lambda x: max(1, (x.bit_length() + 7) // 8)
        # Records that a node of each level holds at most, and all below it; they set the widths of counts.
        most = [(node - 10) // size]
        total = [most[0]]
        pointer = [0]
        for level in range(1, depth + 1):
            pointer.append(self.o + width(most[0]) + (width(total[-1]) if level > 1 else 0))
            most.append((node - 10 - pointer[level]) // (size + pointer[level]))
            total.append((most[level] + 1) * total[-1] + most[level])

        def walk(addr: int, count: int, level: int) -> Iterator[tuple[int, int]]:
            q = addr + self.base
            if self.data[q : q + 4] != (b"BTIN" if level else b"BTLF"):
                raise ValueError("a broken version 2 B-tree")
            q += 6
            if not level:
                yield from ((q + k * size, size) for k in range(count))
                return
            e = q + count * size
            for k in range(count + 1):
                child, below = self.num(e, self.o), self.num(e + self.o, width(most[0]))
                e += pointer[level]
                yield from walk(child, below, level - 1)
                if k < count:
                    yield q + k * size, size

        if root != self.none and n:
            yield from walk(root, n, depth)

    # --- types and values -----------------------------------------------------------------

    def datatype(self, p: int) -> tuple[object, int, int]:
        """(dtype, element size, place after the message)."""
        d = self.data
        kind, version, bits, size = d[p] & 15, d[p] >> 4, self.num(p + 1, 3), self.num(p + 4, 4)
        end = ">" if bits & 1 else "<"
        p += 8
        if kind == 0:
            letter = "i" if bits & 8 else "u"
            return f"{end if size > 1 else '|'}{letter}{size}", size, p + 4
        if kind == 1:
            return f"{end}f{size}", size, p + 12
        if kind == 3:
            return f"|S{size}", size, p
        if kind == 4:
            return f"|V{size}", size, p + 4
        if kind == 6:
            fields = []
            n = bits & 0xFFFF
            for _ in range(n):
                e = d.index(b"\0", p)
                name = d[p:e].decode()
                p = e + 1 if version == 3 else p + (e - p) // 8 * 8 + 8
                w = 4 if version < 3 else next(b for b in (1, 2, 3, 4) if size < 1 << 8 * b)
                p += w
                dims: list[int] = []
                if version == 1:
                    dims = [self.num(p + 12 + 4 * k, 4) for k in range(d[p])]
                    p += 28
                t, _, p = self.datatype(p)
                fields.append([name, t, dims] if dims else [name, t])
            return fields, size, p
        if kind == 7:
            return f"|V{size}", size, p
        if kind == 8:
            t, n, q = self.datatype(p)
            for _ in range(bits & 0xFFFF):
                e = d.index(b"\0", q)
                q = e + 1 if version == 3 else q + (e - q) // 8 * 8 + 8
            return t, size, q + (bits & 0xFFFF) * n
        if kind == 9:
            _, _, p = self.datatype(p)
            return f"|S{size}", size, p  # references into a heap, left as they are
        if kind == 10:
            rank = d[p]
            p += 1 if version == 3 else 4
            dims = [self.num(p + 4 * k, 4) for k in range(rank)]
            p += 4 * rank * (1 if version == 3 else 2)
            t, _, p = self.datatype(p)
            return [t, dims], size, p
        raise Unsupported(f"type class {kind}")

    def dataspace(self, p: int) -> list[int]:
        version, rank, flags = self.data[p], self.data[p + 1], self.data[p + 2]
        p += 8 if version == 1 else 4
        shape = [self.num(p + k * self.l, self.l) for k in range(rank)]
        most = [self.num(p + (rank + k) * self.l, self.l) for k in range(rank)] if flags & 1 else shape
        endless = (1 << 8 * self.l) - 1
        # Chunks are numbered along the sizes that axes may grow to; an endless axis has the present one.
        self.unlimited = next((k for k, m in enumerate(most) if m == endless), None)
        self.limits = [n if m == endless else m for n, m in zip(shape, most, strict=True)]
        return shape

    def heap_object(self, addr: int, index: int) -> bytes:
        if addr not in self.heaps:
            p = addr + self.base
            end, q, found = p + self.num(p + 8, self.l), p + 8 + self.l, {}
            while q + 8 + self.l <= end:
                i, n = self.num(q, 2), self.num(q + 8, self.l)
                if not i:
                    break
                found[i] = self.data[q + 8 + self.l : q + 8 + self.l + n]
                q += 8 + self.l + n + (-n) % 8
            self.heaps[addr] = found
        return self.heaps[addr].get(index, b"")

    def attribute(self, p: int) -> tuple[str, object]:
        version = self.data[p]
        sizes = [self.num(p + 2 + 2 * k, 2) for k in range(3)]
        q = p + 8 + (1 if version == 3 else 0)
        step = lambda n: n + (-n) % 8 if version == 1 else n
        name = self.data[q : q + sizes[0]].rstrip(b"\0").decode()
        q += step(sizes[0])
        vlen = self.data[q] & 15 == 9
        dtype, size, _ = self.datatype(q)
        q += step(sizes[1])
        shape = self.dataspace(q)
        q += step(sizes[2])
        n = prod(shape)
        raw = self.data[q : q + n * size]
        if vlen:
            items = []
            for k in range(n):
                e = q + k * size
                items.append((self.num(e, 4), self.heap_object(self.num(e + 4, self.o), self.num(e + 4 + self.o, 4))))
            if name == "DIMENSION_LIST":
                return name, [[int.from_bytes(b[8 * i : 8 * i + self.o], "little") for i in range(c)] for c, b in items]
            values: list = [b[:c].decode("utf-8", "replace") for c, b in items]
        elif isinstance(dtype, str) and dtype[1] == "S":
            values = [raw[k * size : (k + 1) * size].split(b"\0")[0].decode("utf-8", "replace") for k in range(n)]
        elif isinstance(dtype, str) and dtype[1] in "iuf":
            letter = {"i": "bhiq", "u": "BHIQ", "f": " efd"}[dtype[1]][{1: 0, 2: 1, 4: 2, 8: 3}[size]]
            values = list(struct.unpack((">" if dtype[0] == ">" else "<") + letter * n, raw))
        else:
            return name, None
        return name, values[0] if len(values) == 1 else values

    def attributes(self, messages: list[tuple[int, int, int]]) -> dict:
        """All attributes of an object, wherever they are stored."""
        out = {}
        for kind, p, _ in messages:
            if kind == 0x0C:
                name, value = self.attribute(p)
                out[name] = value
            elif kind == 0x15:
                q = p + 2 + (2 if self.data[p + 1] & 1 else 0)
                heap, names = self.num(q, self.o), self.num(q + self.o, self.o)
                if heap != self.none and names != self.none:
                    found = Heap(self, heap)
                    for record, _ in self.records(names):
                        if self.data[record + 8] & 2:
                            raise Unsupported("a shared attribute")
                        name, value = self.attribute(found.place(record)[0])
                        out[name] = value
        return out

    def filters(self, p: int) -> list[tuple[int, list[int]]]:
        version, n = self.data[p], self.data[p + 1]
        p += 8 if version == 1 else 2
        out = []
        for _ in range(n):
            number = self.num(p, 2)
            named = version == 1 or number >= 256
            name = self.num(p + 2, 2) if named else 0
            p += 4 if named else 2
            count = self.num(p + 2, 2)
            p += 4 + (name + (-name) % 8 if version == 1 else name)
            out.append((number, [self.num(p + 4 * k, 4) for k in range(count)]))
            p += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    # --- datasets -------------------------------------------------------------------------

    def chunks(self, p: int, shape: list[int], filtered: bool) -> tuple[list[int], list[tuple[list[int], int, int, int]], bytes | None]:
        """(chunk shape, [(index, place, bytes, filter mask)], inline bytes) of a layout message."""
        d, version = self.data, self.data[p]
        if version in (1, 2):
            rank, kind, p = d[p + 1], d[p + 2], p + 8
            addr = self.num(p, self.o) if kind else 0
            p += self.o if kind else 0
            dims = [self.num(p + 4 * k, 4) for k in range(rank)]
            if kind == 2:
                return dims[:-1], self._tree(addr, dims), None
            if kind == 1:
                return shape, [([0] * len(shape), addr + self.base, -1, 0)] if addr != self.none else [], None
            n = self.num(p + 4 * rank, 4)
            return shape, [], bytes(d[p + 4 * rank + 4 : p + 4 * rank + 4 + n])
        kind = d[p + 1]
        if kind == 0:
            n = self.num(p + 2, 2)
            return shape, [], bytes(d[p + 4 : p + 4 + n])
        if kind == 1:
            addr, size = self.num(p + 2, self.o), self.num(p + 2 + self.o, self.l)
            return shape, [([0] * len(shape), addr + self.base, size, 0)] if addr != self.none and size else [], None
        if kind != 2:
            raise Unsupported("a virtual layout")
        if version == 3:
            rank, addr = d[p + 2], self.num(p + 3, self.o)
            dims = [self.num(p + 3 + self.o + 4 * k, 4) for k in range(rank)]
            return dims[:-1], self._tree(addr, dims) if addr != self.none else [], None
        flags, rank, w = d[p + 2], d[p + 3], d[p + 4]
        dims = [self.num(p + 5 + w * k, w) for k in range(rank)]
        p += 5 + w * rank
        index, p = d[p], p + 1
        whole = prod(dims)
        grid = [-(-s // c) for s, c in zip(self.limits, dims[:-1], strict=True)]
        place = lambda k: [k // prod(grid[i + 1 :]) % grid[i] for i in range(len(grid))]
        if index == 1:
            size, mask = whole, 0
            if flags & 2:
                size, mask, p = self.num(p, self.l), self.num(p + self.l, 4), p + self.l + 4
            addr = self.num(p, self.o)
            return dims[:-1], [([0] * len(shape), addr + self.base, size, mask)] if addr != self.none else [], None
        if index == 2:
            addr = self.num(p, self.o)
            return dims[:-1], [(place(k), addr + self.base + k * whole, whole, 0) for k in range(prod(grid))] if addr != self.none else [], None
        if index == 3:
            return dims[:-1], self._listed(self._fixed_array(self.num(p + 1, self.o)), place, whole, filtered), None
        if index == 4:
            return dims[:-1], self._listed(self._extensible_array(self.num(p + 5, self.o)), self._unlimited_place(grid), whole, filtered), None
        if index == 5:
            return dims[:-1], self._scaled(self.num(p + 6, self.o), len(shape), whole), None
        raise Unsupported(f"chunk index type {index}")

    def _unlimited_place(self, grid: list[int]):
        """The index of a chunk by its number where one axis may grow: that axis counts slowest."""
        grow = self.unlimited if self.unlimited is not None else 0
        others = [i for i in range(len(grid)) if i != grow]

        def place(k: int) -> list[int]:
            out = [0] * len(grid)
            for i in reversed(others):
                out[i] = k % grid[i]
                k //= grid[i]
            out[grow] = k
            return out

        return place

    def _listed(self, entries: Iterator[tuple[int, int, int]], place, whole: int, filtered: bool) -> list[tuple[list[int], int, int, int]]:
        """Chunks of an array of entries: (number, place, size) of each, an address or address, bytes and mask."""
        out = []
        for k, e, size in entries:
            a = self.num(e, self.o)
            if a != self.none:
                w = size - self.o - 4
                out.append((place(k), a + self.base, self.num(e + self.o, w) if filtered else whole, self.num(e + self.o + w, 4) if filtered else 0))
        return out

    def _pages(self, first: int, at: int, n: int, bits: int, size: int, mask: int | None) -> Iterator[tuple[int, int, int]]:
        """Entries in pages of 2**bits from ``at`` on; ``mask`` is the place of the bits of pages that are there."""
        per = 1 << bits
        for page in range(-(-n // per)):
            count = min(per, n - page * per)
            if mask is None or self.data[mask + page // 8] >> (7 - page % 8) & 1:
                yield from ((first + page * per + k, at + k * size, size) for k in range(count))
            at += per * size + 4

    def _fixed_array(self, addr: int) -> Iterator[tuple[int, int, int]]:
        if addr == self.none:
            return
        p = addr + self.base
        size, bits, n = self.data[p + 6], self.data[p + 7], self.num(p + 8, self.l)
        block = self.num(p + 8 + self.l, self.o)
        if block == self.none:
            return
        q = block + self.base + 6 + self.o
        if n <= 1 << bits:
            yield from ((k, q + k * size, size) for k in range(n))
            return
        masks = -(-(-(-n // (1 << bits))) // 8)
        yield from self._pages(0, q + masks + 4, n, bits, size, q)

    def _extensible_array(self, addr: int) -> Iterator[tuple[int, int, int]]:
        if addr == self.none:
            return
        p = addr + self.base
        if self.data[p : p + 4] != b"EAHD":
            raise ValueError("a broken extensible array")
        size, most_bits, own, least, pointers, page_bits = (self.data[p + 6 + k] for k in range(6))
        top = self.num(p + 12 + 4 * self.l, self.l)  # elements that are set
        index = self.num(p + 12 + 6 * self.l, self.o)
        if index == self.none:
            return
        offset = -(-most_bits // 8)
        log = lambda x: x.bit_length() - 1
        supers = 1 + most_bits - log(least)
        shapes = [(1 << (u // 2), (1 << ((u + 1) // 2)) * least) for u in range(supers)]  # data blocks, elements of each
        q = index + self.base + 6 + self.o
        yield from ((k, q + k * size, size) for k in range(min(own, top)))
        q += own * size
        number = own

        def data_block(a: int, first: int, n: int, mask: int | None) -> Iterator[tuple[int, int, int]]:
            if a == self.none:
                return
            e = a + self.base + 6 + self.o + offset
            if n > 1 << page_bits:
                yield from self._pages(first, e + 4, n, page_bits, size, mask)
            else:
                yield from ((first + k, e + k * size, size) for k in range(n))

        # The first blocks are named in the index block itself, the others in secondary blocks.
        direct = 2 * log(pointers)
        for u in range(min(direct, supers)):
            blocks, n = shapes[u]
            for _ in range(blocks):
                yield from data_block(self.num(q, self.o), number, n, None)
                q += self.o
                number += n
        for u in range(direct, supers):
            blocks, n = shapes[u]
            second = self.num(q, self.o)
            q += self.o
            if second != self.none and number < top:
                e = second + self.base + 6 + self.o + offset
                pages = -(-n // (1 << page_bits)) if n > 1 << page_bits else 0
                masks = -(-pages // 8)
                names = e + masks * blocks
                for k in range(blocks):
                    yield from data_block(self.num(names + k * self.o, self.o), number + k * n, n, e + k * masks if pages else None)
            number += blocks * n

    def _scaled(self, tree: int, rank: int, whole: int) -> list[tuple[list[int], int, int, int]]:
        """Chunks of a version 2 B-tree: an address, bytes and mask if they are filtered, and the index."""
        out = []
        if tree == self.none:
            return out
        filtered = self.data[tree + self.base + 5] == 11
        for r, size in self.records(tree):
            a, at, n, mask = self.num(r, self.o), r + self.o, whole, 0
            if filtered:
                w = size - self.o - 4 - 8 * rank
                n, mask = self.num(at, w), self.num(at + w, 4)
                at += w + 4
            if a != self.none:
                out.append(([self.num(at + 8 * i, 8) for i in range(rank)], a + self.base, n, mask))
        return out

    def _tree(self, addr: int, dims: list[int]) -> list[tuple[list[int], int, int, int]]:
        p, out = addr + self.base, []
        if self.data[p : p + 4] != b"TREE":
            raise ValueError("a broken B-tree")
        level, n = self.data[p + 5], self.num(p + 6, 2)
        p += 8 + 2 * self.o
        key = 8 + 8 * len(dims)
        for k in range(n):
            at = p + k * (key + self.o)
            child = self.num(at + key, self.o)
            if level:
                out += self._tree(child, dims)
            else:
                index = [self.num(at + 8 + 8 * i, 8) // dims[i] for i in range(len(dims) - 1)]
                out.append((index, child + self.base, self.num(at, 4), self.num(at + 4, 4)))
        return out


class Heap:
    """A fractal heap: objects by their ids, in direct blocks under a root or a table of blocks."""

    def __init__(self, f: File, addr: int):
        self.f, p = f, addr + f.base
        if f.data[p : p + 4] != b"FRHP":
            raise ValueError("a broken fractal heap")
        if f.num(p + 7, 2):
            raise Unsupported("a filtered fractal heap")
        largest = f.num(p + 10, 4)
        p += 14 + 10 * f.l + 2 * f.o  # behind the numbers of huge, free, managed and tiny objects
        self.width, self.start, self.direct = f.num(p, 2), f.num(p + 2, f.l), f.num(p + 2 + f.l, f.l)
        self.bits = f.num(p + 2 + 2 * f.l, 2)
        self.root, self.rows = f.num(p + 6 + 2 * f.l, f.o), f.num(p + 6 + 2 * f.l + f.o, 2)
        self.offset = -(-self.bits // 8)
        log = lambda x: x.bit_length() - 1
        self.length = min((log(self.direct) + 7) // 8, log(largest) // 8 + 1)
        self.blocks: list[tuple[int, int, int]] | None = None

    def place(self, at: int) -> tuple[int, int]:
        """(place, bytes) of the object whose id stands at ``at``."""
        f = self.f
        kind = f.data[at] >> 4 & 3
        if kind == 2:
            return at + 1, (f.data[at] & 15) + 1
        if kind:
            raise Unsupported("a huge object in a fractal heap")
        where, size = f.num(at + 1, self.offset), f.num(at + 1 + self.offset, self.length)
        if not self.rows:
            return self.root + f.base + where, size
        if self.blocks is None:
            self.blocks = sorted(self._table(self.root, self.rows, 0))
        for first, n, addr in self.blocks:
            if first <= where < first + n:
                return addr + f.base + where - first, size
        raise ValueError("an object outside its heap")

    def _size(self, row: int) -> int:
        return self.start << max(0, row - 1)

    def _table(self, addr: int, rows: int, first: int) -> Iterator[tuple[int, int, int]]:
        """(first, bytes, address) of the direct blocks under an indirect one."""
        f, q = self.f, addr + self.f.base
        if f.data[q : q + 4] != b"FHIB":
            raise ValueError("a broken fractal heap")
        q += 5 + f.o + self.offset
        for row in range(rows):
            size = self._size(row)
            for _ in range(self.width):
                child = f.num(q, f.o)
                q += f.o
                if child != f.none:
                    if size <= self.direct:
                        yield first, size, child
                    else:
                        yield from self._table(child, (size // self.start // self.width).bit_length(), first)
                first += size


def _codecs(filters: list[tuple[int, list[int]]], mask: int, size: int) -> tuple[dict | None, list[dict] | None, bool]:
    """(compressor, filters, checksum at the end) of a pipeline; a set bit of the mask skips a filter."""
    chain, checksum = [], False
    for k, (number, values) in enumerate(filters):
        if mask >> k & 1:
            continue
        name = FILTERS.get(number)
        if name is None:
            raise Unsupported(f"filter {number}")
        if name == "fletcher32":
            checksum = True
        elif name == "shuffle":
            chain.append({"id": "shuffle", "elementsize": values[0] if values else size})
        else:
            chain.append({"id": name})
    compressor = chain.pop() if chain and chain[-1]["id"] != "shuffle" else None
    return compressor, chain or None, checksum


def _recoded(raw: bytes, pipeline: list, mask: int, size: int, meta: dict) -> bytes:
    """A chunk that skips other filters than the first one, packed as the array's metadata say."""
    compressor, filters, checksum = _codecs(pipeline, mask, size)
    raw = raw[:-4] if checksum else raw
    for codec in [*([compressor] if compressor else []), *reversed(filters or [])]:
        raw = BYTES[codec["id"]](raw, **{k: v for k, v in codec.items() if k != "id"})
    try:
        return encode_chunk(np.frombuffer(raw, np.uint8), meta | {"dtype": "|u1"})
    except ValueError as e:
        raise Unsupported(f"chunks with different filters: {e}") from None


def _fill(f: File, messages: list, dtype) -> object:
    for kind, p, _ in messages:
        if kind != 5 or not isinstance(dtype, str) or dtype[1] not in "iuf":
            continue
        version = f.data[p]
        if version == 3:
            if not f.data[p + 1] & 0x20:
                return 0
            p += 2
        else:
            if version == 2 and not f.data[p + 3]:
                return 0
            p += 4
        n = f.num(p, 4)
        if not n:
            return 0
        letter = {"i": "bhiq", "u": "BHIQ", "f": " efd"}[dtype[1]][{1: 0, 2: 1, 4: 2, 8: 3}[n]]
        v = struct.unpack((">" if dtype[0] == ">" else "<") + letter, f.data[p + 4 : p + 4 + n])[0]
        return "NaN" if v != v else v
    return 0 if isinstance(dtype, str) and dtype[1] in "iuf" else None


#: What becomes of variable-length strings.
VLEN = ("embed", "encode", "null", "leave")


def _strings(f: File, raw: bytes, size: int) -> list[bytes]:
    """The strings that (length, heap, number) entries name."""
    out = []
    for k in range(0, len(raw) - size + 1, size):
        n, heap, number = (int.from_bytes(raw[a:b], "little") for a, b in ((k, k + 4), (k + 4, k + 4 + f.o), (k + 4 + f.o, k + 8 + f.o)))
        out.append(f.heap_object(heap, number)[:n] if n and heap not in (0, f.none) else b"")
    return out


def _string_rows(f: File, path: str, shape: list[int], dims: list[str], shown: dict, size: int, chunk: list[int], stored: list[tuple[str, bytes]], vlen: str) -> Iterator[Pair]:
    """An array of variable-length strings by one of the policies.

    embed: the strings themselves, inline, in cells of the longest one's width; encode: their ids, with
    the strings in the codec; null: nothing but fill values; leave: the ids, 16 bytes each.
    """
    if vlen == "null":
        yield from _array(path, shape, chunk, "|S1", dims, shown, "", None)
        return
    found = {key: _strings(f, raw, size) for key, raw in stored}
    if vlen == "embed":
        width = max([1, *(len(x) for v in found.values() for x in v)])
        yield from _array(path, shape, chunk, f"|S{width}", dims, shown, "", None)
        for key, v in found.items():
            yield key, b"".join(x.ljust(width, b"\0") for x in v)
        return
    labels = {raw[i : i + size].hex(): x.decode("utf-8", "replace") for key, raw in stored for i, x in zip(range(0, len(raw), size), found[key], strict=False)}
    yield from _array(path, shape, chunk, f"|S{size}", dims, shown, "", None, [{"id": "vlen_labels", "labels": labels}] if vlen == "encode" else None)
    yield from stored


def hdf5(data, error: str = "raise", vlen: str = "embed", preserve_linked: bool = False) -> Iterator[Pair]:
    """Groups and datasets.

    error='skip' leaves out objects that can't be read. vlen: a policy of ``_string_rows``.
    preserve_linked repeats a dataset under every name that it has; else the first one counts.
    """
    if vlen not in VLEN:
        raise ValueError(f"unknown policy {vlen}")
    f = File(data)
    found: list[tuple[str, int, list]] = []

    def walk(addr: int, path: str, above: frozenset) -> None:
        known = addr in f.names
        f.names.setdefault(addr, path)
        try:
            messages = f.messages(addr)
            if known and not (preserve_linked and any(k == 0x08 for k, _, _ in messages)):
                return
            found.append((path, addr, messages))
            links = list(f.children(messages))
        except Unsupported:
            if error == "raise":
                raise
            return
        for name, child in links:
            if child not in above:
                walk(child, f"{path}/{name}" if path else name, above | {child})

    walk(f.root, "", frozenset({f.root}))
    for path, _addr, messages in found:
        try:
            rows = list(_object(f, path, messages, vlen))
        except Unsupported:
            if error == "raise":
                raise
            continue
        yield from rows


def _object(f: File, path: str, messages: list, vlen: str) -> Iterator[Pair]:
    kinds = {k: p for k, p, _ in messages}
    attrs = f.attributes(messages)
    shown = {k: v for k, v in attrs.items() if k not in HIDDEN_ATTRS and k != "_FillValue" and v is not None and v != "DIMENSION_SCALE"}
    if 0x08 not in kinds or 0x03 not in kinds:
        yield from _group(path, shown)
        return
    shape = f.dataspace(kinds[0x01])
    string = f.data[kinds[0x03]] & 15 == 9
    if string and f.data[kinds[0x03] + 1] & 15 != 1:
        raise Unsupported("sequences of variable length")
    dtype, size, _ = f.datatype(kinds[0x03])
    pipeline = f.filters(kinds[0x0B]) if 0x0B in kinds else []
    chunk, places, inline = f.chunks(kinds[0x08], shape, bool(pipeline))
    first = places[0][3] if places else 0
    compressor, filters, checksum = _codecs(pipeline, first, size)
    lists = attrs.get("DIMENSION_LIST")
    dims = []
    for k in range(len(shape)):
        refs = lists[k] if isinstance(lists, list) and k < len(lists) and isinstance(lists[k], list) else []
        if len(refs) == 1:
            dims.append(f.names.get(refs[0], ""))
        elif attrs.get("CLASS") == "DIMENSION_SCALE":
            dims.append(path)
        elif refs:
            raise Unsupported("several dimension scales on one axis")
        else:
            dims.append(f"phony_dim_{k}")
    zero = f"{path}/" + (".".join("0" * len(shape)) or "0")
    whole = prod(shape) * size
    if string:
        stored = [(zero, inline)] if inline is not None else []
        for index, at, n, mask in places:
            raw = bytes(f.data[at : at + (whole if n < 0 else n)])
            c, fl, sums = _codecs(pipeline, mask, size)
            raw = raw[:-4] if sums else raw
            for codec in [*([c] if c else []), *reversed(fl or [])]:
                raw = BYTES[codec["id"]](raw, **{k: v for k, v in codec.items() if k != "id"})
            stored.append((f"{path}/" + (".".join(map(str, index)) or "0"), raw))
        yield from _string_rows(f, path, shape, dims, shown, size, chunk, stored, vlen)
        return
    fill = attrs.get("_FillValue")
    fill = _fill(f, messages, dtype) if not isinstance(fill, (int, float)) else "NaN" if fill != fill else fill
    yield from _array(path, shape, chunk, dtype, dims, shown, fill, compressor, filters)
    if inline is not None:
        yield zero, inline
    meta = {"compressor": compressor, "filters": filters}
    for index, at, n, mask in places:
        n = whole if n < 0 else n
        key = f"{path}/" + (".".join(map(str, index)) or "0")
        if mask != first:
            yield key, _recoded(bytes(f.data[at : at + n]), pipeline, mask, size, meta)
        else:
            yield key, (at, n - 4 if checksum else n)
