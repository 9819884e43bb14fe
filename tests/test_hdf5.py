import json
import struct
import zlib

import numpy as np
import pytest

from chunkloom.functions.codecs import decode_chunk
from chunkloom.sources import dataset, hdf5, scan

NONE = 0xFFFFFFFFFFFFFFFF


class Writer:
    """Just enough of the format to test the reader against."""

    def __init__(self):
        self.b = bytearray()

    def put(self, raw):
        self.b += b"\0" * (-len(self.b) % 8)
        at = len(self.b)
        self.b += raw
        return at

    def header2(self, messages):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return self.put(b"OHDR\2\2" + struct.pack("<I", len(body)) + body + b"\0\0\0\0")

    def header1(self, messages):
        pad = [(k, m + b"\0" * (-len(m) % 8)) for k, m in messages]
        body = b"".join(struct.pack("<HHBxxx", k, len(m), 0) + m for k, m in pad)
        return self.put(struct.pack("<BxHII4x", 1, len(pad), 1, len(body)) + body)


def space(*shape):
    return struct.pack("<BBBB", 2, len(shape), 0, 1) + struct.pack(f"<{len(shape)}Q", *shape)


I4 = struct.pack("<B3BI", 0x10, 0x08, 0, 0, 4) + struct.pack("<HH", 0, 32)
F8 = struct.pack("<B3BI", 0x11, 0x20, 0x3F, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)


def text_attr(name, value):
    dt = struct.pack("<B3BI", 0x13, 0, 0, 0, len(value))
    return struct.pack("<BBHHHB", 3, 0, len(name) + 1, len(dt), 4, 0) + name.encode() + b"\0" + dt + struct.pack("<BBBB", 2, 0, 0, 0) + value.encode()


def link(name, addr):
    return struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", addr)


def datasets(w, header):
    """A contiguous int array, and a float array in shuffled, deflated and checked chunks, one of them missing."""
    a = np.arange(6, dtype="<i4").reshape(2, 3)
    at = w.put(a.tobytes())
    one = header([(1, space(2, 3)), (3, I4), (8, struct.pack("<BBQQ", 3, 1, at, a.nbytes)), (0x0C, text_attr("units", "m"))])
    b = np.linspace(0, 1, 20).reshape(4, 5)
    parts = []
    for i, j in ((0, 0), (2, 0), (0, 3)):
        c = np.zeros((2, 3))
        v = b[i : i + 2, j : j + 3]
        c[:, : v.shape[1]] = v
        raw = zlib.compress(c.view(np.uint8).reshape(-1, 8).T.tobytes()) + b"SUM!"
        parts.append(((i, j), w.put(raw), len(raw)))
    keys = b"".join(struct.pack("<IIQQQQ", n, 0, i, j, 0, at) for (i, j), at, n in parts)
    tree = w.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(parts), NONE, NONE) + keys + struct.pack("<IIQQQ", 0, 0, 4, 5, 0))
    pipeline = struct.pack("<BB", 2, 3) + struct.pack("<HHHI", 2, 0, 1, 8) + struct.pack("<HHHI", 1, 0, 1, 4) + struct.pack("<HHH", 3, 0, 0)
    layout = struct.pack("<BBBQIII", 3, 2, 3, tree, 2, 3, 8)
    two = header([(1, space(4, 5)), (3, F8), (0x0B, pipeline), (8, layout), (5, struct.pack("<BBI", 3, 0x20, 8) + struct.pack("<d", -1.0))])
    return (one, a), (two, b)


def new_file():
    w = Writer()
    w.put(b"\0" * 48)
    (one, a), (two, b) = datasets(w, w.header2)
    group = w.header2([(6, link("b", two))])
    root = w.header2([(6, link("a", one)), (6, link("g", group)), (0x0C, text_attr("title", "test"))])
    w.b[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, NONE, len(w.b), root) + b"\0\0\0\0"
    return bytes(w.b), a, b


def old_file():
    w = Writer()
    w.put(b"\0" * 96)
    (one, a), (two, b) = datasets(w, w.header1)
    text = w.put(b"\0\0\0\0\0\0\0\0a\0\0\0\0\0\0\0g/b\0\0\0\0\0")
    heap = w.put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", 24, NONE, text))
    entry = lambda name, addr: struct.pack("<QQII16x", name, addr, 0, 0)
    snod = w.put(b"SNOD\1\0" + struct.pack("<H", 2) + entry(8, one) + entry(16, two))
    tree = w.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, snod, 16))
    root = w.header1([(0x11, struct.pack("<QQ", tree, heap))])
    w.b[:96] = (hdf5.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(w.b), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)).ljust(96, b"\0")
    return bytes(w.b), a, b


@pytest.mark.parametrize("make", [new_file, old_file])
def test_parse(make):
    raw, a, b = make()
    got = dict(hdf5.hdf5(raw))
    at, n = got["a/0.0"]
    assert (decode_chunk(raw[at : at + n], json.loads(got["a/.zarray"])) == a).all()
    assert json.loads(got["a/.zattrs"]) == {"units": "m", "_ARRAY_DIMENSIONS": ["phony_dim_0", "phony_dim_1"]}
    meta = json.loads(got["g/b/.zarray"])
    assert meta["chunks"] == [2, 3] and meta["fill_value"] == -1.0 and meta["compressor"] == {"id": "zlib"}
    at, n = got["g/b/1.0"]
    assert (decode_chunk(raw[at : at + n], meta) == b[2:4, :3]).all()
    assert "g/b/0.1" in got and "g/b/1.1" not in got


def test_cells(spark, tmp_path):
    raw, a, b = new_file()
    (tmp_path / "f.h5").write_bytes(raw)
    refs = scan.scan(spark, str(tmp_path), "hdf5", inline_threshold=30).drop("error")
    got = {(r.var, *r.position): r.value for r in dataset.open_cells(refs).collect()}
    want = {("a", *i): float(v) for i, v in np.ndenumerate(a)} | {("g/b", *i): v for i, v in np.ndenumerate(b) if not (i[0] >= 2 and i[1] >= 3)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_unsupported():
    raw, _, _ = new_file()
    bad = raw.replace(struct.pack("<HHHI", 1, 0, 1, 4), struct.pack("<HHHI", 6, 0, 1, 4))
    with pytest.raises(hdf5.Unsupported, match="filter 6"):
        list(hdf5.hdf5(bad))
    kept = dict(hdf5.hdf5(bad, error="skip"))
    assert "a/0.0" in kept and "g/b/.zarray" not in kept
    with pytest.raises(ValueError, match="not an HDF5"):
        list(hdf5.hdf5(b"x" * 2000))


# --- denser storage ---------------------------------------------------------------------------


def heap(w, objects):
    """(address, ids) of a fractal heap of one direct block."""
    body, ids = b"", []
    for o in objects:
        ids.append(struct.pack("<BIH", 0, 21 + len(body), len(o)))  # 32 bits of offset, two bytes of length
        body += o
    block = w.put(b"FHDB\0" + struct.pack("<Q", 0) + b"\0" * 4 + b"\0" * 4 + body)
    head = b"FRHP\0" + struct.pack("<HHBI", 7, 0, 0, 4096) + b"\0" * (10 * 8 + 2 * 8) + struct.pack("<HQQHHQH", 4, 512, 65536, 32, 1, block, 0)
    return w.put(head + b"\0\0\0\0"), ids


def tree2(w, kind, records, node=512):
    """A version 2 B-tree with one leaf, or with one inner node over two leaves if there are many records."""
    size = len(records[0])
    leaf = lambda rs: w.put(b"BTLF\0" + bytes([kind]) + b"".join(rs) + b"\0\0\0\0")
    half = len(records) // 2
    if len(records) <= (node - 10) // size:
        root, n, depth = leaf(records), len(records), 0
    else:
        a, b = leaf(records[:half]), leaf(records[half + 1 :])
        width = "B" if (node - 10) // size < 256 else "H"
        inner = b"BTIN\0" + bytes([kind]) + records[half] + struct.pack("<Q" + width, a, half) + struct.pack("<Q" + width, b, len(records) - half - 1)
        root, n, depth = w.put(inner + b"\0\0\0\0"), 1, 1
    return w.put(b"BTHD\0" + bytes([kind]) + struct.pack("<IHHBBQHQ", node, size, depth, 98, 40, root, n, len(records)) + b"\0\0\0\0")


def finish(w, root):
    w.b[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, NONE, len(w.b), root) + b"\0\0\0\0"
    return bytes(w.b)


def scalar(w, value, attrs=()):
    at = w.put(struct.pack("<i", value))
    return w.header2([(1, space()), (3, I4), (8, struct.pack("<BBQQ", 3, 1, at, 4)), *attrs])


def test_dense_links_and_attributes():
    w = Writer()
    w.put(b"\0" * 48)
    names = [f"variable_{i:02d}" for i in range(9)]
    attr_heap, attr_ids = heap(w, [text_attr(f"attr_{i}", f"value {i}") for i in range(9)])
    attr_tree = tree2(w, 8, [i.ljust(8, b"\0") + struct.pack("<BII", 0, k, k) for k, i in enumerate(attr_ids)])
    info = struct.pack("<BBQQ", 0, 0, attr_heap, attr_tree)
    members = [scalar(w, 10 * i, [(0x15, info)] if i == 4 else []) for i in range(9)]
    link_heap, link_ids = heap(w, [link(n, a) for n, a in zip(names, members, strict=True)])
    link_tree = tree2(w, 5, [struct.pack("<I", k) + i for k, i in enumerate(link_ids)], node=64)  # two leaves
    raw = finish(w, w.header2([(2, struct.pack("<BBQQ", 0, 0, link_heap, link_tree))]))
    got = dict(hdf5.hdf5(raw))
    assert [k for k in got if k.endswith(".zarray")] == [f"{n}/.zarray" for n in names]
    at, n = got["variable_07/0"]
    assert struct.unpack("<i", raw[at : at + n]) == (70,)
    assert json.loads(got["variable_04/.zattrs"]) == {f"attr_{i}": f"value {i}" for i in range(9)} | {"_ARRAY_DIMENSIONS": []}


def chunked(w, shape, most, index, filters=()):
    most = [(1 << 64) - 1 if m is None else m for m in most]
    sp = struct.pack("<BBBB", 2, len(shape), 1, 1) + struct.pack(f"<{len(shape)}Q", *shape) + struct.pack(f"<{len(shape)}Q", *most)
    layout = struct.pack("<BBBBB", 4, 2, 0, len(shape) + 1, 4) + struct.pack(f"<{len(shape) + 1}I", *[2] * len(shape), 4) + index
    return w.header2([(1, sp), (3, I4), *([(0x0B, struct.pack("<BB", 2, len(filters)) + b"".join(filters))] if filters else []), (8, layout)])


DEFLATE = struct.pack("<HHHI", 1, 0, 1, 4)


def read(raw, got, var, index):
    meta = json.loads(got[f"{var}/.zarray"])
    v = got[f"{var}/{index}"]
    return decode_chunk(v if isinstance(v, bytes) else raw[v[0] : v[0] + v[1]], meta)


def test_chunk_indexes():
    w = Writer()
    w.put(b"\0" * 48)
    a = np.arange(24, dtype="<i4").reshape(6, 4)
    parts = {(i, j): np.ascontiguousarray(a[2 * i : 2 * i + 2, 2 * j : 2 * j + 2]) for i in range(3) for j in range(2)}
    # Version 2 B-tree, deflated; one chunk skips its filter.
    packed = {k: (v.tobytes(), 1) if k == (1, 1) else (zlib.compress(v.tobytes()), 0) for k, v in parts.items()}
    records = [struct.pack("<QIIQQ", w.put(raw), len(raw), mask, *k) for k, (raw, mask) in packed.items()]
    one = chunked(w, [6, 4], [None, None], bytes([5]) + struct.pack("<IBBQ", 512, 98, 40, tree2(w, 11, records)), [DEFLATE])
    # Extensible array: four elements in the index block, two in its first data block; the first axis grows.
    places = [w.put(parts[k].tobytes()) for k in sorted(parts)]
    data_block = w.put(b"EADB\0\0" + struct.pack("<Q", 0) + b"\0\0\0\0" + struct.pack("<16Q", *places[4:], *[NONE] * 14) + b"\0\0\0\0")
    index_block = w.put(b"EAIB\0\0" + struct.pack("<Q", 0) + struct.pack("<4Q", *places[:4]) + struct.pack("<6Q", data_block, *[NONE] * 5) + struct.pack("<25Q", *[NONE] * 25) + b"\0\0\0\0")
    array = w.put(b"EAHD\0\0" + bytes([8, 32, 4, 16, 4, 10]) + struct.pack("<6Q", 0, 0, 1, 0, 6, 20) + struct.pack("<Q", index_block) + b"\0\0\0\0")
    two = chunked(w, [6, 4], [None, 4], bytes([4, 32, 4, 16, 4, 10]) + struct.pack("<Q", array))
    # Fixed array in pages of two, the second one missing.
    pages = struct.pack("<2Q", *places[:2]) + b"\0" * 4 + b"\0" * 20 + struct.pack("<2Q", *places[4:]) + b"\0" * 4
    block = w.put(b"FADB\0\0" + struct.pack("<Q", 0) + bytes([0b10100000]) + b"\0\0\0\0" + pages)
    fixed = w.put(b"FAHD\0\0" + bytes([8, 1]) + struct.pack("<QQ", 6, block) + b"\0\0\0\0")
    three = chunked(w, [6, 4], [6, 4], bytes([3, 1]) + struct.pack("<Q", fixed))
    raw = finish(w, w.header2([(6, link("one", one)), (6, link("two", two)), (6, link("three", three))]))
    got = dict(hdf5.hdf5(raw))
    for (i, j), v in parts.items():
        assert (read(raw, got, "one", f"{i}.{j}") == v).all() and (read(raw, got, "two", f"{i}.{j}") == v).all()
    assert isinstance(got["one/1.1"], bytes) and json.loads(got["one/.zarray"])["compressor"] == {"id": "zlib"}
    assert {k for k in got if k.startswith("three/") and ".z" not in k} == {"three/0.0", "three/0.1", "three/2.0", "three/2.1"}
    assert (read(raw, got, "three", "2.1") == parts[2, 1]).all()


def test_strings_and_links():
    w = Writer()
    w.put(b"\0" * 48)
    words = [b"alpha", b"be", b""]
    body = b"".join(struct.pack("<HHIQ", k + 1, 1, 0, len(x)) + x + b"\0" * (-len(x) % 8) for k, x in enumerate(words[:2]))
    gcol = w.put(b"GCOL\1\0\0\0" + struct.pack("<Q", 16 + len(body) + 16) + body + b"\0" * 16)
    ids = b"".join(struct.pack("<IQI", len(x), gcol if x else 0, k + 1 if x else 0) for k, x in enumerate(words))
    at = w.put(ids)
    kind = struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + struct.pack("<B3BI", 0x13, 0, 0, 0, 1)
    s = w.header2([(1, space(3)), (3, kind), (8, struct.pack("<BBQQ", 3, 1, at, len(ids)))])
    raw = finish(w, w.header2([(6, link("s", s)), (6, link("again", s))]))
    embedded = dict(hdf5.hdf5(raw))
    assert read(raw, embedded, "s", "0").tolist() == words and "again/.zarray" not in embedded
    assert read(raw, dict(hdf5.hdf5(raw, vlen="encode")), "s", "0").tolist() == ["alpha", "be", ""]
    assert dict(hdf5.hdf5(raw, vlen="leave"))["s/0"] == ids and "s/0" not in dict(hdf5.hdf5(raw, vlen="null"))
    assert "again/0" in dict(hdf5.hdf5(raw, preserve_linked=True))
    with pytest.raises(ValueError, match="policy"):
        list(hdf5.hdf5(raw, vlen="what"))


def test_hdf4():
    from chunkloom.sources import hdf4

    elements, body, at = [], bytearray(), 4 + 6 + 12 * 15

    def put(tag, ref, raw, extended=False):
        elements.append((tag | (0x4000 if extended else 0), ref, at + len(body), len(raw)))
        body.extend(raw)

    def name(x):
        return struct.pack(">H", len(x)) + x

    def group(ref, label, kind, members):
        put(1965, ref, struct.pack(">H", len(members)) + struct.pack(f">{len(members)}H", *[t for t, _ in members]) + struct.pack(f">{len(members)}H", *[r for _, r in members]) + name(label) + name(kind))

    def table(ref, label, rows, width, field=b"VALUES", kind=4):
        put(1962, ref, struct.pack(">HIHH", 0, rows, width, 1) + struct.pack(">4H", kind, width, 0, 1) + name(field) + name(label) + name(b"Attr0.0"))

    a = np.arange(6, dtype=">i2").reshape(2, 3)
    packed = zlib.compress(a.tobytes())
    put(106, 1, bytes([1, 22, 16, 1]))
    put(701, 2, struct.pack(">HIIHH", 2, 2, 3, 106, 1))
    put(702, 3, a.tobytes())
    put(40, 4, packed)
    put(61, 5, struct.pack(">HHIHHH", 3, 0, 12, 4, 0, 4), True)
    put(1962, 6, struct.pack(">HIHH", 0, 1, 12, 0) + name(b"table") + name(b"_HDF_CHK_TBL_0"))
    put(1963, 6, struct.pack(">IIHH", 0, 0, 61, 5))
    put(702, 7, struct.pack(">H", 5) + b"\0" * 21 + struct.pack(">HHHHI", 1962, 6, 0, 0, 2) + struct.pack(">6I", 0, 2, 2, 0, 3, 3) + struct.pack(">I", 0), True)
    table(8, b"units", 1, 2)
    put(1963, 8, b"m\0")
    table(9, b"CoreMetadata.0", 1, 60)
    put(1963, 9, b'OBJECT = NAME\n NUM_VAL = 1\n VALUE = "grid"\nEND_OBJECT = NAME\n')
    group(10, b"plain", b"Var0.0", [(106, 1), (701, 2), (702, 3), (1962, 8)])
    group(11, b"tiled", b"Var0.0", [(106, 1), (701, 2), (702, 7)])
    group(12, b"root", b"CDF0.0", [(1965, 10), (1965, 11)])
    raw = b"\x0e\x03\x13\x01" + struct.pack(">HI", len(elements), 0) + b"".join(struct.pack(">HHii", *e) for e in elements)
    raw = raw.ljust(at, b"\0") + bytes(body)
    got = dict(hdf4.hdf4(raw))
    assert (read(raw, got, "plain", "0.0") == a).all() and (read(raw, got, "tiled", "0.0") == a).all()
    assert json.loads(got["plain/.zattrs"])["units"] == "m" and json.loads(got["tiled/.zarray"])["compressor"] == {"id": "zlib"}
    assert json.loads(got[".zattrs"]) == {"NAME": "grid"}
    with pytest.raises(ValueError, match="not an HDF4"):
        list(hdf4.hdf4(b"x" * 100))
