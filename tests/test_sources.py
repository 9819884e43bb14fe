import datetime as dt
import gzip
import io
import json
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest

from chunkloom.functions import codecs
from chunkloom.sources import binary, dataset, grib2, hdf4, references, scan
from chunkloom.streaming.idx_ingest import ingest


def _nc_name(s):
    b = s.encode()
    return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)


def netcdf(version=1):
    """x of 3, unlimited t with two records; fixed f8 x, record i2 a (padded) and f4 b(t, x)."""
    addr = ">i" if version == 1 else ">q"
    x, a, b = np.arange(3, dtype=">f8"), np.array([7, 8], ">i2"), np.arange(6, dtype=">f4").reshape(2, 3)

    def head(at):
        h = b"CDF" + bytes([version]) + struct.pack(">i", 2)
        h += struct.pack(">ii", 10, 2) + _nc_name("t") + struct.pack(">i", 0) + _nc_name("x") + struct.pack(">i", 3)
        h += struct.pack(">ii", 12, 1) + _nc_name("title") + struct.pack(">ii", 2, 2) + b"hi\0\0"
        h += struct.pack(">ii", 11, 3)
        for name, dims, kind, size, k in (("x", [1], 6, 24, 0), ("a", [0], 3, 4, 1), ("b", [0, 1], 5, 12, 2)):
            h += _nc_name(name) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + struct.pack(">ii", 0, 0)
            h += struct.pack(">ii", kind, size) + struct.pack(addr, at[k])
        return h

    n = len(head([0, 0, 0]))
    out = head([n, n + 24, n + 28]) + x.tobytes()
    for r in range(2):
        out += a[r : r + 1].tobytes() + b"\0\0" + b[r].tobytes()
    return out, x, a, b


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf3_round_trip(spark, tmp_path, version):
    raw, x, a, b = netcdf(version)
    (tmp_path / "f.nc").write_bytes(raw)
    refs = scan.scan(spark, str(tmp_path), "netcdf3", inline_threshold=0).drop("error")
    got = {(r.var, tuple(r.position)): r.value for r in dataset.open_cells(refs).collect()}
    want = {("x", (i,)): v for i, v in enumerate(x)} | {("a", (i,)): v for i, v in enumerate(a)} | {("b", i): v for i, v in np.ndenumerate(b)}
    assert got == {k: float(v) for k, v in want.items()}
    inline = scan.scan(spark, str(tmp_path), "netcdf3").filter("key = 'x/0'").first()
    assert inline.raw == x.tobytes() and inline.path is None


def test_bad_file(spark, tmp_path):
    (tmp_path / "f.nc").write_bytes(b"nothing")
    r = scan.scan(spark, str(tmp_path), "netcdf3", error="row").first()
    assert "not a NetCDF" in r.error and r.key is None


def _card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80).encode()


def _pad(b, fill=b"\0"):
    return b + fill * (-len(b) % 2880)


def test_fits_image_and_table():
    img = np.arange(6, dtype=">i2").reshape(2, 3)
    one = _pad(b"".join([_card("SIMPLE", "T"), _card("BITPIX", 16), _card("NAXIS", 2), _card("NAXIS1", 3), _card("NAXIS2", 2), _card("BSCALE", 2.0), _card("BZERO", 1.0), b"END".ljust(80)]), b" ") + _pad(img.tobytes())
    rows = np.array([(1, 2.5), (3, 4.5)], [("n", ">i4"), ("m", ">f8")])
    cards = [_card("XTENSION", "'BINTABLE'"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", 12), _card("NAXIS2", 2), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", 2), _card("TFORM1", "'J       '"), _card("TTYPE1", "'n       '"), _card("TFORM2", "'D       '"), _card("TTYPE2", "'m       '")]
    data = one + _pad(b"".join([*cards, b"END".ljust(80)]), b" ") + _pad(rows.tobytes())
    first = dict(binary.fits(data))
    meta = json.loads(first["PRIMARY/.zarray"])
    at, size = first["PRIMARY/0.0"]
    assert (codecs.decode_chunk(data[at : at + size], meta) == img * 2.0 + 1).all()
    second = dict(binary.fits(data, extension=1))
    meta, (at, size) = json.loads(second["1/.zarray"]), second["1/0"]
    assert codecs.record_member(data[at : at + size], meta["dtype"], "m").tolist() == [2.5, 4.5]
    with pytest.raises(ValueError, match="No data HDU"):
        list(binary.fits(one, extension=9))


def test_tiff_strips_and_tags():
    img = np.arange(12, dtype="<u2").reshape(4, 3)
    strips = [zlib.compress(img[i : i + 2].tobytes()) for i in (0, 2)]
    tags = [(256, 3, 1, 3), (257, 3, 1, 4), (258, 3, 1, 16), (259, 3, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2)]
    base = 8 + 2 + 12 * (len(tags) + 2) + 4
    body = struct.pack("<HHI", 273, 4, 2) + struct.pack("<I", base) + struct.pack("<HHI", 279, 4, 2) + struct.pack("<I", base + 8)
    ifd = struct.pack("<H", len(tags) + 2) + b"".join(struct.pack("<HHII", *t) for t in tags) + body + struct.pack("<I", 0)
    at = base + 16
    data = b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<II", at, at + len(strips[0])) + struct.pack("<II", *map(len, strips)) + b"".join(strips)
    got = dict(binary.tiff(data))
    meta = json.loads(got[".zarray"])
    rows = [codecs.decode_chunk(data[o : o + s], meta) for o, s in (got["0.0"], got["1.0"])]
    assert (np.concatenate(rows) == img).all()


def test_grib_framing():
    section1 = struct.pack(">IBHHBBBHBBBBBBB", 21, 1, 7, 0, 2, 1, 1, 2024, 1, 2, 3, 4, 5, 0, 1)
    body = section1 + b"7777"
    msg = b"GRIB\0\0\0\2" + struct.pack(">Q", 16 + len(body)) + body
    got = list(binary.grib_messages(b"junk" + msg + b"xx" + msg))
    assert [m[0] for m in got] == [4, 6 + len(msg)] and got[0][4] == "2024-01-02 03:04:05"
    assert len(list(binary.grib_messages(msg * 3, skip=2))) == 2


def test_hdf4_descriptor_blocks():
    second = struct.pack(">HI", 1, 0) + struct.pack(">HHii", 720 | 0x4000, 5, 99, 10)
    first = struct.pack(">HI", 2, 34) + struct.pack(">HHii", 30, 1, 50, 4) + struct.pack(">HHii", 1, 0, -1, -1)
    assert list(hdf4.descriptors(b"\x0e\x03\x13\x01" + first + second)) == [(30, 1, 50, 4, False), (720, 5, 99, 10, True)]


def test_archives(spark, tmp_path):
    payload = b"piece of data"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data1", payload)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        i = tarfile.TarInfo("data1")
        i.size = len(payload)
        t.addfile(i, io.BytesIO(payload))
    m = scan.archive_members(spark, str(tmp_path)).collect()
    assert len(m) == 2
    for r in m:
        raw = open(r.archive.removeprefix("file:"), "rb").read()
        assert raw[r.member_offset : r.member_offset + r.member_size] == payload
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d", payload * 20)
    assert codecs.BYTES["deflate"](packed.getvalue()) == payload * 20


def test_zarr2(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / ".zgroup").write_text('{"zarr_format": 2}')
    (tmp_path / "v/.zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3], "chunks": [2], "dtype": "<i4", "fill_value": 0, "order": "C", "compressor": {"id": "zlib"}, "filters": None}))
    for i, part in enumerate(([1, 2], [3, 9])):
        (tmp_path / f"v/{i}").write_bytes(zlib.compress(np.array(part, "<i4").tobytes()))
    refs = scan.scan_zarr2(spark, str(tmp_path))
    assert sorted((r.position[0], r.value) for r in dataset.open_cells(refs).collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    (tmp_path / ".zgroup").write_text('{"zarr_format": 3}')
    with pytest.raises(ValueError, match="V2"):
        scan.scan_zarr2(spark, str(tmp_path))


def test_records_as_rows(spark):
    meta = {"dtype": [["n", ">i4"], ["m", "<f8"], ["b", "|b1"], ["s", "|S2"]], "chunks": [2], "shape": [3], "compressor": {"id": "zlib"}, "filters": [{"id": "physical", "field": "n", "scale": 0.5, "zero": 1.0}]}
    rows = np.array([(1, 2.5, True, b"ab"), (-2, np.nan, False, b""), (3, 0.0, True, b"c"), (9, 9.0, True, b"out")], codecs.numpy_dtype(meta["dtype"]))
    chunks = [(f"t/{i}", codecs.encode_chunk(rows[2 * i : 2 * i + 2], meta | {"filters": None})) for i in range(2)]
    refs = spark.createDataFrame([(k, None, None, None, raw) for k, raw in [*chunks, ("t/.zarray", json.dumps(meta).encode())]], "key string, path string, offset bigint, size bigint, raw binary")
    got = dataset.open_records(refs, {"b": "boolean", "n": "double", "m": "double"}, ["t"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("t", True, 1.5, 2.5), ("t", False, 0.0, float("nan")), ("t", True, 2.5, 0.0)]))
    cells = {(r.var, *r.position): r.value for r in dataset.open_cells(refs).collect()}
    assert cells == {("t/n", 0): 1.5, ("t/n", 1): 0.0, ("t/n", 2): 2.5, ("t/m", 0): 2.5, ("t/m", 2): 0.0, ("t/b", 0): 1.0, ("t/b", 1): 0.0, ("t/b", 2): 1.0}


def test_json_round_trip(spark, tmp_path):
    doc = {"version": 1, "templates": {"u": "s3://b/x.nc"}, "refs": {".zgroup": '{"zarr_format":2}', "v/.zarray": '{"shape":[4],"chunks":[2]}', "v/0": ["{{u}}", 10, 20], "v/1": ["{{u}}"], "w/0": "base64:AAH/", "t": 'te"xt'}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    refs = references.read_json(spark, [str(tmp_path / "a.json")])
    references.write_json(refs, str(tmp_path / "out.json"))
    again = json.loads((tmp_path / "out.json").read_text())
    want = {k: ([v[0].replace("{{u}}", "s3://b/x.nc"), *v[1:]] if isinstance(v, list) else v) for k, v in doc["refs"].items()}
    assert again == {"version": 1, "refs": want}
    references.write_json(refs, str(tmp_path / "out.json.gz"), compression="gzip")
    assert json.loads(gzip.decompress((tmp_path / "out.json.gz").read_bytes())) == again
    back = references.read_json(spark, str(tmp_path / "out.json.gz"))
    assert back.count() == len(doc["refs"]) and {r.ds_idx for r in back.collect()} == {0}


def test_json_numbers_inputs(spark, tmp_path):
    for n in ("a", "b", "ba"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"v/0": [f"{n}.nc", 1, 2]}))
    numbers = lambda p: {r.path: r.ds_idx for r in references.read_json(spark, p).collect()}
    assert numbers(str(tmp_path / "*.json")) == numbers(str(tmp_path)) == {"a.nc": 0, "b.nc": 1, "ba.nc": 2}
    assert numbers([str(tmp_path / f"{n}.json") for n in ("ba", "a", "b")]) == {"ba.nc": 0, "a.nc": 1, "b.nc": 2}


def test_json_generators(spark, tmp_path):
    doc = {
        "version": 1,
        "templates": {"u": "server.domain/path", "f": "{{c}}"},
        "gen": [{"key": "gen_key{{i}}", "url": "http://{{u}}_{{i}}", "offset": "{{(i + 1) * 1000}}", "length": "1000", "dimensions": {"i": {"stop": 5}}}, {"key": "w{{i}}.{{n}}", "url": "{{u}}/{{n}}", "dimensions": {"i": {"start": 2, "stop": 6, "step": 2}, "n": ["x", "y"]}}],
        "refs": {"key0": "data", "key1": ["http://target_url", 10000, 100], "key2": ["http://{{u}}", 10000, 100], "key3": ["http://{{f(c='text')}}", 10000, 100], "key4": ["http://target_url"]},
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    got = {r.key: (r.path, r.offset, r.size, r.raw and bytes(r.raw)) for r in references.read_json(spark, str(tmp_path / "g.json")).collect()}
    want = {f"gen_key{i}": (f"http://server.domain/path_{i}", (i + 1) * 1000, 1000, None) for i in range(5)}
    want |= {f"w{i}.{n}": (f"server.domain/path/{n}", 0, 0, None) for i in (2, 4) for n in "xy"}
    want |= {"key0": (None, None, None, b"data"), "key1": ("http://target_url", 10000, 100, None), "key2": ("http://server.domain/path", 10000, 100, None), "key3": ("http://text", 10000, 100, None), "key4": ("http://target_url", 0, 0, None)}
    assert got == want
    with pytest.raises(ValueError, match="not allowed"):
        references.evaluate("__import__('os')", {})


def test_parquet_records(spark, tmp_path):
    meta = [(f"{v}/.zarray", None, None, None, json.dumps({"shape": shape, "chunks": [1] * len(shape)}).encode()) for v, shape in (("v", [7]), ("g/w", [2, 3]))]
    rows = [(f"v/{i}", "p", i * 10, 10, None) for i in range(7) if i != 2] + [("g/w/1.2", None, None, None, b"xy")]
    refs = spark.createDataFrame(meta + rows, "key string, path string, offset bigint, size bigint, raw binary")
    arrays = spark.createDataFrame([("v", [7], [1]), ("g/w", [2, 3], [1, 1])], "var string, shape array<bigint>, chunks array<bigint>")
    references.write_parquet(refs, arrays, str(tmp_path / "r"), record_size=4)
    assert sorted(p.name for p in (tmp_path / "r/v").glob("refs*")) == ["refs.0.parq", "refs.1.parq"]
    import pyarrow.parquet as pq

    assert pq.read_table(tmp_path / "r/v/refs.0.parq").column("offset").to_pylist() == [0, 10, 0, 30]
    assert json.loads((tmp_path / "r/.zmetadata").read_text()) == {"metadata": {k: json.loads(m) for k, *_, m in meta}, "record_size": 4}
    back = references.read_parquet(spark, str(tmp_path / "r")).filter("index is not null").collect()
    assert sorted((r.key, r.path, r.offset, r.raw and bytes(r.raw)) for r in back) == sorted((k, p, o or 0, r) for k, p, o, _, r in rows)
    one = references.read_parquet(spark, str(tmp_path / "r"), ["g/w"]).filter("index is not null").collect()
    assert [(r.key, r["index"], r.rec_no, r.row_no) for r in one] == [("g/w/1.2", [1, 2], 1, 1)]


def test_codecs():
    a = np.arange(8, dtype="<i4")
    mixed = a.view(np.uint8).reshape(8, 4).T.tobytes()
    assert codecs.BYTES["shuffle"](mixed, elementsize=4) == a.tobytes()
    t = codecs.ascii_table(b"ab 12cd 34", 5, [("s", "|S2", 0), ("n", "|S2", 3)])
    assert t["s"].tolist() == [b"ab", b"cd"] and t["n"].tolist() == [b"12", b"34"]
    raw = struct.pack(">ii", 2, 0) + struct.pack(">ii", 1, 4) + np.array([1, 2, 3], ">i2").tobytes()
    assert [x.tolist() for x in codecs.heap_arrays(raw, 2, 8, 0, "I", 16)] == [[1, 2], [3]]
    assert codecs.fill_strings(b"\0" * 15 + b"\1", {"0" * 31 + "1": "x"}) == ["x"]
    with pytest.raises(ValueError, match="unknown codec"):
        codecs.decode_chunk(b"\0", {"dtype": "|u1", "chunks": [1], "filters": [{"id": "what"}]})


def test_index_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.idx").write_text("1:0:d=2024010200:TMP:surface:1 hour fcst:\n2:50:d=2024010200:UGRD:surface:1 hour fcst:\n")
    lines = scan.read_index_files(spark, str(tmp_path / "in"))
    assert [r.value[:1] for r in lines.orderBy("line_no").collect()] == ["1", "2"]
    mapping = spark.sql("select 'TMP:surface:1 hour fcst:' attrs, 't' varname, 'surface' typeOfLevel, 'instant' stepType, 'Temperature' name, interval '1' hour step, 0D level")
    ingest(spark, str(tmp_path / "in"), mapping, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.varname, r.offset, r.length, str(r.valid_time)) == ("t", 0, 50, "2024-01-02 01:00:00")


def test_more_codecs():
    a = np.arange(500, dtype="<i4")
    for flags, codec in ((0x61, lambda b: zlib.compress(b)), (0x81, lambda b: codecs.PACK["zstd"](b)), (0x21, lambda b: __import__("pyarrow").compress(b, codec="lz4_raw", asbytes=True))):
        mixed = codecs.PACK["shuffle"](a.tobytes(), elementsize=4)
        parts = [mixed[k * 500 : (k + 1) * 500] for k in range(4)] if not flags & 16 else [mixed]
        body = b"".join(struct.pack("<i", len(p)) + p for p in map(codec, parts))
        raw = bytes([2, 1, flags, 4]) + struct.pack("<III", a.nbytes, a.nbytes, 20 + len(body)) + struct.pack("<I", 20) + body
        assert codecs.BYTES["blosc"](raw) == a.tobytes()
    assert codecs.BYTES["packbits"](bytes([2, 65, 66, 67, 254, 88, 128])) == b"ABCXXX"
    # 9-bit codes: clear, 1, 2, the pair of them, end.
    bits = "".join(f"{c:09b}" for c in (256, 1, 2, 258, 257))
    assert codecs.BYTES["lzw"](int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == b"\1\2\1\2"
    meta = {"dtype": "|u1", "chunks": [2, 3], "shape": [2, 3], "filters": [{"id": "delta_rows"}]}
    assert codecs.decode_chunk(bytes([1, 1, 1, 5, 0, 255]), meta).tolist() == [[1, 2, 3], [5, 5, 4]]
    meta = {"dtype": "<i4", "chunks": [2, 2], "shape": [2, 2], "compressor": {"id": "zlib"}, "filters": [{"id": "shuffle", "elementsize": 4}]}
    b = np.array([[1, 2], [3, -4]], "<i4")
    assert (codecs.decode_chunk(codecs.encode_chunk(b, meta), meta) == b).all()


def test_table_columns(spark, tmp_path):
    rows = np.array([(1, 2, 0, b"ab"), (3, 1, 4, b"cd")], [("n", ">i4"), ("c", ">i4"), ("o", ">i4"), ("s", "S2")])
    heap = np.array([7, 8, 9], ">i2").tobytes()
    cards = [_card("XTENSION", "'BINTABLE'"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", 14), _card("NAXIS2", 2), _card("PCOUNT", 6), _card("GCOUNT", 1), _card("TFIELDS", 3), _card("TFORM1", "'J       '"), _card("TTYPE1", "'n       '"), _card("TFORM2", "'1PI(2)  '"), _card("TTYPE2", "'v       '"), _card("TFORM3", "'2A      '"), _card("TTYPE3", "'s       '")]
    one = _pad(b"".join([_card("SIMPLE", "T"), _card("BITPIX", 8), _card("NAXIS", 0), b"END".ljust(80)]), b" ")
    (tmp_path / "t.fits").write_bytes(one + _pad(b"".join([*cards, b"END".ljust(80)]), b" ") + _pad(rows.tobytes() + heap))
    refs = scan.scan(spark, str(tmp_path), "fits").drop("error")
    got = {(r.var, *r.position): r.value for r in dataset.open_cells(refs).collect()}
    assert got == {("1/n", 0): 1.0, ("1/n", 1): 3.0}
    assert {(r.var, *r.position): r.value for r in dataset.open_texts(refs).collect()} == {("1/s", 0): "ab", ("1/s", 1): "cd"}
    meta = json.loads(bytes(refs.filter("key = '1/.zarray'").first().raw))
    chunk = dataset.chunk_rows(refs).filter("var = '1'").first().raw
    assert [v.tolist() for v in codecs.decode_chunk(bytes(chunk), meta)["v"]] == [[7, 8], [9]]


# --- GRIB -------------------------------------------------------------------------------------


def _section(n, body):
    return struct.pack(">IB", len(body) + 5, n) + body


def grib_message(values, parameter=(0, 0), level=(103, 2), run=(2024, 1, 2, 6), step=3, mask=None, template=0, packed=None, statistic=None):
    """A message of edition 2 on a regular grid from 10 N to 8 N and 20 E to 22 E, one degree apart."""
    ny, nx = values.shape
    one = _section(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, *run, 0, 0, 0, 1))
    grid = struct.pack(">BIBBH", 0, nx * ny, 0, 0, 0) + bytes([6]) + b"\0" * 15 + struct.pack(">IIIIIIBIIIIB", nx, ny, 0, 0xFFFFFFFF, 10_000_000, 20_000_000, 48, (10 - ny + 1) * 1_000_000, (20 + nx - 1) * 1_000_000, 1_000_000, 1_000_000, 0)
    three = _section(3, grid)
    product = struct.pack(">HHBBBBBHBBIBBiBBi", 0, 0 if statistic is None else 8, *parameter, 2, 0, 0, 0, 0, 1, step, level[0], 0, level[1], 255, 0, 0)
    if statistic is not None:
        product += struct.pack(">HBBBBB", 2024, 1, 2, 12, 0, 0) + struct.pack(">BI", 1, 0) + struct.pack(">BBBIBI", statistic, 2, 1, 3, 255, 0)
    four = _section(4, product)
    bitmap = b"" if mask is None else np.packbits(mask.reshape(-1)).tobytes()
    six = _section(6, bytes([255 if mask is None else 0]) + bitmap)
    v = values.reshape(-1) if mask is None else values[mask]
    if template == 0:  # value = (10 + x) / 10 in 12 bits
        x = np.rint(v * 10 - 10).astype(int)
        bits = "".join(f"{i:012b}" for i in x)
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        five = _section(5, struct.pack(">IHfhhBB", len(v), 0, 10.0, 0, 1, 12, 0))
    else:
        five, body = packed
    data = one + three + four + five + six + _section(7, body) + b"7777"
    return b"GRIB\0\0\0\2" + struct.pack(">Q", 16 + len(data)) + data


def complex_packing(x, order):
    """Section 5 and the body of section 7 for integers x: groups of four, all differences in 8 bits."""
    d = x.astype(int)
    for _ in range(order):
        d = np.diff(d)
    low = int(d.min()) if order else 0
    v = np.concatenate([np.zeros(order, int), d - low]).astype(int)
    groups = [v[k : k + 4] for k in range(0, len(v), 4)]
    five = struct.pack(">IHfhhBB", len(x), 3 if order else 2, 0.0, 0, 0, 8, 0) + struct.pack(">BBII", 1, 0, 0, 0)
    five += struct.pack(">IBBIBIB", len(groups), 8, 0, 4, 1, len(groups[-1]), 0)
    sign = lambda i: (abs(i) | (0x8000 if i < 0 else 0)).to_bytes(2, "big")
    body = b""
    if order:
        five += struct.pack(">BB", order, 2)
        body = b"".join(sign(int(i)) for i in x[:order]) + sign(low)
    body += bytes(len(groups))  # the groups' references, all 0; widths and lengths take no bits
    body += bytes(int(i) for i in v)
    return _section(5, five), body


@pytest.mark.parametrize("order", [0, 1, 2])
def test_grib_complex_packing(order):
    x = np.array([[5, 9, 30, 31], [28, 20, 7, 4], [3, 8, 60, 61]])
    got = grib2.decoded(grib_message(x.astype(float), template=2, packed=complex_packing(x.reshape(-1), order)), "t")
    assert got.tolist() == x.tolist()


def test_grib_values_and_keys():
    x = np.array([[1.5, 2.0, 9.9], [4.0, 100.0, 3.3]])
    mask = np.array([[True, False, True], [True, True, True]])
    raw = grib_message(x, mask=mask)
    got = grib2.decoded(raw, "t2m")
    assert np.isnan(got[0, 1]) and np.allclose(got[mask], x[mask])
    assert grib2.decoded(raw, "latitude").tolist() == [10.0, 9.0] and grib2.decoded(raw, "longitude").tolist() == [20.0, 21.0, 22.0]
    k = grib2.keys(next(grib2.fields(raw)))
    assert (k["varname"], k["typeOfLevel"], k["level"], k["stepType"], k["step_s"]) == ("t2m", "heightAboveGround", 2.0, "instant", 3 * 3600)
    assert k["time"] == dt.datetime(2024, 1, 2, 6) and k["valid_time"] == dt.datetime(2024, 1, 2, 9)
    rain = grib2.keys(next(grib2.fields(grib_message(x, (1, 8), (1, 0), statistic=1))))
    assert (rain["varname"], rain["stepType"], rain["step_s"], rain["typeOfLevel"]) == ("tp", "accum", 6 * 3600, "surface")
    high = grib2.keys(next(grib2.fields(grib_message(x, (2, 2), (100, 50_000)))))
    assert (high["varname"], high["typeOfLevel"], high["level"]) == ("u", "isobaricInhPa", 500.0)
    with pytest.raises(grib2.Unsupported, match="data template 40"):
        grib2.decoded(raw.replace(struct.pack(">IHf", 5, 0, 10.0), struct.pack(">IHf", 5, 40, 10.0)), "t2m")


def test_grib_from_scan_to_cells(spark, tmp_path):
    x = np.arange(6, dtype=float).reshape(2, 3) + 1
    body = b"".join(grib_message(x + 10 * s + lev / 1000, (2, 2), (100, lev * 100), step=s) for s in (0, 3) for lev in (500, 850)) + grib_message(x, (9, 99))
    (tmp_path / "f.grib2").write_bytes(b"x" * 5 + body)
    m = scan.scan_grib(spark, str(tmp_path))
    assert [(r.varname, r.level, r.step_h) for r in m.orderBy("idx").collect()][:4] == [("u", 500.0, 0.0), ("u", 850.0, 0.0), ("u", 500.0, 3.0), ("u", 850.0, 3.0)]
    assert scan.scan_grib(spark, str(tmp_path), skip=2).count() == 2 and scan.scan_grib(spark, str(tmp_path), keep={"level": [500.0], "varname": "u"}).count() == 2
    refs = scan.scan_grib_refs(spark, str(tmp_path), inline_threshold=0)
    first = refs.filter("idx = 1").collect()
    assert {r.key for r in first} >= {".zgroup", ".zattrs", "u/.zarray", "u/0.0", "isobaricInhPa/0", "time/0", "step/0", "valid_time/0", "latitude/0", "longitude/0"}
    one = dataset.open_cells(refs.filter("idx = 3").select("key", "path", "offset", "size", "raw"), ["u", "latitude"])
    got = {(r.var, *r.position): r.value for r in one.collect()}
    assert got["u", 1, 2] == pytest.approx(x[1, 2] + 30.5, abs=0.051) and got["latitude", 0] == 10.0
