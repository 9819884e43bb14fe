"""Combining reference sets from end to end, read back as cells."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import calendars
from chunkloom.operators import multi
from chunkloom.operators.multi import append_references, combine_references
from chunkloom.sources import dataset, references


def array(var, a, chunks, dims, attrs=None, fill=None, raws=None):
    """Pairs of one array, its chunks inline or as given."""
    meta = {"zarr_format": 2, "shape": list(a.shape), "chunks": list(chunks), "dtype": a.dtype.str, "fill_value": fill, "order": "C", "compressor": None, "filters": None}
    out = [(f"{var}/.zarray", json.dumps(meta).encode()), (f"{var}/.zattrs", json.dumps((attrs or {}) | {"_ARRAY_DIMENSIONS": list(dims)}).encode())]
    grid = [-(-s // c) for s, c in zip(a.shape, chunks, strict=True)]
    for at in np.ndindex(*grid) if a.shape else [()]:
        block = np.zeros(chunks, a.dtype)
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        out.append((f"{var}/" + (".".join(map(str, at)) or "0"), block.tobytes()))
    return out


def inputs(spark, sets, folder=None):
    """References of several inputs; with a folder chunks of data arrays are ranges of its files."""
    rows = []
    for i, pairs in enumerate(sets):
        url, body = f"{folder or 's3://b'}/in_{i:03d}.nc", bytearray(b"head")
        pairs = [(".zgroup", b'{"zarr_format":2}'), (".zattrs", json.dumps({"title": f"set {i}", "run": 10 * i}).encode()), *pairs]
        for key, raw in pairs:
            if folder and "/.z" not in key and not key.startswith((".", "t/", "x/")):
                rows.append((i, url, key, url, len(body), len(raw), None))
                body += raw
            else:
                rows.append((i, url, key, None, None, None, raw))
        if folder:
            open(url, "wb").write(bytes(body))
    return spark.createDataFrame(rows, references.REFS)


def cells(refs, *names):
    return {(r.var, *r.position): r.value for r in dataset.open_cells(refs, list(names)).collect()}


def meta(refs, key):
    return json.loads(bytes(refs.filter(F.col("key") == key).first().raw))


X = np.array([1.0, 2.0, 3.0])


def day(k, n=2, var="data"):
    t = np.arange(k * n, k * n + n, dtype="<i4")
    a = (t[:, None] * 10 + np.arange(3)).astype("<f4") + 1
    return array("t", t, (n,), ["t"], {"units": "days"}) + array("x", X, (3,), ["x"]) + array(var, a, (1, 3), ["t", "x"], {"long_name": "d"}, "NaN")


def test_existing_dimension(spark, tmp_path):
    refs = inputs(spark, [day(2), day(0), day(1)], tmp_path)
    out = combine_references(refs, "t", inline_threshold=0)
    got = cells(out, "data", "t", "x")
    assert {k: v for k, v in got.items() if k[0] == "data"} == {("data", t, x): t * 10 + x + 1 for t in range(6) for x in range(3)}
    assert [got.get(("t", i)) for i in range(6)] == [0, 1, 2, 3, 4, 5] and [got["x", i] for i in range(3)] == [1, 2, 3]
    assert meta(out, "data/.zarray")["shape"] == [6, 3] and meta(out, "data/.zattrs") == {"long_name": "d", "_ARRAY_DIMENSIONS": ["t", "x"]}
    assert meta(out, "t/.zarray")["dtype"] == "<i4" and meta(out, "t/.zattrs") == {"units": "days", "_ARRAY_DIMENSIONS": ["t"]}
    assert meta(out, ".zattrs")["title"] == "set 0"
    rows = out.filter("path is not null").collect()
    assert len(rows) == 6 and all(r.size == 12 for r in rows)
    inline = combine_references(refs, "t", inline_threshold=500)
    assert not inline.filter("path is not null").count() and cells(inline, "data") == {k: v for k, v in got.items() if k[0] == "data"}


def test_chunks_of_several_values(spark):
    def one(k):
        t = np.arange(4 * k, 4 * k + 4)
        return array("t", t, (4,), ["t"]) + array("v", t.astype(float) + 1, (2,), ["t"], fill="NaN")

    out = combine_references(inputs(spark, [one(0), one(1), one(2)]), ["t"])
    assert cells(out, "v") == {("v", i): i + 1.0 for i in range(12)} and meta(out, "v/.zarray")["chunks"] == [2]


SELECTORS = [("INDEX", [0, 1, 2]), (re.compile(r"in_(\d+)"), ["000", "001", "002"]), (re.compile(r"00\d"), ["000", "001", "002"]), ("attr:run", [0, 10, 20]), ("vattr:data:rank", [5, 6, 7]), ([4, 9, 2], [4, 9, 2]), (lambda ds_idx, **_: ds_idx * 2 + 1, [1, 3, 5]), ("data:s", [3.5, 4.5, 5.5]), ("word", ["word"] * 3), (7, [7] * 3)]


def ranked(k):
    return array("x", X, (3,), ["x"]) + array("data", np.full(3, k + 1.0), (3,), ["x"], {"rank": 5 + k}, "NaN") + array("s", np.array(3.5 + k), (), [])


def test_selector_values(spark):
    refs = inputs(spark, [ranked(0), ranked(1), ranked(2)]).persist()
    k = references.with_keys(refs)
    arrays = multi.array_rows(k).persist()
    for spec, want in SELECTORS:
        axis = multi._axis("r", spec, k, arrays, refs.select("ds_idx", "ds_url").distinct(), [], None)
        assert [r.value for r in axis.values.orderBy("ds_idx").collect()] == want, spec


@pytest.mark.parametrize(("spec", "values"), [SELECTORS[5]])
def test_new_dimension_by_selector(spark, spec, values):
    out = combine_references(inputs(spark, [ranked(0), ranked(1), ranked(2)]), ["r"], {"r": spec})
    place = [sorted(spec).index(v) for v in spec] if isinstance(spec, list) else [0, 1, 2]
    assert cells(out, "data") == {("data", place[k], x): k + 1.0 for k in range(3) for x in range(3)}
    assert meta(out, "data/.zarray")["chunks"] == [1, 3] and meta(out, "data/.zattrs")["_ARRAY_DIMENSIONS"] == ["r", "x"]
    stored = dataset.open_texts(out, ["r"]) if isinstance(values[0], str) else dataset.open_cells(out, ["r"])
    assert [r.value for r in stored.orderBy("position").collect()] == sorted(values)


def test_two_dimensions_and_statics(spark):
    def one(t, s):
        return array("t", np.array([t]), (1,), ["t"]) + array("s", np.array([s * 0.5]), (1,), ["s"]) + array("x", X, (3,), ["x"]) + array("data", np.full((1, 1, 3), 10 * t + s + 1.0), (1, 1, 3), ["t", "s", "x"], fill="NaN") + array("flat", X + 0, (3,), ["x"], fill="NaN")

    sets = [one(t, s) for t in (3, 1) for s in (0, 2, 1)]
    out = combine_references(inputs(spark, sets), ["t", "s"], identical_dims=["flat"])
    assert cells(out, "data") == {("data", i, s, x): 10 * t + s + 1.0 for i, t in enumerate((1, 3)) for s in range(3) for x in range(3)}
    assert cells(out, "flat") == {("flat", i): v for i, v in enumerate(X)}
    assert np.frombuffer(bytes(out.filter("key = 's/0'").first().raw), "<f8").tolist() == [0.0, 0.5, 1.0]
    gained = combine_references(inputs(spark, sets), ["t", "s"])
    assert meta(gained, "flat/.zattrs")["_ARRAY_DIMENSIONS"] == ["t", "s", "x"]


def test_variable_names(spark):
    sets = [day(0, var="a"), day(0, var="b")]
    refs = inputs(spark, sets)
    out = combine_references(refs, ["var"], identical_dims=["t", "x"])
    assert meta(out, "a/.zarray")["shape"] == [2, 3] and ("b", 1, 2) in cells(out, "b")
    named = combine_references(refs, ["var"], {"var": re.compile(r"in_(\d+)")}, identical_dims=["t", "x"])
    assert {r.key for r in named.filter("key like '%.zarray'").collect()} == {"000/.zarray", "001/.zarray", "t/.zarray", "x/.zarray"}
    two = inputs(spark, [day(0, var="a") + array("q", X, (3,), ["x"])])
    with pytest.raises(Exception, match="Multiple varnames"):
        combine_references(two, ["var"], identical_dims=["t", "x"]).collect()


@pytest.mark.parametrize("calendar", ["standard"])
def test_times_in_different_units(spark, calendar):
    def one(start, unit, n):
        t = array("time", np.arange(n, dtype="<i8"), (n,), ["time"], {"units": f"{unit} since {start}", "calendar": calendar})
        return t + array("v", np.arange(1.0, n + 1), (1,), ["time"], fill="NaN")

    refs = inputs(spark, [one("2000-02-28", "days", 2), one("1999-12-30", "days", 2)])
    out = combine_references(refs, ["time"], {"time": "cf:time"})
    gap = {"standard": 60, "noleap": 60, "360_day": 58}[calendar]
    first = calendars.decode(np.array([0]), "days since 2000-02-28", calendar) - calendars.decode(np.array([0]), "days since 1999-12-30", calendar)
    assert first[0] == gap * 86400 * 10**6
    assert sorted(r.value for r in dataset.open_cells(out, ["time"]).collect()) == [-gap, -gap + 1, 0, 1]
    assert meta(out, "time/.zattrs") == {"units": "days since 2000-02-28", "calendar": calendar, "_ARRAY_DIMENSIONS": ["time"]}
    assert meta(out, "time/.zarray")["fill_value"] == 2**62
    assert cells(out, "v") == {("v", 0): 1.0, ("v", 1): 2.0, ("v", 2): 1.0, ("v", 3): 2.0}
    if calendar == "standard":
        dated = combine_references(refs, ["time"], {"time": "cf:time"}, coo_dtypes={"time": "M8[s]"})
        assert meta(dated, "time/.zarray")["dtype"] == "<M8[s]" and "units" not in meta(dated, "time/.zattrs")
        raw = bytes(dated.filter("key = 'time/0'").first().raw)
        assert np.frombuffer(raw, "<M8[s]")[0] == np.datetime64("1999-12-30")


def test_append(spark):
    old = combine_references(inputs(spark, [day(0), day(1)]), "t")
    out = append_references(old, inputs(spark, [day(2)]), "t")
    whole = combine_references(inputs(spark, [day(0), day(1), day(2)]), "t")
    assert cells(out, "data", "t") == cells(whole, "data", "t") and meta(out, "data/.zarray") == meta(whole, "data/.zarray")
    late = combine_references(inputs(spark, [day(1), day(2)]), "t")
    with pytest.raises(ValueError, match="sort before"):
        append_references(late, inputs(spark, [day(0)]), "t")


def test_hooks_and_errors(spark):
    refs = inputs(spark, [day(0), day(1)])
    out = combine_references(refs, "t", preprocess=lambda d: d.filter("not startswith(key, 'x/')"), postprocess=lambda d: d.withColumn("key", F.concat(F.lit("g/"), "key")))
    names = {r.key for r in out.select("key").collect()}
    assert "g/data/0.0" in names and not any(k.startswith("g/x/") for k in names)
    with pytest.raises(ValueError, match="overlap"):
        combine_references(refs, "t", identical_dims=["t"])
    odd = inputs(spark, [day(0), array("t", np.arange(2) + 2, (2,), ["t"]) + array("data", np.zeros((2, 3), "<f4"), (2, 3), ["t", "x"])])
    with pytest.raises(ValueError, match="mismatch"):
        combine_references(odd, "t")
    with pytest.warns(UserWarning, match="less than expected"):
        combine_references(inputs(spark, [array("q", np.zeros(2), (2,), ["x"])]), ["r"], {"r": 5})


def test_through_files(spark, tmp_path):
    """JSON sets in, a combined JSON set and record files out, and back."""
    for i in range(2):
        refs = inputs(spark, [day(i)])
        references.write_json(refs.select("key", "path", "offset", "size", "raw"), str(tmp_path / f"in{i}.json"))
    out = combine_references(references.read_json(spark, str(tmp_path / "in*.json")), "t")
    references.write_json(out, str(tmp_path / "all.json"))
    back = references.read_json(spark, str(tmp_path / "all.json"))
    assert cells(back, "data", "t", "x") == cells(out, "data", "t", "x")
    arrays = dataset.array_metadata(out).select("var", F.from_json("meta", "shape array<bigint>, chunks array<bigint>").alias("m")).select("var", "m.*")
    references.write_parquet(out, arrays, str(tmp_path / "rec"), record_size=3)
    again = references.read_parquet(spark, str(tmp_path / "rec"))
    assert cells(again.select("key", "path", "offset", "size", "raw"), "data", "t") == cells(out, "data", "t")


def test_calendars():
    for name in calendars.CALENDARS:
        for days in (-800_000, -1, 0, 59, 60, 365, 366, 11_016, 200_000):
            assert calendars.day_number(*calendars.date_of(days, name), name) == days
    at = lambda v, u, c=None: calendars.iso(calendars.decode(np.array([v]), u, c)[0], c)
    assert at(1, "days since 1582-10-04") == "1582-10-15T00:00:00" and at(1, "days since 1582-10-04", "proleptic_gregorian") == "1582-10-05T00:00:00"
    assert at(60, "days since 2000-01-01", "noleap") == "2000-03-02T00:00:00"
    assert at(2, "months since 2000-01-01", "360_day") == "2000-03-01T00:00:00"
    assert at(1.5, "hours since 2000-01-01T00:00:00+01:00") == "2000-01-01T00:30:00" and at(250, "msec since 1970-01-01") == "1970-01-01T00:00:00.250000"
    assert calendars.is_time_unit("days since 1970") and not calendars.is_time_unit("days") and not calendars.is_time_unit(None)
    for bad in ("fortnights since 2000-01-01", "months since 2000-01-01", "days after 2000"):
        with pytest.raises(ValueError):
            calendars.parse_units(bad, "standard")
    m = calendars.decode(np.array([0.25, 3]), "days since 2000-01-01")
    assert calendars.encode(m, "hours since 2000-01-01").tolist() == [6, 72] and calendars.encode(m, "days since 2000-01-01").tolist() == [0.25, 3.0]


def test_calendar_column(spark):
    df = spark.createDataFrame([(1.0, "days since 2000-02-28", "noleap"), (None, "days since 2000-02-28", None), (1.0, "days since 2000-02-28", None)], "v double, u string, c string")
    assert [r[0] for r in df.select(calendars.cf_text(F.col("v"), F.col("u"), F.col("c"))).collect()] == ["2000-03-01T00:00:00", None, "2000-02-29T00:00:00"]
