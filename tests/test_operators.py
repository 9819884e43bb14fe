import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import encoding, keys
from chunkloom.operators import combine, fmrc, idx, rewrite
from chunkloom.operators.fmrc import Aggregation

DAY = dt.datetime(2023, 9, 28)
#: (minutes of the run, minutes of each of its steps), one file family with quarter-hour steps.
RUNS = [(0, (0, 15, 30, 45, 60, 75, 90, 105, 120, 240)), (60, (0, 60, 180)), (120, (0, 15, 30, 45, 60, 75, 90, 105, 120)), (180, (0, 60)), (240, (0,))]


def k_index(spark, runs=RUNS, levels=(2.0,)):
    rows = [("u", "heightAboveGround", "instant", "wind", dt.timedelta(minutes=s), lev, DAY + dt.timedelta(minutes=r), f"f{r}.{s}", r * 1000 + s, 10, None) for r, steps in runs for s in steps for lev in levels]
    return spark.createDataFrame(rows, "varname string, typeOfLevel string, stepType string, name string, step interval day to second, level double, time timestamp_ntz, uri string, offset bigint, length bigint, inline_value string")


def steps(spark, minutes):
    return fmrc.axis(spark, "step", [dt.timedelta(minutes=m) for m in minutes])


def valid(spark, hours):
    return fmrc.axis(spark, "valid_time", [DAY + dt.timedelta(hours=h) for h in hours])


def brute(kind, runs, levels=1):
    have = {(r, s) for r, ss in runs for s in ss}
    cells = {
        Aggregation.HORIZON: [((h, v), v * 60 - s, s) for h, s in enumerate((0, 60)) for v in range(4)],
        Aggregation.VALID_TIME: [((v, k), t * 60 - s, s) for v, t in enumerate((2, 4)) for k, s in enumerate(range(0, 301, 60))],
        Aggregation.RUN_TIME: [((r, k), t * 60, s) for r, t in enumerate((0, 2)) for k, s in enumerate(range(0, 121, 15))],
        Aggregation.BEST_AVAILABLE: [((v,), min(v, 2) * 60, v * 60 - min(v, 2) * 60) for v in range(11)],
    }[kind]
    lev = [()] if levels == 1 else [(i,) for i in range(levels)]
    return sorted("u/instant/heightAboveGround/u/" + ".".join(map(str, (*i, *x, 0, 0))) for i, r, s in cells if (r, s) in have for x in lev)


@pytest.mark.parametrize("levels", [1, 3])
@pytest.mark.parametrize("kind", list(Aggregation))
def test_aggregations(spark, kind, levels):
    axes = {
        Aggregation.HORIZON: {"step": spark.createDataFrame([(0, 0, dt.timedelta(0)), (1, 0, dt.timedelta(hours=1))], "h int, step_no int, step interval day to second"), "valid_time": valid(spark, range(4))},
        Aggregation.VALID_TIME: {"step": steps(spark, range(0, 301, 60)), "valid_time": valid(spark, (2, 4))},
        Aggregation.RUN_TIME: {"step": steps(spark, range(0, 121, 15)), "time": fmrc.axis(spark, "time", [DAY, DAY + dt.timedelta(hours=2)])},
        Aggregation.BEST_AVAILABLE: {"valid_time": valid(spark, range(11))},
    }[kind]
    ref = DAY + dt.timedelta(hours=2) if kind is Aggregation.BEST_AVAILABLE else None
    got = fmrc.reinflate(k_index(spark, levels=tuple(map(float, range(levels)))), kind, axes, ref, check=True)
    assert sorted(r.key for r in got.collect()) == brute(kind, RUNS, levels)
    if kind is not Aggregation.BEST_AVAILABLE:
        return
    # The counts of the survey: 7 keys of which 2 are metadata.
    assert len(brute(kind, RUNS)) == 5


def test_aggregation_errors(spark):
    with pytest.raises(AssertionError, match="reference time"):
        fmrc.grid(Aggregation.BEST_AVAILABLE, {"valid_time": valid(spark, (0,))})
    twice = k_index(spark, RUNS[:1]).union(k_index(spark, RUNS[:1]))
    with pytest.raises(AssertionError, match="multiple values"):
        fmrc.reinflate(twice, Aggregation.RUN_TIME, {"step": steps(spark, (0,)), "time": fmrc.axis(spark, "time", [DAY])}, check=True)


def test_index_validation(spark):
    lines = spark.createDataFrame([("f", 0, "1:0:d=1:A:x:"), ("f", 1, "2:10:d=1:A:x:"), ("f", 2, " ")], "uri string, line_no int, value string")
    parsed = idx.parse_lines(lines)
    assert parsed.count() == 2
    with pytest.raises(ValueError, match="not unique"):
        idx.require_unique_attrs(parsed)
    sized = idx.message_lengths(parsed, spark.createDataFrame([("f", 25)], "uri string, file_size bigint"))
    assert [r.length for r in sized.orderBy("line_no").collect()] == [10, 15]
    msgs = spark.createDataFrame([(1, 0, 9, "a")], "idx int, offset bigint, length bigint, varname string")
    with pytest.raises(ValueError, match="disagree"):
        idx.grib_mapping(sized, msgs, validate=True)


@pytest.mark.parametrize(("concat", "dims", "keys_"), [(["t"], ["t", "x"], ["0.0", "1.0", "2.0", "3.0"]), (["r"], ["t", "x"], ["0.0.0", "0.1.0", "1.0.0", "1.1.0"])])
def test_rekey(spark, concat, dims, keys_):
    chunks = spark.createDataFrame([(d, "v", [i, 0]) for d in (0, 1) for i in (0, 1)], "ds_idx int, var string, index array<int>")
    coords = spark.createDataFrame([(d, concat[0], d * 4 + i if concat == ["t"] else d) for d in (0, 1) for i in range(4)], "ds_idx int, dim string, value int")
    out = combine.rekey(chunks, combine.dataset_ordinals(coords), dims, concat, {"t": 2})
    assert sorted(".".join(map(str, r["index"])) for r in out.collect()) == keys_


def test_selectors(spark):
    df = spark.createDataFrame([(1, "s3://b/file_42.nc", '{"k": "7", "units": "hours since 2000-01-01"}', 25.0)], "i int, u string, a string, x double")
    pick = lambda s: df.select(combine.selector(s, F.col("u"), F.col("i"), F.col("a"), F.lit("v"), F.col("x"))).first()[0]
    assert [pick(s) for s in ([10, 20], re.compile(r"_(\d+)"), re.compile(r"\d+"), 5, "VARNAME", "INDEX", "attr:k", "vattr:v:k", "data:v", "word")] == [20, "42", "3", 5, "v", 1, "7", "7", 25.0, "word"]
    assert pick("cf:v") == dt.datetime(2000, 1, 2, 1)
    assert pick(lambda ds_idx, **_: ds_idx + 1) == 2


def test_combine_checks(spark):
    a = spark.createDataFrame([(0, "v", [4, 3], [2, 3]), (1, "v", [3, 3], [2, 3]), (2, "v", [4, 3], [2, 3])], "ds_idx int, var string, shape array<bigint>, chunks array<bigint>")
    with pytest.raises(ValueError, match="boundary at index 1"):
        combine.check_concat(a, 0)
    with pytest.raises(ValueError, match="shape at index 1"):
        combine.check_concat(a, 1)
    odd = a.withColumn("chunks", F.when(F.col("ds_idx") == 2, F.array(F.lit(4), F.lit(3)).cast("array<bigint>")).otherwise(F.col("chunks")))
    with pytest.raises(ValueError, match="mismatch"):
        combine.require_equal_chunks(odd)
    with pytest.raises(ValueError, match="overlap"):
        combine.require_disjoint(["a"], ["a", "b"])
    moved = combine.concatenate(spark.createDataFrame([(0, [1, 0]), (2, [0, 0])], "ds_idx int, index array<int>"), a, 0)
    assert sorted(r["index"] for r in moved.collect()) == [[1, 0], [4, 0]]


def test_rewrites(spark):
    refs = spark.createDataFrame([("v/0", "zip://m::a.zip", 5, 2, None), ("v/1", "zip://m::a.zip", 0, 0, None), ("v/2", "plain", 1, 1, None)], "key string, path string, offset bigint, size bigint, raw binary")
    members = spark.createDataFrame([("a.zip", "m", 100, 13)], "archive string, member string, member_offset bigint, member_size bigint")
    assert sorted((r.path, r.offset, r.size) for r in rewrite.dereference_archives(refs, members).collect()) == [("a.zip", 100, 13), ("a.zip", 105, 2), ("plain", 1, 1)]
    chunks = spark.createDataFrame([([0, 0], 0, 800, None)], "index array<int>, offset bigint, size bigint, raw binary")
    parts = rewrite.subchunk(chunks, [10, 10], [10, 10], 5)
    assert sorted((r["index"][0], r.offset, r.size) for r in parts.collect()) == [(i, i * 160, 160) for i in range(5)]
    for bad in (dict(factor=3), dict(factor=5, compressed=True)):
        with pytest.raises(ValueError, match="subchunk"):
            rewrite.subchunk(chunks, [10, 10], [10, 10], **bad)
    with pytest.raises(ValueError, match="inlined"):
        rewrite.subchunk(chunks.withColumn("raw", F.lit(b"x")), [10, 10], [10, 10], 5)
    a = spark.createDataFrame([("x", [2], [1], 4)], "var string, shape array<bigint>, chunks array<bigint>, itemsize int")
    one = rewrite.inline_arrays(spark.createDataFrame([("x", [1], b"\2\0\0\0"), ("x", [0], b"\1\0\0\0")], "var string, index array<int>, raw binary"), a)
    assert one.first().raw == b"\1\0\0\0\2\0\0\0"


def test_encoding(spark):
    df = spark.createDataFrame([(b"abc", "a/b/.zarray"), (b"\xff\0", "c/0.1")], "raw binary, key string")
    assert [r[0] for r in df.select(encoding.encode_inline(F.col("raw"))).collect()] == ["abc", "base64:/wA="]
    assert [bytes(r[0]) for r in df.select(encoding.decode_inline(encoding.encode_inline(F.col("raw")))).collect()] == [b"abc", b"\xff\0"]
    assert [r[0] for r in df.select(keys.chunk_index(F.col("key"))).collect()] == [None, [0, 1]]
    fills = spark.createDataFrame([("nan", "f"), ("3", "i"), ("1", "b"), ("x", "U"), (None, "f"), ("-inf", "f"), ("2.5", "f")], "v string, k string")
    assert [r[0] for r in fills.select(encoding.encode_fill_value(F.col("v"), F.col("k"))).collect()] == ["NaN", "3", "true", "x", None, "-Infinity", "2.5"]
    assert df.select(encoding.big_endian(F.lit(b"\1\0"))).first()[0] == 256
    assert df.select(keys.nul_trim(F.lit("ab\0c"))).first()[0] == "ab"
