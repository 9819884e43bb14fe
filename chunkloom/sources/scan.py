"""Scanning files into reference rows: one task per file, no shuffle.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.sources import binary, grib2, hdf4, hdf5
from chunkloom.sources.ranges import BATCH_BYTES, BY_POSITION, fill_raw, opened, scheme

#: Formats with the parser of each and its default inline threshold.
FORMATS: dict[str, tuple[Callable, int]] = {"netcdf3": (binary.netcdf3, 100), "fits": (binary.fits, 100), "tiff": (binary.tiff, 0), "hdf5": (hdf5.hdf5, 500), "hdf4": (hdf4.hdf4, 100)}

ROWS = "ds_url string, key string, path string, offset bigint, size bigint, raw binary, error string"
ROWS_IN_BATCH = 20_000


def _files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def _each(spark: SparkSession, path: str | list[str], glob: str | None, read: Callable, schema: str) -> DataFrame:
    """Rows that ``read(url, data)`` yields for each file.

    Only the ranges that a parser asks for are read, where the store can be read by position;
    from others whole files come through Spark (2 GB at most, in one task's memory).
    """
    first = path if isinstance(path, str) else path[0]
    whole = scheme(first) not in BY_POSITION
    fields = pa.schema([(n.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}[n.split()[1]]) for n in schema.split(", ")])

    def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for row in rows:
            part.append(row)
            size += sum(len(v) for v in row if isinstance(v, bytes))
            if len(part) >= ROWS_IN_BATCH or size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), fields, strict=True)], schema=fields)
                part, size = [], 0
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), fields, strict=True)], schema=fields)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            for i, url in enumerate(b.column(0).to_pylist()):
                if whole:
                    yield from batches(read(url, b.column(1)[i].as_py()))
                else:
                    with opened(url) as data:
                        yield from batches(read(url, data))

    f = _files(spark, path, glob)
    return (f.select("path", "content") if whole else f.select("path")).mapInArrow(run, schema)


def scan(spark: SparkSession, path: str | list[str], kind: str, inline_threshold: int | None = None, glob: str | None = None, error: str = "raise", **options) -> DataFrame:
    """References of files of one format.

    Chunks below the threshold are inline. error: 'raise', or 'row' for one row with the message
    where a file can't be read.
    """
    parse, default = FORMATS[kind]
    limit = default if inline_threshold is None else inline_threshold

    def read(url: str, data) -> Iterator[tuple]:
        rows = []
        try:
            for key, v in parse(data, **options):
                if isinstance(v, bytes):
                    rows.append((url, key, None, None, None, v, None))
                elif v[1] < limit:
                    rows.append((url, key, None, None, None, bytes(data[v[0] : v[0] + v[1]]), None))
                else:
                    rows.append((url, key, url, v[0], v[1], None, None))
        except Exception as e:
            if error == "raise":
                raise
            rows = [(url, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        yield from rows

    return _each(spark, path, glob, read, ROWS)


MESSAGES = "uri string, idx int, field int, offset bigint, length bigint, edition int, discipline int, centre int, varname string, shortName string, name string, units string, stepType string, typeOfLevel string, level double, time_s bigint, step_s bigint, gridType string, Nx int, Ny int, packing int"


def scan_grib(spark: SparkSession, path: str | list[str], skip: int = 0, keep: dict[str, object] | None = None, glob: str | None = None) -> DataFrame:
    """A row of keys for each field of each message: MESSAGES, with time, step (an interval), step_h and valid_time.

    keep: as ``message_filter`` has it, on the keys that the messages hold.
    """

    def read(url: str, data) -> Iterator[tuple]:
        for n, field, offset, size, k in grib2.messages(data, skip, keep):
            yield url, n, field, offset, size, 2, k["discipline"], k["centre"], k["varname"], k["shortName"], k["name"], k["units"], k["stepType"], k["typeOfLevel"], k["level"], grib2.seconds(k["time"]), k["step_s"], k["gridType"], k["Nx"], k["Ny"], k["packing"]

    m = _each(spark, path, glob, read, MESSAGES)
    time = F.timestamp_seconds("time_s").cast("timestamp_ntz") if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("time_s").cast("decimal(18,6)"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("step_s").cast("decimal(18,6)"))
    m = m.withColumns({"time": time, "step": step, "step_h": F.col("step_s") / 3600})
    return m.withColumn("valid_time", F.col("time") + F.col("step")).drop("time_s", "step_s")


def scan_grib_refs(spark: SparkSession, path: str | list[str], inline_threshold: int = 100, skip: int = 0, keep: dict[str, object] | None = None, glob: str | None = None) -> DataFrame:
    """References of each field of each message, a dataset of its own: (uri, idx, field, key, path, offset, size, raw)."""

    def read(url: str, data) -> Iterator[tuple]:
        for n, field, offset, size, k in grib2.messages(data, skip, keep):
            for key, v in grib2.message_pairs(k, field, offset, size):
                if isinstance(v, bytes):
                    yield url, n, field, key, None, None, None, v
                elif k["Nx"] * k["Ny"] * 8 < inline_threshold:
                    yield url, n, field, key, None, None, None, bytes(data[offset : offset + size])
                else:
                    yield url, n, field, key, url, v[0], v[1], None

    return _each(spark, path, glob, read, "uri string, idx int, field int, key string, path string, offset bigint, size bigint, raw binary")


def scan_hdf4(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(uri, tag, ref, offset, length, extended) of each data descriptor."""

    def read(url: str, data) -> Iterator[tuple]:
        for d in hdf4.descriptors(data):
            yield url, *d

    return _each(spark, path, glob, read, "uri string, tag int, ref int, offset bigint, length bigint, extended boolean")


def archive_members(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(archive, member, member_offset, member_size, method) of zip and tar files."""

    def read(url: str, data) -> Iterator[tuple]:
        for m in binary.archive_members(data, url):
            yield url, *m

    return _each(spark, path, glob, read, "archive string, member string, member_offset bigint, member_size bigint, method int")


def _hidden_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(key, raw) of the ``.z*`` files: listed level by level on the driver, read by tasks where the store can be read by position."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    top = hadoop(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    names, below = [], ""
    while found := fs.globStatus(hadoop(f"{root}{below}/.z*")):
        names += [status.getPath().toUri().getPath()[len(base) + 1 :] for status in found]
        below += "/*"
    shape = "key string, path string, offset bigint, size bigint, raw binary"
    if scheme(root) in BY_POSITION:
        return fill_raw(spark.createDataFrame([(n, f"{root}/{n}", 0, 0, None) for n in names], shape)).select("key", "raw")

    def whole(n: str) -> bytearray:
        stream = fs.open(hadoop(f"{root}/{n}"))
        try:
            return bytearray(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    return spark.createDataFrame([(n, None, None, None, whole(n)) for n in names], shape).select("key", "raw")


def scan_zarr2(spark: SparkSession, root: str, inline: tuple[str, ...] = ()) -> DataFrame:
    """References of a stored version 2 group: metadata inline, every other key its file.

    Names that Spark's listings hide (``.z*``) are found by one listing a level; their bytes are
    read by tasks.
    """
    root = root.rstrip("/")
    meta = _hidden_metadata(spark, root)
    head = meta.filter("key = '.zgroup'").limit(1).collect()
    if not head or json.loads(bytes(head[0]["raw"])).get("zarr_format") != 2:
        raise ValueError("Failed to load dataset as V2 zarr")
    f = _files(spark, root)
    name = root.split("://", 1)[-1]
    key = F.expr(f"substring(path, instr(path, '{name}') + {len(name) + 1})")
    keep = F.element_at(F.split("path", "/"), -1).isin(list(inline))
    out = f.select(F.lit(root).alias("ds_url"), key.alias("key"), F.when(~keep, F.col("path")).alias("path"), F.when(~keep, 0).cast("bigint").alias("offset"), F.when(~keep, 0).cast("bigint").alias("size"), F.when(keep, F.col("content")).alias("raw"))
    none = F.lit(None)
    return out.union(meta.select(F.lit(root), "key", none.cast("string"), none.cast("bigint"), none.cast("bigint"), "raw"))


def read_index_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(uri, line_no, value) of text index files; lines keep their order."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return t.filter(F.trim("value") != "")


def file_sizes(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(uri, file_size) from the listing; contents are not read."""
    return _files(spark, path, glob).select(F.col("path").alias("uri"), F.col("length").alias("file_size"))
