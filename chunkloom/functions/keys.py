"""Column functions over chunk keys, paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinate names of a GRIB message that keep their name; every other one is a level. Fixed values.
GRIB_COORDS = ("time", "step", "valid_time", "latitude", "longitude")

#: A data chunk's key: anything, a slash, then dotted numbers.
CHUNK_KEY = r"^(.*)/([0-9]+[0-9.]*)$"


def is_meta(key: Column) -> Column:
    """Whether the last part of a key is metadata (starts with ``.z``); other parts don't matter."""
    return F.element_at(F.split(key, "/"), -1).startswith(".z")


def variable_of(key: Column) -> Column:
    """The part of a key before its last slash; empty for a root key."""
    return F.regexp_extract(key, r"^(.*)/[^/]*$", 1)


def chunk_index(key: Column) -> Column:
    """The integers of a chunk key's last part, or null for metadata."""
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(last.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.split(last, r"\.").cast("array<int>"))


def chunk_key(var: Column, index: Column) -> Column:
    return F.concat(var, F.lit("/"), F.array_join(index.cast("array<string>"), "."))


def build_path(*parts: Column) -> Column:
    """Non-null parts joined by slashes, without leading slashes."""
    return F.ltrim(F.concat_ws("/", *parts), F.lit("/"))


def grib_coord(name: Column) -> Column:
    return F.when(name.isin(*GRIB_COORDS), name).otherwise("level")


def nul_trim(c: Column) -> Column:
    """A string up to its first NUL."""
    return F.substring_index(c, "\0", 1)


def top_name(key: Column) -> Column:
    """The first part of a nested key."""
    return F.split_part(key, F.lit("/"), F.lit(1))


def c_order(index: Column, grid: Column) -> Column:
    """Number of a chunk in C order over a grid of chunk counts."""
    return F.aggregate(F.zip_with(index.cast("array<bigint>"), grid.cast("array<bigint>"), lambda i, g: F.struct(i.alias("i"), g.alias("g"))), F.lit(0).cast("bigint"), lambda a, x: a * x["g"] + x["i"])


def nbytes(shape: Column, itemsize: Column) -> Column:
    return F.aggregate(shape.cast("array<bigint>"), itemsize.cast("bigint"), lambda a, x: a * x)


def grid_of(shape: Column, chunks: Column) -> Column:
    """Chunks along each axis."""
    return F.zip_with(shape.cast("array<bigint>"), chunks.cast("array<bigint>"), lambda s, c: F.floor((s + c - 1) / c).cast("bigint"))
