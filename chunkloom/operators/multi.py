"""Combining reference sets into one: from the references of many inputs to those of one dataset.

``combine_references`` takes rows (ds_idx, ds_url, key, path, offset, size, raw), finds the
coordinate values of every input, numbers the distinct ones, moves every chunk to its place among
them and writes the metadata and the coordinate arrays of the result. Rows stay a DataFrame from end
to end; the driver reads a type, a count and a unit for each coordinate. Metadata rows, coordinate
values and their numbers, which are few beside chunks, are checkpointed, so that plans stay short.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import calendars
from chunkloom.functions.codecs import decode_chunk, encode_chunk, trimmed
from chunkloom.functions.encoding import edited_json
from chunkloom.operators.combine import chunk_mismatch, number_values, require_disjoint
from chunkloom.operators.settle import settled
from chunkloom.sources.ranges import fill_raw
from chunkloom.sources.references import with_keys

#: Names of dimensions for arrays that name none. Fixed values.
UNNAMED = ("i", "k", "j", "l", "m")
#: Values in one chunk of a coordinate array; longer axes have several.
AXIS_CHUNK = 1 << 20
#: Coordinate arrays of more values are compressed.
PLAIN_VALUES = 100
#: The fill value of encoded times. Fixed value.
TIME_FILL = 2**62
OUT = ["key", "path", "offset", "size", "raw"]

_SQL_TYPES = {"i": "bigint", "u": "bigint", "b": "bigint", "m": "bigint", "M": "bigint", "f": "double", "S": "string", "U": "string", "O": "string"}


def array_rows(k: DataFrame) -> DataFrame:
    """(ds_idx, var, zarray, zattrs, shape, chunks, dims) of the arrays among references with keys."""
    name = F.element_at(F.split("key", "/"), -1)
    text = F.col("raw").cast("string")
    a = k.filter(name == ".zarray").select("ds_idx", "var", text.alias("zarray"))
    t = k.filter(name == ".zattrs").select("ds_idx", "var", text.alias("zattrs"))
    j = a.join(t, ["ds_idx", "var"], "left").withColumn("zattrs", F.coalesce("zattrs", F.lit("{}")))
    meta = F.parse_json("zarray")
    j = j.withColumns({"shape": F.try_variant_get(meta, "$.shape", "array<bigint>"), "chunks": F.try_variant_get(meta, "$.chunks", "array<bigint>")})
    named = F.try_variant_get(F.parse_json("zattrs"), "$._ARRAY_DIMENSIONS", "array<string>")
    letters = F.slice(F.array(*map(F.lit, UNNAMED)), F.lit(1), F.size("shape"))
    return j.withColumn("dims", F.when(F.size(F.coalesce(named, F.array())) > 0, named).when(F.size("shape") > 0, letters).otherwise(F.array().cast("array<string>")))


def _decoded(chunks: DataFrame, kind: str, time: bool) -> DataFrame:
    """(ds_idx, value) of chunks(ds_idx, index, zarray, zattrs, raw)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ds_idx, index, zarray, zattrs, raw in zip(b["ds_idx"], b["index"], b["zarray"], b["zattrs"], b["raw"], strict=True):
                meta = json.loads(zarray)
                v = trimmed(decode_chunk(bytes(raw), meta), meta, index).reshape(-1)
                if time:
                    attrs = json.loads(zattrs)
                    v = calendars.decode(v, attrs.get("units"), attrs.get("calendar"))
                elif kind == "string":
                    v = [x.decode("utf-8", "replace").rstrip("\0") if isinstance(x, bytes) else str(x) for x in v]
                yield pd.DataFrame({"ds_idx": ds_idx, "value": v if kind == "string" else np.asarray(v).astype(np.int64 if kind == "bigint" else np.float64)})

    return chunks.select("ds_idx", "index", "zarray", "zattrs", "raw").mapInPandas(run, f"ds_idx int, value {kind}")


def _typed(text: Column, frame: DataFrame, dtype: str | None) -> tuple[Column, str]:
    """A JSON value's text as a number if the first one is (or ``dtype`` says so), else as text."""
    if dtype is None:
        first = frame.select(text.alias("t")).filter("t is not null").limit(1).collect()
        sample = first[0]["t"] if first else ""
        dtype = "<i8" if re.fullmatch(r"-?\d+", sample) else "<f8" if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", sample) else "<U"
    kind = _SQL_TYPES[np.dtype(dtype).kind]
    return text.cast(kind), kind


class Axis:
    """One coordinate of the result: the values of each input, the distinct ones, and how they are stored."""

    def __init__(self, name: str, values: DataFrame, dtype: str, units: dict | None = None):
        self.name, self.values, self.dtype, self.units = name, values, dtype, units
        self.extra: DataFrame | None = None

    def numbered(self) -> DataFrame:
        """(value, ord) of all distinct values in order."""
        v = self.values.select("value")
        if self.extra is not None:
            v = v.union(self.extra)
        return number_values(v)


def _axis(name: str, spec: Any, k: DataFrame, arrays: DataFrame, inputs: DataFrame, skip: list[str], dtype: str | None) -> Axis:
    """The values of one selector for every input. See ``combine_references``."""
    if isinstance(spec, str) and spec.split(":", 1)[0] in ("data", "cf") and ":" in spec:
        time, var = spec.startswith("cf:"), spec.split(":", 1)[1]
        mine = arrays.filter(F.col("var") == var)
        first = mine.orderBy("ds_idx").limit(1).collect()
        if not first:
            raise ValueError(f"no input has an array {var}")
        stored = np.dtype(json.loads(first[0]["zarray"])["dtype"])
        units = None
        if time:
            attrs = json.loads(first[0]["zattrs"])
            units = {"units": attrs.get("units"), "calendar": attrs.get("calendar", "standard")}
        kind = "bigint" if time else _SQL_TYPES[np.dtype(dtype or stored).kind]
        chunks = k.filter((F.col("var") == var) & F.col("index").isNotNull())
        chunks = fill_raw(chunks.select("ds_idx", "index", "path", "offset", "size", "raw")).join(mine.select("ds_idx", "zarray", "zattrs"), "ds_idx")
        native = dtype or ("<M8[us]" if time else stored.newbyteorder("<").str)
        return Axis(name, _decoded(chunks, kind, time), native, units)
    if isinstance(spec, str) and spec == "VARNAME":
        own = arrays.filter(~F.col("var").isin([*skip, ""])).groupBy("ds_idx").agg(F.min("var").alias("value"), F.countDistinct("var").alias("n"))
        bad = F.raise_error("Multiple varnames found in dataset, please provide a more specific selector").cast("string")
        return Axis(name, own.select("ds_idx", F.when(F.col("n") > 1, bad).otherwise(F.col("value")).alias("value")), "<U")
    if isinstance(spec, str) and spec.startswith(("attr:", "vattr:")):
        _, *where = spec.split(":", 2)
        var, item = ("", where[0] if len(where) == 1 else ":".join(where)) if spec.startswith("attr:") else where
        rows = k.filter((F.col("key") == ((f"{var}/" if var else "") + ".zattrs"))).select("ds_idx", F.get_json_object(F.col("raw").cast("string"), f"$['{item}']").alias("text"))
        value, kind = _typed(F.col("text"), rows, dtype)
        return Axis(name, rows.select("ds_idx", value.alias("value")), dtype or {"bigint": "<i8", "double": "<f8", "string": "<U"}[kind])
    if isinstance(spec, re.Pattern):
        found = F.regexp_extract("ds_url", spec.pattern, 1 if spec.groups else 0)
        return Axis(name, inputs.select("ds_idx", found.cast(_SQL_TYPES[np.dtype(dtype or "<U").kind]).alias("value")), dtype or "<U")
    if callable(spec):
        value = spec(ds_idx=F.col("ds_idx"), url=F.col("ds_url"), var=F.lit(name))
        own = inputs.select("ds_idx", value.alias("value"))
        found = own.schema["value"].dataType.simpleString()
        dtype = dtype or ("<U" if found == "string" else "<f8" if found in ("double", "float") or found.startswith("decimal") else "<i8")
        return Axis(name, own.withColumn("value", F.col("value").cast(_SQL_TYPES[np.dtype(dtype).kind])), dtype)
    if isinstance(spec, list):
        dtype = dtype or np.asarray(spec).dtype.str
        kind = _SQL_TYPES[np.dtype(dtype).kind]
        known = inputs.sparkSession.createDataFrame([(i, np.asarray(v).astype(dtype).item() if kind != "string" else str(v)) for i, v in enumerate(spec)], f"ds_idx int, value {kind}")
        return Axis(name, inputs.select("ds_idx").join(known, "ds_idx"), dtype)
    if isinstance(spec, str) and spec == "INDEX":
        return Axis(name, inputs.select("ds_idx", F.col("ds_idx").cast("bigint").alias("value")), dtype or "<i8")
    dtype = dtype or np.asarray(spec).dtype.str
    return Axis(name, inputs.select("ds_idx", F.lit(spec).cast(_SQL_TYPES[np.dtype(dtype).kind]).alias("value")), dtype)


def _stored_axis(axis: Axis, numbered: DataFrame, n: int, first_meta: dict | None, first_attrs: dict | None) -> DataFrame:
    """References (all inline) of one coordinate array."""
    spark = numbered.sparkSession
    dtype, fill, attrs = np.dtype(axis.dtype), None, dict(first_attrs or {})
    encoded = axis.units if axis.units and axis.dtype == "<M8[us]" else None
    if encoded:
        size, epoch = calendars.parse_units(encoded["units"], calendars.calendar_name(encoded["calendar"]))
        whole = numbered.agg(F.coalesce(F.max(F.pmod(F.col("value") - F.lit(epoch), F.lit(int(size)))), F.lit(0))).first()[0] == 0
        dtype, fill = np.dtype("<i8" if whole else "<f8"), TIME_FILL
        attrs.update(encoded)
    elif axis.units:
        attrs.pop("units", None)
        attrs.pop("calendar", None)
    elif dtype.kind == "U" or dtype.kind == "S" or dtype.kind == "O":
        longest = numbered.agg(F.coalesce(F.max(F.char_length("value")), F.lit(1))).first()[0]
        dtype = np.dtype(f"<U{max(1, longest)}")
        fill = ""
    elif dtype.kind == "f":
        fill = (first_meta or {}).get("fill_value", 0.0)
    compressor = {"id": "zstd", "level": 1} if n > PLAIN_VALUES else None
    chunk = max(1, min(n, AXIS_CHUNK))
    meta = {"chunks": [chunk], "compressor": compressor, "dtype": dtype.str, "fill_value": fill, "filters": None, "order": "C", "shape": [n], "zarr_format": 2}
    attrs["_ARRAY_DIMENSIONS"] = [axis.name]

    name, dated = axis.name, bool(axis.units) and dtype.kind == "M"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ord")["value"].to_numpy()
        if encoded:
            v = calendars.encode(v.astype(np.int64), encoded["units"], encoded["calendar"])
        elif dated:
            v = v.astype("M8[us]")
        a = np.zeros(chunk, dtype)
        a[: len(v)] = v.astype(dtype)
        return pd.DataFrame({"key": [f"{name}/{int(key[0])}"], "raw": [encode_chunk(a, meta)]})

    body = numbered.withColumn("part", F.expr(f"cast(ord div {chunk} as int)")).groupBy("part").applyInPandas(run, "key string, raw binary")
    head = [(f"{axis.name}/.zarray", bytearray(json.dumps(meta, separators=(",", ":"), sort_keys=True).encode())), (f"{axis.name}/.zattrs", bytearray(json.dumps(attrs, separators=(",", ":"), sort_keys=True).encode()))]
    none = F.lit(None)
    rows = body.union(spark.createDataFrame(head, "key string, raw binary"))
    return rows.select("key", none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), "raw")


def combine_references(
    refs: DataFrame,
    concat_dims: str | list[str] | None = None,
    coo_map: dict[str, Any] | None = None,
    coo_dtypes: dict[str, str] | None = None,
    identical_dims: list[str] | tuple[str, ...] = (),
    inline_threshold: int = 500,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
    postprocess: Callable[[DataFrame], DataFrame] | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """(key, path, offset, size, raw) of the dataset that all inputs make up.

    concat_dims: the coordinates along which inputs are placed. coo_map: where each one's values come
    from; ``data:name`` by default. A selector is a constant, a list by input, a compiled pattern on the
    input's url, ``INDEX``, ``VARNAME``, ``attr:x``, ``vattr:v:x``, ``data:v``, ``cf:v`` (times, which
    are stored in the first input's units, or as dates if the coordinate's dtype is a date's), or a
    function from the columns ds_idx, url and var to one. The key ``var`` names each input's output
    variable. identical_dims are taken from the first input that has them, and so are the other
    coordinates of the first input. Ranges of fewer bytes than inline_threshold become inline.
    existing is an earlier result, to which the inputs are added (see ``append_references``).
    """
    concat = [concat_dims] if isinstance(concat_dims, str) else list(coo_map or {}) if concat_dims is None else list(concat_dims)
    coo_map = dict(coo_map or {})
    coo_map |= {c: "VARNAME" if c == "var" else f"data:{c}" for c in concat if c not in coo_map}
    require_disjoint(list(coo_map), list(identical_dims))
    dtypes = coo_dtypes or {}
    if preprocess is not None:
        refs = preprocess(refs)
    k = with_keys(refs)
    inputs = refs.select("ds_idx", "ds_url").distinct()
    # Read several times below: metadata rows, coordinate values and their numbers, which are few beside chunks.
    arrays = settled(array_rows(k))
    skip = [*concat, *identical_dims]
    axes = {c: _axis(c, spec, k, arrays, inputs, skip, dtypes.get(c)) for c, spec in coo_map.items()}
    for a in axes.values():
        a.values = settled(a.values)
    names = axes.pop("var").values.select("ds_idx", F.col("value").alias("name")) if "var" in axes else None
    axes = {c: a for c, a in axes.items() if c in concat}
    old = None
    if existing is not None:
        existing = settled(existing.select(OUT))
        old = with_keys(existing.withColumn("ds_idx", F.lit(-1)).withColumn("ds_url", F.lit(None).cast("string")))
        for c, a in axes.items():
            a.extra = settled(_axis(c, f"cf:{c}" if a.units else f"data:{c}", old, array_rows(old), old.select("ds_idx", "ds_url").distinct(), [], a.dtype if not a.units else None).values.select("value"))

    # Numbers of the distinct values, and where each input starts.
    numbered = {c: settled(a.numbered()) for c, a in axes.items()}
    sizes: dict[str, int] = {}
    starts = None
    for c, a in axes.items():
        sizes[c] = numbered[c].agg(F.count("*")).first()[0]
        if sizes[c] < 2:
            warnings.warn(f"Concatenated coordinate '{c}' contains less than expected number of values across the datasets", stacklevel=2)
        low = a.values.groupBy("ds_idx").agg(F.min("value").alias("value")).join(numbered[c], "value").select("ds_idx", F.lit(c).alias("dim"), "ord")
        starts = low if starts is None else starts.union(low)
    if existing is not None:
        _require_old_places(axes, numbered)
    none = F.lit(None)
    if starts is None:
        starts = inputs.select("ds_idx", F.lit("").alias("dim"), F.lit(0).alias("ord"))
    places = settled(starts.groupBy("ds_idx").agg(F.map_from_entries(F.collect_list(F.struct("dim", "ord"))).alias("place")))  # one row an input

    # What is copied, and what is moved.
    lowest = arrays.agg(F.min("ds_idx").alias("ds_idx"))
    deps = arrays.join(lowest, "ds_idx", "left_semi").filter(~F.col("var").contains("/")).select(F.explode("dims").alias("var")).distinct()
    given = spark_list(arrays, list(identical_dims))
    once = deps.union(given).distinct().join(spark_list(arrays, list(coo_map)), "var", "left_anti")
    of_array = k.join(arrays.select("ds_idx", "var"), ["ds_idx", "var"], "left_semi")
    first_of = arrays.join(once, "var", "left_semi").groupBy("var").agg(F.min("ds_idx").alias("ds_idx"))
    copied = of_array.join(first_of, ["ds_idx", "var"], "left_semi").select(OUT)
    moved = arrays.join(once, "var", "left_anti").join(spark_list(arrays, list(coo_map)), "var", "left_anti")
    bad = chunk_mismatch(moved).limit(1).collect()
    if bad:
        raise ValueError(f"Found chunk size mismatch in {bad[0]['var']}")
    moved = moved.join(names, "ds_idx") if names is not None else moved.withColumn("name", F.col("var"))
    new_dims = F.array(*[F.lit(c) for c in concat if c != "var"]).cast("array<string>")
    moved = moved.withColumn("order", F.concat(F.array_except(new_dims, "dims"), "dims"))
    inside = lambda c: F.array_contains(F.col("dims"), c)
    place_in = lambda xs, c: F.get(F.col(xs), (F.array_position(F.col("dims"), c) - 1).cast("int"))
    size_of = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(n).cast("bigint"))]) if sizes else F.create_map().cast("map<string,bigint>")
    moved = moved.withColumns(
        {
            "new_shape": F.transform("order", lambda c: F.coalesce(F.try_element_at(size_of, c), place_in("shape", c))),
            "new_chunks": F.transform("order", lambda c: F.when(inside(c), place_in("chunks", c)).otherwise(F.lit(1).cast("bigint"))),
        }
    )
    moved = settled(moved)
    first = moved.groupBy("name").agg(F.min_by(F.struct("zarray", "zattrs", "order", "new_shape", "new_chunks"), F.struct("ds_idx", "var")).alias("m")).select("name", "m.*")
    heads = first.select("name", F.explode(F.array(F.struct(F.lit(".zarray").alias("file"), edited_json(F.col("zarray"), shape=F.col("new_shape"), chunks=F.col("new_chunks")).alias("text")), F.struct(F.lit(".zattrs").alias("file"), edited_json(F.col("zattrs"), _ARRAY_DIMENSIONS=F.col("order")).alias("text")))).alias("f"))
    heads = heads.select(F.concat("name", F.lit("/"), "f.file").alias("key"), none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), F.encode("f.text", "UTF-8").alias("raw"))

    chunks = k.filter("index is not null").join(moved.select("ds_idx", "var", "name", "dims", "order"), ["ds_idx", "var"])
    chunks = chunks.join(first.select("name", F.col("new_chunks").alias("per")), "name").join(places, "ds_idx")

    def at(c: Column, i: Column) -> Column:
        start = F.coalesce(F.try_element_at(F.col("place"), c).cast("bigint"), F.lit(0).cast("bigint"))
        own = F.when(inside(c), F.get(F.col("index"), (F.array_position(F.col("dims"), c) - 1).cast("int"))).otherwise(F.lit(0))
        return F.floor(start / F.get(F.col("per"), i)).cast("bigint") + own

    index = F.transform("order", at)
    tail = F.when(F.size("order") > 0, F.array_join(index.cast("array<string>"), ".")).otherwise(F.lit("0"))
    chunks = chunks.select(F.concat("name", F.lit("/"), tail).alias("key"), "path", "offset", "size", "raw")
    if inline_threshold > 0:
        small = F.col("raw").isNull() & F.col("path").isNotNull() & (F.col("size") > 0) & (F.col("size") < inline_threshold)
        fetched = fill_raw(chunks.filter(small)).select("key", none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), "raw")
        chunks = chunks.filter(~F.coalesce(small, F.lit(False))).union(fetched)

    # Groups: the root's metadata from the first input, those below from the last one that has them.
    group = F.element_at(F.split("key", "/"), -1).isin(".zgroup", ".zattrs")
    groups = k.filter(group).join(arrays.select("ds_idx", "var"), ["ds_idx", "var"], "left_anti")
    order = F.when(F.col("var") == "", -F.col("ds_idx")).otherwise(F.col("ds_idx"))
    groups = groups.groupBy("key").agg(F.max_by("raw", order).alias("raw")).select("key", none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), "raw")

    out = groups.union(copied).union(heads).union(chunks)
    for c, a in axes.items():
        known = arrays.filter(F.col("var") == c).orderBy("ds_idx").limit(1).collect()
        out = out.union(_stored_axis(a, numbered[c], sizes[c], json.loads(known[0]["zarray"]) if known else None, json.loads(known[0]["zattrs"]) if known else None))
    if existing is not None:
        both = existing.select(OUT).withColumn("rank", F.lit(0)).union(out.withColumn("rank", F.lit(1)))
        out = both.groupBy("key").agg(F.max_by(F.struct("path", "offset", "size", "raw"), "rank").alias("r")).select("key", "r.*")
    return postprocess(out) if postprocess is not None else out


def spark_list(like: DataFrame, names: list[str]) -> DataFrame:
    """(var) of a short list of names."""
    return like.sparkSession.createDataFrame([(n,) for n in names], "var string")


def _require_old_places(axes: dict[str, Axis], numbered: dict[str, DataFrame]) -> None:
    """Chunks of an earlier result keep their places only if no new value sorts among the old ones."""
    for c, a in axes.items():
        was = number_values(a.extra).withColumnRenamed("ord", "was")
        if was.join(numbered[c], "value").filter("was <> ord").limit(1).count():
            raise ValueError(f"new values of {c} sort before existing ones, so that existing chunks would move")


def append_references(existing: DataFrame, refs: DataFrame, concat_dims: str | list[str], **options) -> DataFrame:
    """An earlier result of ``combine_references`` with more inputs, by the same options."""
    return combine_references(refs, concat_dims, existing=existing, **options)

