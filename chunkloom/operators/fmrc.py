"""Forecast model run collections: grids of axes joined with the chunk index.

Axes are numbered lists. The chunk index meets each axis by itself (a run and a step give the valid
time), so no product of axes is made and nothing is broadcast but what adaptive execution finds to
be small; cells without a row are missing chunks. ``reinflate_store`` adds what a dataset needs beside
its chunks: groups, array metadata and the coordinate arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions.encoding import decode_inline, edited_json
from chunkloom.functions.keys import top_name
from chunkloom.operators.settle import settled


class Aggregation(Enum):
    HORIZON = "horizon"
    VALID_TIME = "valid_time"
    RUN_TIME = "run_time"
    BEST_AVAILABLE = "best_available"


def axis(spark, name: str, values: list) -> DataFrame:
    """(name_ord, name) of a short list of values in order."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_ord int, {name} " + ("interval day to second" if name == "step" else "timestamp_ntz"))


def grid(kind: Aggregation, axes: dict[str, DataFrame], reference_time=None) -> DataFrame:
    """(index array, time, step) of every cell.

    HORIZON: steps (h, step_no, step: the list of each horizon, tiled along valid times) and valid_time.
    VALID_TIME: valid_time, step. RUN_TIME: time, step. BEST_AVAILABLE: valid_time and a reference time.
    """
    if kind is Aggregation.HORIZON:
        steps, valid = axes["step"], axes["valid_time"]
        n = steps.groupBy("h").agg(F.count("*").alias("n"))
        g = steps.join(n, "h").crossJoin(F.broadcast(valid)).filter(F.pmod("valid_time_ord", "n") == F.col("step_no"))
        return g.select(F.array("h", "valid_time_ord").alias("index"), (F.col("valid_time") - F.col("step")).alias("time"), "step")
    if kind is Aggregation.VALID_TIME:
        g = axes["valid_time"].crossJoin(F.broadcast(axes["step"]))
        return g.select(F.array("valid_time_ord", "step_ord").alias("index"), (F.col("valid_time") - F.col("step")).alias("time"), "step")
    if kind is Aggregation.RUN_TIME:
        g = axes["time"].crossJoin(F.broadcast(axes["step"]))
        return g.select(F.array("time_ord", "step_ord").alias("index"), "time", "step")
    if kind is Aggregation.BEST_AVAILABLE:
        if reference_time is None:
            raise AssertionError("BEST_AVAILABLE needs exactly one reference time")
        run = F.least(F.col("valid_time"), F.lit(reference_time).cast("timestamp_ntz"))
        return axes["valid_time"].select(F.array("valid_time_ord").alias("index"), run.alias("time"), (F.col("valid_time") - run).alias("step"))
    raise RuntimeError(f"unknown aggregation {kind}")


GROUP = ["varname", "stepType", "typeOfLevel"]


def level_axis(k_index: DataFrame) -> DataFrame:
    """(group..., level, level_ord, n_levels): distinct levels of each group in ascending order."""
    d = k_index.select(*GROUP, "level").distinct()
    w = Window.partitionBy(*GROUP)
    return d.select("*", (F.dense_rank().over(w.orderBy("level")) - 1).alias("level_ord"), F.count("*").over(w).alias("n_levels"))


def placed(k_index: DataFrame, kind: Aggregation, axes: dict[str, DataFrame], reference_time=None) -> DataFrame:
    """The index's rows that the aggregation has, with their cell's numbers (``index``); by joins with one axis at a time."""
    valid = F.col("time") + F.col("step")
    if kind is Aggregation.HORIZON:
        steps = axes["step"]
        n = steps.groupBy("h").agg(F.count("*").alias("__n"))
        s = steps.join(n, "h").select("h", F.col("step_no").alias("__no"), F.col("step").alias("__step"), "__n")
        v = axes["valid_time"].select(F.col("valid_time").alias("__valid"), F.col("valid_time_ord").alias("__v"))
        j = k_index.join(v, valid == F.col("__valid")).join(s, F.col("step") == F.col("__step")).filter(F.pmod("__v", "__n") == F.col("__no"))
        return j.withColumn("index", F.array("h", "__v")).select(*k_index.columns, "index")
    if kind is Aggregation.VALID_TIME:
        v = axes["valid_time"].select(F.col("valid_time").alias("__valid"), F.col("valid_time_ord").alias("__v"))
        s = axes["step"].select(F.col("step").alias("__step"), F.col("step_ord").alias("__s"))
        j = k_index.join(v, valid == F.col("__valid")).join(s, F.col("step") == F.col("__step"))
        return j.withColumn("index", F.array("__v", "__s")).select(*k_index.columns, "index")
    if kind is Aggregation.RUN_TIME:
        t = axes["time"].select(F.col("time").alias("__time"), F.col("time_ord").alias("__t"))
        s = axes["step"].select(F.col("step").alias("__step"), F.col("step_ord").alias("__s"))
        j = k_index.join(t, F.col("time") == F.col("__time")).join(s, F.col("step") == F.col("__step"))
        return j.withColumn("index", F.array("__t", "__s")).select(*k_index.columns, "index")
    if kind is Aggregation.BEST_AVAILABLE:
        if reference_time is None:
            raise AssertionError("BEST_AVAILABLE needs exactly one reference time")
        v = axes["valid_time"].select(F.col("valid_time").alias("__valid"), F.col("valid_time_ord").alias("__v"))
        j = k_index.join(v, valid == F.col("__valid")).filter(F.col("time") == F.least(valid, F.lit(reference_time).cast("timestamp_ntz")))
        return j.withColumn("index", F.array("__v")).select(*k_index.columns, "index")
    raise RuntimeError(f"unknown aggregation {kind}")


def reinflate(k_index: DataFrame, kind: Aggregation, axes: dict[str, DataFrame], reference_time=None, check: bool = False) -> DataFrame:
    """(key, uri, offset, length, inline_value, time, step, level) of every chunk that exists.

    The key is group path, variable, the cell's numbers, the level's number if there are several,
    and one chunk each for latitude and longitude.
    """
    lev = level_axis(k_index).withColumnsRenamed({c: f"__{c}" for c in [*GROUP, "level"]}).withColumnsRenamed({"level_ord": "__level_ord", "n_levels": "__n_levels"})
    rows = placed(k_index, kind, axes, reference_time).join(lev, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*GROUP, "level"]])
    index = F.when(F.col("__n_levels") > 1, F.concat("index", F.array("__level_ord"))).otherwise(F.col("index"))
    tail = F.array_join(F.concat(index, F.array(F.lit(0), F.lit(0))).cast("array<string>"), ".")
    key = F.concat_ws("/", "varname", "stepType", "typeOfLevel", "varname", tail)
    out = rows.select(key.alias("key"), "uri", "offset", "length", "inline_value", "time", "step", "level")
    if check and out.groupBy("key").count().filter("count > 1").limit(1).count():
        raise AssertionError("Got multiple values for one cell")
    return out


#: Dimensions of the time coordinates and of data variables in each aggregation. Fixed values.
DIMS = {
    Aggregation.HORIZON: {"step": ("step", "valid_time"), "valid_time": ("step", "valid_time"), "time": ("step", "valid_time"), "datavar": ("step", "valid_time")},
    Aggregation.VALID_TIME: {"step": ("step",), "valid_time": ("valid_time",), "time": ("valid_time", "step"), "datavar": ("valid_time", "step")},
    Aggregation.RUN_TIME: {"step": ("step",), "valid_time": ("time", "step"), "time": ("time",), "datavar": ("time", "step")},
    Aggregation.BEST_AVAILABLE: {"step": ("valid_time",), "valid_time": ("valid_time",), "time": ("valid_time",), "datavar": ("valid_time",)},
}
#: Names that dimensions of the axes have in the result, so that no coordinate of two dimensions shares one's name. Fixed values.
DIM_NAMES = {"time": "run_times", "valid_time": "valid_times", "step": "model_horizons"}
COORD_ATTRS = {
    "step": {"units": "hours", "standard_name": "forecast_period", "long_name": "time since forecast_reference_time"},
    "time": {"units": "seconds since 1970-01-01T00:00:00", "calendar": "proleptic_gregorian", "standard_name": "forecast_reference_time", "long_name": "initial time of forecast"},
    "valid_time": {"units": "seconds since 1970-01-01T00:00:00", "calendar": "proleptic_gregorian", "standard_name": "time", "long_name": "time"},
}


def _seconds(name: str) -> str:
    return f"extract(DAY FROM {name}) * 86400 + extract(HOUR FROM {name}) * 3600 + extract(MINUTE FROM {name}) * 60 + extract(SECOND FROM {name})"


def _axis_seconds(axis: DataFrame, name: str, order: str) -> DataFrame:
    """(ord, seconds) of an axis of times or intervals."""
    value = F.expr(_seconds(name)).cast("bigint") if axis.schema[name].dataType.typeName() == "interval day to second" or "interval" in axis.schema[name].dataType.simpleString() else F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return axis.select(F.col(order).cast("int").alias("ord"), value.alias("s"))


def time_coordinates(kind: Aggregation, axes: dict[str, DataFrame], reference_time=None) -> DataFrame:
    """(name, part, values): seconds of each time coordinate, a chunk for each value of its first dimension.

    Coordinates of one dimension have one chunk. One row holds one row of the grid, so that a grid
    of any size is never in one task.
    """
    listed = lambda d: d.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]).alias("values"))
    one = lambda n, d: listed(d).select(F.lit(n).alias("name"), F.lit(-1).alias("part"), "values")

    def two(n: str, rows: DataFrame, columns: DataFrame, value) -> DataFrame:
        """One row of the grid from a value of its rows and the list of the columns' values."""
        g = rows.crossJoin(listed(columns))  # one row on the right
        return g.select(F.lit(n).alias("name"), F.col("ord").alias("part"), value(F.col("s"), F.col("values")).alias("values"))

    valid = _axis_seconds(axes["valid_time"], "valid_time", "valid_time_ord") if "valid_time" in axes else None
    if kind is Aggregation.HORIZON:
        s = axes["step"].select("h", "step_no", F.expr(_seconds("step")).cast("bigint").alias("s"))
        s = s.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "s"))), lambda x: x["s"]).alias("steps"))
        g = s.crossJoin(listed(valid)).withColumn("tiled", F.transform("values", lambda _, i: F.get(F.col("steps"), F.pmod(i, F.size("steps")))))
        cols = {"step": F.col("tiled"), "valid_time": F.col("values"), "time": F.zip_with("values", "tiled", lambda v, t: v - t)}
        out = None
        for n, c in cols.items():
            part = g.select(F.lit(n).alias("name"), F.col("h").cast("int").alias("part"), c.alias("values"))
            out = part if out is None else out.union(part)
        return out
    if kind is Aggregation.VALID_TIME:
        s = _axis_seconds(axes["step"], "step", "step_ord")
        return one("step", s).union(one("valid_time", valid)).union(two("time", valid, s, lambda v, xs: F.transform(xs, lambda x: v - x)))
    if kind is Aggregation.RUN_TIME:
        s, t = _axis_seconds(axes["step"], "step", "step_ord"), _axis_seconds(axes["time"], "time", "time_ord")
        return one("step", s).union(one("time", t)).union(two("valid_time", t, s, lambda v, xs: F.transform(xs, lambda x: v + x)))
    if reference_time is None:
        raise AssertionError("BEST_AVAILABLE needs exactly one reference time")
    ref = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp_ntz'{reference_time}')")
    run = valid.withColumn("t", F.least("s", ref))
    return one("valid_time", valid).union(one("time", run.select("ord", F.col("t").alias("s")))).union(one("step", run.select("ord", (F.col("s") - F.col("t")).alias("s"))))


def reinflate_store(k_index: DataFrame, kind: Aggregation, axes: dict[str, DataFrame], store: DataFrame, reference_time=None, check: bool = False) -> DataFrame:
    """(key, path, offset, size, raw): the whole reference set of an aggregation.

    store: (key, raw) of a tree of messages without data chunks (``strip_data_chunks``). Its
    groups that the index has stay, with their latitudes and longitudes; each group's variable gets the
    aggregation's dimensions, and the group its step, time, valid_time and, if there are several,
    level coordinates.
    """
    none = F.lit(None)
    as_refs = lambda d: d.select("key", none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), "raw")
    group = F.concat_ws("/", *GROUP)
    lev = level_axis(k_index)
    groups = lev.groupBy(group.alias("group"), "varname", "typeOfLevel").agg(F.array_sort(F.collect_list(F.struct("level_ord", "level"))).alias("l")).select("group", "varname", "typeOfLevel", F.transform("l", lambda x: x["level"]).alias("levels"))
    groups = settled(groups)  # one row a group
    kept = group_prefix_filter(store.select("key", "raw"), k_index)
    made = groups.select(F.explode(F.transform(F.array(F.lit("step"), F.lit("time"), F.lit("valid_time"), "varname", F.when(F.size("levels") > 1, F.col("typeOfLevel"))), lambda n: F.concat("group", F.lit("/"), n))).alias("at")).filter("at is not null").distinct()
    rest = kept.withColumn("at", F.regexp_extract("key", r"^(.*)/[^/]*$", 1)).join(made, "at", "left_anti").drop("at")

    # Data variables: the store's metadata with the dimensions of the aggregation in front of the last two.
    meta = kept.select(F.regexp_extract("key", r"^(.*)/[^/]*$", 1).alias("at"), F.element_at(F.split("key", "/"), -1).alias("file"), F.col("raw").cast("string").alias("text"))
    own = groups.withColumn("at", F.concat("group", F.lit("/"), "varname"))
    za = meta.filter("file = '.zarray'").select("at", F.col("text").alias("zarray"))
    zt = meta.filter("file = '.zattrs'").select("at", F.col("text").alias("zattrs"))
    v = own.join(za, "at").join(zt, "at", "left")
    dims = DIMS[kind]["datavar"]
    sizes = {}
    if "step" in axes:
        sizes["step"] = axes["step"].agg(F.countDistinct("h" if kind is Aggregation.HORIZON else "step_ord")).first()[0]
    for n in ("valid_time", "time"):
        if n in axes:
            sizes[n] = axes[n].count()
    shape = F.try_variant_get(F.parse_json("zarray"), "$.shape", "array<bigint>")
    last2 = F.slice(shape, -2, 2)
    old = F.slice(F.try_variant_get(F.parse_json(F.coalesce("zattrs", F.lit("{}"))), "$._ARRAY_DIMENSIONS", "array<string>"), -2, 2)
    several = F.size("levels") > 1
    as_longs = lambda *x: F.array(*[F.lit(i).cast("bigint") for i in x])
    level_n = F.when(several, F.array(F.size("levels").cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    level_1 = F.when(several, as_longs(1)).otherwise(F.array().cast("array<bigint>"))
    level_d = F.when(several, F.array("typeOfLevel")).otherwise(F.array().cast("array<string>"))
    edited = edited_json(F.col("zarray"), shape=F.concat(as_longs(*[sizes[d] for d in dims]), level_n, last2), chunks=F.concat(as_longs(*[1] * len(dims)), level_1, last2))
    attrs = edited_json(F.coalesce("zattrs", F.lit("{}")), _ARRAY_DIMENSIONS=F.concat(F.array(*[F.lit(DIM_NAMES.get(d, d)) for d in dims]), level_d, old))
    data = v.select(F.explode(F.array(F.struct(F.concat("at", F.lit("/.zarray")).alias("key"), F.encode(edited, "UTF-8").alias("raw")), F.struct(F.concat("at", F.lit("/.zattrs")).alias("key"), F.encode(attrs, "UTF-8").alias("raw")))).alias("x")).select("x.*")

    # Coordinates: the same arrays for every group, chunk by chunk.
    coords = time_coordinates(kind, axes, reference_time)
    packed = _packed(coords)
    named = packed.crossJoin(groups.select("group"))  # the few groups by the rows of coordinates that each has
    body = named.select(F.concat_ws("/", "group", "name", "tail").alias("key"), "raw")
    heads = None
    for n in ("step", "time", "valid_time"):
        cd = DIMS[kind][n]
        cshape = [sizes[d] for d in cd]
        zarray = {"chunks": cshape if len(cd) == 1 else [1, cshape[1]], "compressor": None, "dtype": "<f8" if n == "step" else "<i8", "fill_value": "NaN" if n == "step" else None, "filters": None, "order": "C", "shape": cshape, "zarr_format": 2}
        zattrs = COORD_ATTRS[n] | {"_ARRAY_DIMENSIONS": [DIM_NAMES.get(d, d) for d in cd]}
        for file, doc in ((".zarray", zarray), (".zattrs", zattrs)):
            part = groups.select(F.concat("group", F.lit(f"/{n}/{file}")).alias("key"), F.lit(json.dumps(doc, separators=(",", ":"), sort_keys=True).encode()).alias("raw"))
            heads = part if heads is None else heads.union(part)
    levels = _level_refs(groups.filter(several).select("group", "typeOfLevel", "levels"))
    chunks = reinflate(k_index, kind, axes, reference_time, check).select("key", F.col("uri").alias("path"), "offset", F.col("length").cast("bigint").alias("size"), decode_inline(F.col("inline_value")).alias("raw"))
    chunks = chunks.withColumns({c: F.when(F.col("raw").isNull(), F.col(c)) for c in ("path", "offset", "size")})
    out = as_refs(rest).union(as_refs(data)).union(as_refs(heads)).union(as_refs(body)).union(as_refs(levels))
    return out.union(chunks.select("key", "path", F.col("offset").cast("bigint"), "size", "raw"))


def _packed(coords: DataFrame) -> DataFrame:
    """(name, tail, raw): little-endian bytes of each chunk; steps in hours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [(np.asarray(v, "<i8") / 3600).astype("<f8").tobytes() if n == "step" else np.asarray(v, "<i8").tobytes() for n, v in zip(b["name"], b["values"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "tail": ["0" if p < 0 else f"{p}.0" for p in b["part"]], "raw": raw})

    return coords.select("name", "part", "values").mapInPandas(run, "name string, tail string, raw binary")


def _level_refs(groups: DataFrame) -> DataFrame:
    """(key, raw) of the level arrays of groups (group, typeOfLevel, levels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, t, v in zip(b["group"], b["typeOfLevel"], b["levels"], strict=True):
                meta = {"chunks": [len(v)], "compressor": None, "dtype": "<f8", "fill_value": "NaN", "filters": None, "order": "C", "shape": [len(v)], "zarr_format": 2}
                rows += [(f"{g}/{t}/.zarray", json.dumps(meta, separators=(",", ":"), sort_keys=True).encode()), (f"{g}/{t}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": [t]}, separators=(",", ":")).encode()), (f"{g}/{t}/0", np.asarray(v, "<f8").tobytes())]
            yield pd.DataFrame(rows, columns=["key", "raw"])

    return groups.mapInPandas(run, "key string, raw binary")


def ordered_index(k_index: DataFrame) -> DataFrame:
    """The index sorted by group, run, step and level, range by range: neighbours in a group lie in one file."""
    by = [*GROUP, "time", "step", "level"]
    return k_index.repartitionByRange(*by).sortWithinPartitions(*by)


def group_prefix_filter(keys: DataFrame, k_index: DataFrame) -> DataFrame:
    """Keys whose first parts, up to three, are a prefix of a group in the index; root keys stay."""
    groups = k_index.select(F.array(*GROUP).alias("g")).distinct()
    prefixes = groups.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.array_join(F.slice("g", F.lit(1), n), "/"))).alias("__prefix")).distinct()
    folder = F.slice(F.split("key", "/"), F.lit(1), F.least(F.lit(3), F.size(F.split("key", "/")) - 1))
    k = keys.withColumn("__prefix", F.array_join(folder, "/"))
    return k.join(prefixes, "__prefix", "left_semi").drop("__prefix")


def strip_data_chunks(keys: DataFrame, keep: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """Metadata keys, and the data chunks of variables whose name ends as one to keep."""
    from chunkloom.functions.keys import CHUNK_KEY

    name = F.regexp_extract("key", CHUNK_KEY, 1)
    kept = F.lit(False)
    for k in keep:
        kept = kept | name.endswith(k)
    return keys.filter(~F.col("key").rlike(CHUNK_KEY) | kept)


def variables(keys: DataFrame) -> DataFrame:
    return keys.select(top_name(F.col("key")).alias("variable")).distinct()
