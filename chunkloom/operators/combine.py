"""Combining many inputs into one logical dataset by coordinate values.

Tables: chunks(ds_idx, var, index, ...) with the index array of each chunk in its input;
coordinates(ds_idx, dim, value); arrays(ds_idx, var, dims, shape, chunks, ...). Input order is
ds_idx. Nothing is gathered on the driver; coordinates are numbered by windows over their
distinct values.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def selector(spec: Any, url: Column = None, ds_idx: Column = None, attrs: Column = None, var: Column = None, values: Column = None) -> Column:
    """The column that a selector stands for.

    list: by input position; compiled pattern: first group, or the whole match, on the url;
    'INDEX': the input's number; 'VARNAME': the variable; 'attr:x': a global attribute;
    'vattr:v:x': an attribute of v (``attrs`` being those of v); 'data:v' and 'cf:v': decoded
    values; a callable gets the columns by name; anything else is a constant.
    """
    if callable(spec):
        return spec(ds_idx=ds_idx, url=url, var=var, attrs=attrs)
    if isinstance(spec, list):
        return F.get(F.array(*map(F.lit, spec)), ds_idx)
    if isinstance(spec, re.Pattern):
        return F.regexp_extract(url, spec.pattern, 1 if spec.groups else 0)
    if not isinstance(spec, str):
        return F.lit(spec)
    if spec == "INDEX":
        return ds_idx
    if spec == "VARNAME":
        return var
    if spec.startswith("attr:"):
        return F.get_json_object(attrs, "$." + spec[5:])
    if spec.startswith("vattr:"):
        return F.get_json_object(attrs, "$." + spec.split(":", 2)[2])
    if spec.startswith("data:"):
        return values
    if spec.startswith("cf:"):
        return cf_time(values, F.get_json_object(attrs, "$.units"))
    return F.lit(spec)


def cf_time(value: Column, units: Column) -> Column:
    """A time in a standard calendar from a number and ``unit since epoch``."""
    unit = F.regexp_extract(units, r"^\s*(\w+?)s?\s+since\s", 1)
    epoch = F.regexp_extract(units, r"since\s+(.*?)\s*$", 1).cast("timestamp_ntz")
    each = F.when(unit.isin("day", "d"), 86400.0).when(unit.isin("hour", "hr", "h"), 3600.0).when(unit.isin("minute", "min"), 60.0).when(unit.isin("second", "sec", "s"), 1.0)
    secs = F.when(unit.isin("millisecond", "msec", "m"), value / 1000.0).otherwise(value * each)
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


#: Ranges that the distinct values of a dimension are counted in, so that no task sorts them all.
RANGES = 4096


def union_coordinates(coordinates: DataFrame) -> DataFrame:
    """(dim, value, ord): distinct values of each dimension in ascending order.

    Numbers are counted in ranges between the dimension's ends first, and ranked range by range; other
    values are ranked in one window a dimension.
    """
    d = coordinates.select("dim", "value").distinct()
    kind = d.schema["value"].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return d.withColumn("ord", (F.dense_rank().over(Window.partitionBy("dim").orderBy("value")) - 1).cast("int"))
    ends = coordinates.groupBy("dim").agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
    width = F.col("__high").cast("double") - F.col("__low").cast("double")
    at = F.when(width > 0, F.floor((F.col("value").cast("double") - F.col("__low").cast("double")) / width * (RANGES - 1))).otherwise(0)
    d = d.join(ends, "dim").select("dim", "value", F.coalesce(at, F.lit(0)).cast("int").alias("__range"))
    n = d.groupBy("dim", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("dim").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    n = n.select("dim", "__range", F.coalesce(before, F.lit(0)).alias("__before"))  # RANGES rows a dimension at most
    inner = F.dense_rank().over(Window.partitionBy("dim", "__range").orderBy("value"))
    d = d.withColumn("__here", inner).join(n, ["dim", "__range"])
    return d.select("dim", "value", (F.col("__before") + F.col("__here") - 1).cast("int").alias("ord"))


def number_values(values: DataFrame) -> DataFrame:
    """(value, ord) of the distinct values that are not null, in ascending order."""
    return union_coordinates(values.filter("value is not null").select(F.lit("").alias("dim"), "value")).select("value", "ord")


def thin_coordinates(coordinates: DataFrame) -> DataFrame:
    """(dim, n): dimensions with fewer than two distinct values, which is likely a mistake."""
    return coordinates.groupBy("dim").agg(F.countDistinct("value").alias("n")).filter("n < 2")


def first_values(coordinates: DataFrame) -> DataFrame:
    """(ds_idx, dim, value): the smallest value of each input."""
    return coordinates.groupBy("ds_idx", "dim").agg(F.min("value").alias("value"))


def dataset_ordinals(coordinates: DataFrame) -> DataFrame:
    """(ds_idx, dim, ord): where each input starts along each dimension."""
    return first_values(coordinates).join(union_coordinates(coordinates), ["dim", "value"]).select("ds_idx", "dim", "ord")


def rekey(chunks: DataFrame, ordinals: DataFrame, dims: list[str], concat: list[str], chunk_sizes: dict[str, int]) -> DataFrame:
    """Replace each chunk's index by its index in the combined array.

    dims: the input's dimensions in order; concat: the combined ones. A combined dimension that
    the input lacks comes first and takes the input's ordinal; one that it has adds the ordinal,
    in chunks, to the input's own number; other dimensions stay.
    """
    order = [c for c in concat if c not in dims] + dims
    wide = ordinals.filter(F.col("dim").isin(concat)).groupBy("ds_idx").pivot("dim", concat).agg(F.first("ord"))
    wide = wide.withColumnsRenamed({c: f"__ord_{c}" for c in concat})
    j = chunks.join(wide, "ds_idx")
    parts = []
    for c in order:
        own = F.get("index", F.lit(dims.index(c))) if c in dims else None
        if c in concat:
            at = F.expr(f"`__ord_{c}` div {chunk_sizes.get(c, 1) if c in dims else 1}").cast("int")
            parts.append(at + own if own is not None else at)
        else:
            parts.append(own)
    return j.withColumn("index", F.array(*parts)).drop(*(f"__ord_{c}" for c in concat))


def output_shape(arrays: DataFrame, coordinates: DataFrame, concat: list[str]) -> DataFrame:
    """(var, dim, size): count of distinct coordinates along combined dimensions, the first input's elsewhere."""
    first = first_metadata(arrays).select("var", F.posexplode("dims").alias("k", "dim"), "shape").select("var", "dim", F.get("shape", F.col("k")).alias("own"))
    n = coordinates.groupBy("dim").agg(F.countDistinct("value").alias("n"))
    new = first.select("var").distinct().withColumn("dim", F.explode(F.array(*map(F.lit, concat)).cast("array<string>"))).join(n, "dim", "left_semi")
    all_dims = first.join(new, ["var", "dim"], "full_outer")
    return all_dims.join(n, "dim", "left").select("var", "dim", F.coalesce("n", "own").alias("size"))


def first_metadata(arrays: DataFrame) -> DataFrame:
    """Each variable's row from the first input that has it."""
    cols = [c for c in arrays.columns if c != "var"]
    first = arrays.groupBy("var").agg(F.min_by(F.struct(*cols), "ds_idx").alias("__first"))
    return first.select("var", "__first.*").select(arrays.columns)


def chunk_mismatch(arrays: DataFrame) -> DataFrame:
    """(var, n): variables whose chunk tuple differs between inputs."""
    return arrays.groupBy("var").agg(F.countDistinct(F.array_join(F.col("chunks").cast("array<string>"), ",")).alias("n")).filter("n > 1")


def require_equal_chunks(arrays: DataFrame) -> DataFrame:
    bad = chunk_mismatch(arrays).limit(1).collect()
    if bad:
        raise ValueError(f"Found chunk size mismatch in {bad[0]['var']}")
    return arrays


def coordinate_variables(arrays: DataFrame) -> DataFrame:
    """(var): variables that are a dimension of some array of the first input."""
    first = arrays.join(arrays.agg(F.min("ds_idx").alias("ds_idx")), "ds_idx", "left_semi")
    dims = first.select(F.explode("dims").alias("var")).distinct()
    return arrays.select("var").distinct().join(dims, "var", "left_semi")


def require_disjoint(mapped: list[str], identical: list[str]) -> None:
    both = sorted(set(mapped) & set(identical))
    if both:
        raise ValueError(f"mapped and identical names overlap: {both}")


def route(refs: DataFrame, mapped: list[str], identical: list[str], coords: DataFrame) -> DataFrame:
    """Keep what the combined dataset takes: identical variables and coordinates from the first input, others always."""
    return route_by(refs, F.col("var").isin(list(mapped)), F.col("var").isin(list(identical)), coords)


def route_by(refs: DataFrame, mapped: Column, identical: Column, coords: DataFrame) -> DataFrame:
    """``route`` by conditions on the row."""
    marked = coords.select("var", F.lit(True).alias("__coord")).distinct()
    j = refs.filter(~mapped).join(marked, "var", "left").withColumn("__once", identical | F.coalesce("__coord", F.lit(False)))
    first = j.filter("__once").groupBy("key").agg(F.min("ds_idx").alias("__first"))
    j = j.join(first, "key", "left").filter((~F.col("__once")) | (F.col("ds_idx") == F.col("__first")))
    return j.select(refs.columns)


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Inputs of both sets, the new ones numbered after the existing; ordinals are found anew from the union."""
    last = existing.agg((F.coalesce(F.max("ds_idx"), F.lit(-1)) + 1).alias("n")).first()["n"]
    moved = new.withColumn("ds_idx", (F.col("ds_idx") + F.lit(last)).cast("int"))
    return existing.unionByName(moved, allowMissingColumns=True)


def merge_variables(refs: DataFrame) -> DataFrame:
    """One row per key; the last input wins."""
    cols = [c for c in refs.columns if c not in ("key", "ds_idx")]
    return refs.groupBy("key").agg(F.max_by(F.struct("ds_idx", *cols), "ds_idx").alias("r")).select("key", "r.*")


def concat_offsets(arrays: DataFrame, axis: int) -> DataFrame:
    """(ds_idx, n_chunks, offset): chunks along the axis and those of the inputs before.

    Inputs are summed in runs of RANGES first, so that no window holds more than that many, or one row a run.
    """
    size, chunk = F.get("shape", F.lit(axis)), F.get("chunks", F.lit(axis))
    n = arrays.select("ds_idx", F.ceil(size / chunk).cast("bigint").alias("n_chunks"), F.floor(F.col("ds_idx") / RANGES).alias("__run"))
    before = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = n.groupBy("__run").agg(F.sum("n_chunks").alias("__n"))
    runs = runs.select("__run", before("__n", Window.orderBy("__run")).alias("__before"))  # one row a run
    n = n.withColumn("__here", before("n_chunks", Window.partitionBy("__run").orderBy("ds_idx")))
    return n.join(runs, "__run").select("ds_idx", "n_chunks", (F.col("__before") + F.col("__here")).alias("offset"))


def concatenate(chunks: DataFrame, arrays: DataFrame, axis: int, check: bool = False) -> DataFrame:
    """Chunks of one array per input, moved along the axis behind those of the inputs before."""
    if check:
        check_concat(arrays, axis)
    off = concat_offsets(arrays, axis).select("ds_idx", "offset")
    moved = F.transform("index", lambda x, i: F.when(i == axis, (x + F.col("__offset")).cast("int")).otherwise(x))
    return chunks.join(off.withColumnRenamed("offset", "__offset"), "ds_idx").withColumn("index", moved).drop("__offset")


def check_concat(arrays: DataFrame, axis: int) -> None:
    """Raise for inputs whose other sizes or chunks differ from the first, or that end inside a chunk before the last."""
    others = F.filter("shape", lambda x, i: i != axis)
    rows = arrays.select("ds_idx", F.get("shape", F.lit(axis)).alias("n"), F.get("chunks", F.lit(axis)).alias("c"), others.alias("other"), "chunks")
    ends = rows.agg(F.min_by(F.struct("other", "chunks"), "ds_idx").alias("first"), F.max("ds_idx").alias("last")).first()
    if ends["last"] is None:
        return
    as_array = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    why = F.when(F.col("other").cast("array<bigint>") != as_array(ends["first"]["other"]), "shape").when(F.col("chunks").cast("array<bigint>") != as_array(ends["first"]["chunks"]), "chunks").when((F.col("ds_idx") != ends["last"]) & (F.col("n") % F.col("c") != 0), "boundary")
    bad = rows.select("ds_idx", why.alias("why")).filter("why is not null").orderBy("ds_idx").limit(1).collect()
    if bad:
        said = {"shape": "Incompatible array shape", "chunks": "Incompatible array chunks", "boundary": "Irregular chunk boundary"}[bad[0]["why"]]
        raise ValueError(f"{said} at index {bad[0]['ds_idx']}")


def concat_shape(arrays: DataFrame, axis: int) -> DataFrame:
    """(dim_no, size): the sum along the axis, the first input's sizes elsewhere."""
    e = arrays.select("ds_idx", F.posexplode("shape").alias("dim_no", "n"))
    return e.groupBy("dim_no").agg(F.sum("n").alias("total"), F.min_by("n", "ds_idx").alias("first")).select("dim_no", F.when(F.col("dim_no") == axis, F.col("total")).otherwise(F.col("first")).alias("size"))


def nearest(coords: DataFrame, points: DataFrame) -> DataFrame:
    """(point, ord): the coordinate nearest to each point, the smaller ordinal on a tie.

    Points and coordinates are laid on one line in ranges; a point meets the last value at or below it
    and the first one at or above it, which windows over the ranges, and over one row a range, find.
    """
    none = F.lit(None)
    both = coords.select(F.col("value").cast("double").alias("v"), F.col("ord").cast("int").alias("o"), none.cast("double").alias("point"))
    both = both.union(points.select(F.col("point").cast("double")).distinct().select(F.col("point").alias("v"), none.cast("int").alias("o"), "point"))
    low, high = coords.agg(F.min("value").cast("double"), F.max("value").cast("double")).first()
    if low is None:
        return points.select("point", none.cast("int").alias("ord")).filter("false")
    width = (high - low) or 1.0
    both = both.withColumn("r", F.greatest(F.lit(0.0), F.least(F.lit(RANGES - 1.0), F.floor((F.col("v") - low) / width * (RANGES - 1)))).cast("int"))
    cell = F.when(F.col("o").isNotNull(), F.struct("v", "o"))
    ends = both.filter("o is not null").groupBy("r").agg(F.min(F.struct("v", "o")).alias("lo"), F.max(F.struct("v", "o")).alias("hi"))
    ends = {x["r"]: x for x in ends.collect()}  # RANGES rows at most
    under, over, last = {}, {}, None
    for k in range(RANGES):
        under[k], last = last, ends[k]["hi"] if k in ends else last
    last = None
    for k in reversed(range(RANGES)):
        over[k], last = last, ends[k]["lo"] if k in ends else last
    pair = "struct<v: double, o: int>"
    spread = coords.sparkSession.createDataFrame([(k, under[k], over[k]) for k in range(RANGES)], f"r int, under {pair}, over {pair}")
    below = F.last(cell, True).over(Window.partitionBy("r").orderBy("v", F.col("o").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(cell, True).over(Window.partitionBy("r").orderBy("v", F.col("o").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    j = both.select("r", "point", below.alias("below"), above.alias("above")).filter("point is not null").join(spread, "r")
    j = j.select("point", F.coalesce("below", "under").alias("a"), F.coalesce("above", "over").alias("b"))
    p, av, bv = F.col("point"), F.col("a.v"), F.col("b.v")
    best = F.when(bv.isNull() | (p - av < bv - p), F.col("a.o")).when(av.isNull() | (p - av > bv - p), F.col("b.o")).otherwise(F.least("a.o", "b.o"))
    return j.select("point", best.alias("ord"))
