"""What scanners derive from file metadata, as DataFrame functions over tables of that metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Registered filter numbers that can be decoded, with the codec of each. Fixed values.
FILTERS = {1: "zlib", 2: "shuffle", 3: "fletcher32", 32001: "blosc", 32015: "zstd"}
#: Attributes that describe storage and are not passed on. Fixed values.
HIDDEN_ATTRS = ("REFERENCE_LIST", "CLASS", "DIMENSION_LIST", "NAME", "_Netcdf4Dimid", "_Netcdf4Coordinates", "_nc3_strict", "_NCProperties")


def chunk_number(offsets: Column, chunks: Column) -> Column:
    """The index of a chunk from the place of its first element."""
    return F.zip_with(offsets.cast("array<bigint>"), chunks.cast("array<bigint>"), lambda o, c: F.floor(o / c).cast("int"))


def trim_checksum(size: Column, has_checksum: Column) -> Column:
    """Bytes of a chunk without the four of its checksum."""
    return F.when(has_checksum, size - 4).otherwise(size)


def filter_codec(number: Column) -> Column:
    """The codec of a filter; null for one that can't be decoded."""
    out = F.lit(None).cast("string")
    for n, c in FILTERS.items():
        out = F.when(number == n, F.lit(c)).otherwise(out)
    return out


def unsupported_action(number: Column, nbytes: Column, threshold: int) -> Column:
    """'decode', 'inline' (undecodable but small enough to store its values) or 'fail'."""
    return F.when(filter_codec(number).isNotNull(), "decode").when(nbytes < threshold, "inline").otherwise("fail")


def passed_attrs(attrs: Column) -> Column:
    """A map of attributes without hidden ones, the fill value and dimension-scale marks."""
    return F.map_filter(attrs, lambda k, v: ~k.isin(*HIDDEN_ATTRS, "_FillValue") & (v != "DIMENSION_SCALE"))


def dimension_names(axes: DataFrame) -> DataFrame:
    """(array, axis, name): the one scale's name, the array's own if it is a scale, else a stand-in by the axis' number.

    axes: array, axis, scales (array of names), is_scale. Several scales on an axis of an array
    that is no scale itself are an error.
    """
    bad = F.raise_error(F.concat(F.lit("several dimension scales on one axis of "), F.col("array"))).cast("string")
    name = F.when(F.size("scales") == 1, F.get("scales", F.lit(0))).when(F.col("is_scale"), F.col("array")).when(F.size("scales") > 1, bad)
    return axes.select("array", "axis", name.otherwise(F.concat(F.lit("phony_dim_"), F.col("axis").cast("string"))).alias("name"))


def record_chunks(variables: DataFrame) -> DataFrame:
    """(var, key, offset, size) of record variables: one chunk a record, a step of the whole record apart.

    variables: var, rank, begin, nbytes (of one record), n_records, step.
    """
    v = variables.withColumn("i", F.explode(F.expr("sequence(0, n_records - 1)")))
    tail = F.concat(F.col("i").cast("string"), F.repeat(F.lit(".0"), F.col("rank") - 1))
    return v.select("var", F.concat_ws("/", "var", tail).alias("key"), (F.col("begin") + F.col("i") * F.col("step")).alias("offset"), F.col("nbytes").alias("size"))


def record_step(variables: DataFrame) -> DataFrame:
    """(file, step): bytes of one record of all variables; each is padded to four but for a lone one."""
    padded = F.col("nbytes") + F.pmod(-F.col("nbytes"), F.lit(4))
    return variables.groupBy("file").agg(F.when(F.count("*") == 1, F.sum("nbytes")).otherwise(F.sum(padded)).alias("step"))


def message_filter(messages: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Messages for which every key equals its value, or is one of its list; a missing key or value rejects."""
    out = messages
    for k, v in wanted.items():
        if k not in messages.columns:
            return messages.filter(F.lit(False))
        out = out.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return out


def has_level(keys: Column) -> Column:
    """Whether a message's keys hold a level."""
    return F.arrays_overlap(keys, F.array(F.lit("level"), F.lit("topLevel")))


def number_messages(messages: DataFrame) -> DataFrame:
    """Add idx from 1, in file order."""
    return messages.withColumn("idx", F.row_number().over(Window.partitionBy("uri").orderBy("offset")))


def first_messages(messages: DataFrame, n: int) -> DataFrame:
    """The first n messages of each file."""
    return number_messages(messages).filter(F.col("idx") <= n)


def object_values(lines: DataFrame) -> DataFrame:
    """(uri, object, value): each VALUE line with the OBJECT line last seen before it.

    lines: uri, line_no, value, as ``NAME = content``.
    """
    key, content = F.trim(F.split_part("value", F.lit("="), F.lit(1))), F.trim(F.regexp_extract("value", "=(.*)$", 1))
    w = Window.partitionBy("uri").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(key == "OBJECT", content), ignorenulls=True).over(w)
    return lines.select("uri", "line_no", key.alias("k"), content.alias("value"), seen.alias("object")).filter("k = 'VALUE' and object is not null").select("uri", "line_no", "object", F.btrim("value", F.lit('"')).alias("value"))


def roots(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups that are a member of none."""
    return groups.join(members.select(F.col("child").alias("ref")).distinct(), "ref", "left_anti")


def linear_world(pixel: Column, reference_pixel: Column, reference_value: Column, step: Column) -> Column:
    """The world coordinate of a pixel (from 0) under a linear axis."""
    return reference_value + (pixel + 1 - reference_pixel) * step


def vlen_labels(ids: DataFrame, labels: DataFrame, policy: str = "encode") -> DataFrame:
    """Add label to (array, pos, id): looked up, null, or the id left as it is.

    policy: 'embed' and 'encode' look up, 'null' gives nulls, 'leave' the ids. Of several labels of
    one id the smallest counts.
    """
    if policy == "leave":
        return ids.withColumn("label", F.col("id"))
    if policy == "null":
        return ids.withColumn("label", F.lit(None).cast("string"))
    if policy not in ("embed", "encode"):
        raise ValueError(f"unknown policy {policy}")
    one = labels.groupBy("id").agg(F.min("label").alias("label"))
    return ids.join(one, "id", "left").select(*ids.columns, "label")
