"""Reading a reference set as rows: byte ranges are fetched, chunks decoded, coordinates attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.codecs import cells, records, texts
from chunkloom.functions.keys import is_meta
from chunkloom.sources.ranges import fill_raw
from chunkloom.sources.references import with_keys


def chunk_bytes(refs: DataFrame) -> DataFrame:
    """References with ``raw`` filled in: a range or, at size 0, a whole file, read by position.

    Rows are not shuffled and files not read whole, so a slice costs the bytes of its chunks. Paths
    in stores that can't be read by position raise an error; ``whole_file_bytes`` reads those.
    """
    return fill_raw(refs)


def whole_file_bytes(spark: SparkSession, refs: DataFrame, files: str | list[str]) -> DataFrame:
    """The same through Spark's own readers, for any store: every file named by a reference is read once for each partition of references that it meets.

    Ranges are gathered by file first, so a file's bytes meet a list of ranges and not a row each.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select(F.col("path").alias("__file"), "content")
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    todo = refs.filter("raw is null and path is not null")
    ranges = todo.select("path", "offset", "size").distinct().groupBy("path").agg(F.collect_list(F.struct("offset", "size")).alias("r"))
    j = ranges.join(f, bare(F.col("path")) == bare(F.col("__file")))
    part = lambda r: F.when(r["size"] > 0, F.substring("content", r["offset"] + 1, r["size"])).otherwise(F.col("content"))
    got = j.select("path", F.explode(F.transform("r", lambda r: F.struct(r["offset"].alias("offset"), r["size"].alias("size"), part(r).alias("__bytes")))).alias("x")).select(F.col("path").alias("__p"), F.col("x.offset").alias("__o"), F.col("x.size").alias("__s"), "x.__bytes")
    out = refs.join(got, (F.col("path") == F.col("__p")) & F.col("offset").eqNullSafe(F.col("__o")) & F.col("size").eqNullSafe(F.col("__s")), "left")
    return out.withColumn("raw", F.coalesce("raw", "__bytes")).select(refs.columns)


def _metadata(refs: DataFrame, name: str) -> DataFrame:
    """The metadata rows of one name, with their keys' parts."""
    return with_keys(refs.filter(is_meta(F.col("key")))).filter(F.element_at(F.split("key", "/"), -1) == name)


def _arrays(refs: DataFrame) -> DataFrame:
    """(var, meta json) of each array; reads the references once."""
    return _metadata(refs, ".zarray").select("var", F.col("raw").cast("string").alias("meta"))


def array_metadata(refs: DataFrame) -> DataFrame:
    """(var, meta json, dims) of each array."""
    dims = F.try_variant_get(F.try_parse_json(F.col("raw").cast("string")), "$._ARRAY_DIMENSIONS", "array<string>")
    return _arrays(refs).join(_metadata(refs, ".zattrs").select("var", dims.alias("dims")), "var", "left")


def chunk_rows(refs: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """(var, meta, index, raw) of the reference set's chunks, or of the named arrays', with their bytes."""
    k = with_keys(refs).filter("index is not null")
    if variables is not None:
        k = k.filter(F.col("var").isin(variables))
    rows = k.select("var", "index", "path", "offset", "size", "raw").join(_arrays(refs), "var")
    return chunk_bytes(rows).select("var", "meta", "index", "raw")


def open_cells(refs: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """(var, position, value) of the reference set's numeric arrays, or of the named ones."""
    return cells(chunk_rows(refs, variables))


def open_texts(refs: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """(var, position, value) of the reference set's arrays of text."""
    return texts(chunk_rows(refs, variables))


def open_records(refs: DataFrame, fields: dict[str, str], variables: list[str] | None = None) -> DataFrame:
    """(var, fields...) of the reference set's arrays of records: a row a record, with the named fields of the given types."""
    return records(chunk_rows(refs, variables), fields)


def with_coordinates(values: DataFrame, coords: DataFrame, dims: list[str]) -> DataFrame:
    """Put coordinate values beside positions: coords(dim, ord, value)."""
    out = values
    for i, d in enumerate(dims):
        c = coords.filter(F.col("dim") == d).select(F.col("ord").alias("__ord"), F.col("value").alias(d))
        out = out.join(c, F.get("position", F.lit(i)) == F.col("__ord"), "left").drop("__ord")
    return out
