"""Text index sidecars of GRIB files: parsing, message lengths, mapping to messages, chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_lines(lines: DataFrame) -> DataFrame:
    """(uri, line_no, value) to uri, line_no, idx, offset, date, attrs.

    A line is ``n:offset:d=YYYYMMDDHH:attrs``; attrs keep their colons. Blank lines go.
    """
    p = F.split("value", ":", 4)
    rows = lines.filter(F.trim("value") != "").select("*", p.alias("p"))
    return rows.select("uri", "line_no", F.get("p", F.lit(0)).cast("int").alias("idx"), F.get("p", F.lit(1)).cast("bigint").alias("offset"), F.get("p", F.lit(2)).alias("date"), F.get("p", F.lit(3)).alias("attrs"))


def message_lengths(idx: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Add length: the next offset of the file less this one; the last message ends at the file's size.

    sizes: (uri, file_size); without it the last length is null.
    """
    nxt = F.lead("offset").over(Window.partitionBy("uri").orderBy("line_no"))
    if sizes is None:
        return idx.withColumn("length", nxt - F.col("offset"))
    j = idx.withColumn("__next", nxt).join(sizes.select("uri", F.col("file_size").alias("__size")), "uri", "left")
    return j.withColumn("length", F.coalesce("__next", "__size") - F.col("offset")).drop("__next", "__size")


def duplicate_attrs(idx: DataFrame) -> DataFrame:
    """(uri, attrs, n) of attributes that a file has more than once."""
    return idx.groupBy("uri", "attrs").agg(F.count("*").alias("n")).filter("n > 1")


def require_unique_attrs(idx: DataFrame, what: str = "grib file") -> DataFrame:
    if duplicate_attrs(idx).limit(1).count():
        raise ValueError(f"Attribute mapping for {what} is not unique")
    return idx


def keep_first(idx: DataFrame) -> DataFrame:
    """The first line of each (uri, attrs)."""
    w = Window.partitionBy("uri", "attrs").orderBy("line_no")
    return idx.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def grib_mapping(idx: DataFrame, messages: DataFrame, validate: bool = False) -> DataFrame:
    """Index lines, left-joined with the scanned messages by file and number; both offsets and lengths stay.

    idx: uri, idx, offset, length, attrs ...; messages: uri, idx, offset, length, varname, ... Without
    a uri on either side all rows are of one file.
    """
    a = idx.withColumnsRenamed({"offset": "offset_idx", "length": "length_idx"})
    b = messages.withColumnsRenamed({"offset": "offset_grib", "length": "length_grib"})
    m = a.join(b, ["uri", "idx"] if "uri" in a.columns and "uri" in b.columns else "idx", "left")
    if validate:
        bad = m.filter("offset_grib is not null").agg(F.count_if((F.col("offset_idx") != F.col("offset_grib")) | (F.col("length_idx") != F.col("length_grib"))).alias("bad"), F.count("*").alias("n")).first()
        if bad["bad"]:
            raise ValueError(f"Index and file disagree on {bad['bad']} of {bad['n']} messages")
    return m


K_INDEX = ("varname", "typeOfLevel", "stepType", "name", "step", "level", "time", "valid_time", "uri", "offset", "length", "inline_value")


def map_from_index(idx: DataFrame, mapping: DataFrame, validate: bool = True) -> DataFrame:
    """The chunk index of new files from a mapping of the same horizon.

    idx: uri, attrs, offset, length, run (timestamp); mapping: attrs, varname, typeOfLevel,
    stepType, name, step (interval), level. Lines that the mapping doesn't know go. The mapping
    is small: one row per message of one file.
    """
    if validate:
        require_unique_attrs(idx, "index")
        if mapping.groupBy("attrs").count().filter("count > 1").limit(1).count():
            raise ValueError("Attribute mapping is not unique")
    m = mapping.select("attrs", "varname", "typeOfLevel", "stepType", "name", "step", "level").filter("varname is not null")
    j = idx.join(m, "attrs")
    return j.select(
        "varname", "typeOfLevel", "stepType", "name", "step", "level", F.col("run").alias("time"), (F.col("run") + F.col("step")).alias("valid_time"), "uri", "offset", "length", F.lit(None).cast("string").alias("inline_value")
    )
