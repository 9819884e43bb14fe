"""Rewriting reference rows: refs(key, path, offset, size, raw, ...)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.encoding import common_prefix
from chunkloom.functions.keys import grid_of, nbytes


def drop_prefixes(refs: DataFrame, prefixes: tuple[str, ...] | str) -> DataFrame:
    """Rows whose key starts with none of the prefixes."""
    bad = F.lit(False)
    for p in (prefixes,) if isinstance(prefixes, str) else prefixes:
        bad = bad | F.col("key").startswith(p)
    return refs.filter(~bad)


def rename_targets(refs: DataFrame, renames: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Replace paths that renames(old, new) names; broadcast if it is counted as small."""
    r = renames.select(F.col("old").alias("path"), F.col("new").alias("__new"))
    small = r.limit(broadcast_rows + 1).count() <= broadcast_rows
    j = refs.join(F.broadcast(r) if small else r, "path", "left")
    return j.withColumn("path", F.coalesce("__new", "path")).drop("__new").select(refs.columns)


def inline(refs: DataFrame, threshold: int) -> DataFrame:
    """Byte ranges below the threshold, and whole files of metadata, fetched and put in place; other rows as they are."""
    from chunkloom.sources.ranges import fill_raw

    small = F.coalesce(should_inline(threshold), F.lit(False)) & F.col("path").isNotNull()
    got = fill_raw(refs.filter(small))
    for c in ("path", "offset", "size"):
        got = got.withColumn(c, F.lit(None).cast(refs.schema[c].dataType))
    return refs.filter(~small).unionByName(got)


def should_inline(threshold: int) -> Column:
    """Byte ranges below the threshold, and whole files whose base name is metadata."""
    base = F.element_at(F.split("key", "/"), -1)
    return F.col("raw").isNull() & (((F.col("size") > 0) & (F.col("size") < threshold)) | ((F.coalesce("size", F.lit(0)) == 0) & base.startswith(".z")))


def should_inline_combined(threshold: int, file_size: Column) -> Column:
    """The rule when combining: ranges below the threshold, or whole files that are smaller than it."""
    if threshold <= 0:
        return F.lit(False)
    return F.col("path").isNotNull() & F.when(F.col("size") > 0, F.col("size") < threshold).otherwise(F.coalesce(file_size < threshold, F.lit(False)))


def arrays_to_inline(arrays: DataFrame, threshold: int = 1000, names: tuple[str, ...] = ()) -> DataFrame:
    """Arrays of fewer bytes than the threshold, or named: their chunk tuple becomes their shape."""
    small = (nbytes(F.col("shape"), F.col("itemsize")) < threshold) if threshold else F.lit(False)
    picked = small | F.regexp_replace("var", "/", ".").isin(list(names))
    return arrays.withColumn("inline", picked).withColumn("chunks", F.when(picked, F.col("shape")).otherwise(F.col("chunks")))


def inline_arrays(chunks: DataFrame, arrays: DataFrame, threshold: int = 1000, names: tuple[str, ...] = ()) -> DataFrame:
    """(var, raw): the bytes of each small array in C order, put together from its uncompressed chunks.

    Cells of missing chunks are zero bytes. An array named in ``names`` has to fit a task, as its one chunk will.
    """
    picked = arrays_to_inline(arrays, threshold, names).filter("inline").select("var")
    rows = chunks.select("var", "index", "raw").join(arrays.select("var", "shape", F.col("chunks").alias("chunk"), "itemsize").join(picked, "var", "left_semi"), "var")

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shape, chunk = (tuple(int(x) for x in pdf[c].iloc[0]) for c in ("shape", "chunk"))
        dtype = np.dtype(f"V{int(pdf['itemsize'].iloc[0])}")
        out = np.zeros(shape, dtype)
        for index, raw in zip(pdf["index"], pdf["raw"], strict=True):
            at = tuple(slice(i * c, min(s, (i + 1) * c)) for i, c, s in zip(index, chunk, shape, strict=True))
            part = np.frombuffer(bytes(raw), dtype).reshape(chunk) if shape else np.frombuffer(bytes(raw), dtype)[0]
            out[at] = part[tuple(slice(0, x.stop - x.start) for x in at)] if shape else part
        return pd.DataFrame({"var": [key[0]], "raw": [out.tobytes()]})

    return rows.groupBy("var").applyInPandas(whole, "var string, raw binary")


def split_plan(chunk: list[int], factor: int) -> list[tuple[int, int]]:
    """(axis, parts) to split chunks into ``factor`` ranges: leading axes whole, the last one by what is left."""
    out = []
    for axis, c in enumerate(chunk):
        if factor == 1:
            break
        if c == 1:
            continue
        if c % factor == 0:
            return [*out, (axis, factor)]
        if factor % c:
            break
        out.append((axis, c))
        factor //= c
    if factor != 1:
        raise ValueError(f"Must subchunk by an exact factor, which {factor} of {chunk} is not")
    return out


def _split_axis(index: Column, axis: int, n: int, part: Column) -> Column:
    return F.transform(index, lambda x, i: F.when(i == axis, x * n + part).otherwise(x))


def subchunk(chunks: DataFrame, shape: list[int], chunk: list[int], factor: int, compressed: bool = False) -> DataFrame:
    """Split each uncompressed chunk into ``factor`` byte ranges, along the first axes longer than one."""
    if compressed:
        raise ValueError("Can only subchunk uncompressed arrays")
    plan = split_plan(chunk, factor)
    if chunks.filter("raw is not null").limit(1).count():
        raise ValueError("Can't subchunk inlined data")
    parts = chunks.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    index, below = F.col("index"), factor
    for axis, n in plan:
        below //= n
        here = F.expr(f"cast((`__part` div {below}) % {n} as int)")
        index = _split_axis(index, axis, n, here)
    size = F.expr(f"size div {factor}")
    return parts.withColumn("index", index).withColumn("offset", F.col("offset") + F.col("__part") * size).withColumn("size", size).drop("__part")


def dereference_archives(refs: DataFrame, members: DataFrame) -> DataFrame:
    """Point ``zip://member::archive`` and ``tar://...`` paths into the archive.

    members: (archive, member, member_offset, member_size). Other rows stay; a member that the
    archive lacks keeps its path.
    """
    arch = F.regexp_extract("path", r"^(?:zip|tar)://.*?::(.*)$", 1)
    memb = F.regexp_extract("path", r"^(?:zip|tar)://(.*?)::", 1)
    m = members.select(F.col("archive").alias("__a"), F.col("member").alias("__m"), F.col("member_offset").alias("__at"), F.col("member_size").alias("__size"))
    j = refs.withColumn("__arch", F.when(F.col("path").rlike(r"^(zip|tar)://.*::"), arch)).withColumn("__memb", memb)
    j = j.join(m, (F.col("__arch") == F.col("__a")) & (F.col("__memb") == F.col("__m")), "left")
    hit = F.col("__a").isNotNull()
    whole = F.coalesce("size", F.lit(0)) == 0
    j = j.withColumn("offset", F.when(hit, F.coalesce("offset", F.lit(0)) + F.col("__at")).otherwise(F.col("offset")))
    j = j.withColumn("size", F.when(hit & whole, F.col("__size")).otherwise(F.col("size"))).withColumn("path", F.when(hit, F.col("__arch")).otherwise(F.col("path")))
    return j.select(refs.columns)


def templateize(refs: DataFrame, min_length: int = 10, name: str = "u") -> DataFrame:
    """Add template (null if the paths' common prefix is too short) and the path with it cut to ``{name}``."""
    prefix = refs.agg(common_prefix(F.min("path"), F.max("path")).alias("p")).first()["p"]
    if prefix is None or len(prefix) < min_length:
        return refs.withColumn("template", F.lit(None).cast("string"))
    short = F.concat(F.lit("{" + name + "}"), F.col("path").substr(F.lit(len(prefix) + 1), F.char_length("path")))
    return refs.withColumn("template", F.lit(prefix)).withColumn("path", short)


def expand_generator(spark, dims: dict[str, tuple[int, int, int] | list], key: str, url: str, offset: str | None = None, length: str | None = None) -> DataFrame:
    """References from a generator: the product of ranges (start, stop, step) or lists, and SQL expressions over them."""
    g = spark.range(1).select()
    for name, d in dims.items():
        values = F.sequence(F.lit(d[0]), F.lit(d[1] - 1), F.lit(d[2])) if isinstance(d, tuple) else F.array(*map(F.lit, d))
        g = g.withColumn(name, F.explode(values))
    cols = [F.expr(key).alias("key"), F.expr(url).alias("path")]
    cols += [F.expr(x).cast("bigint").alias(n) for n, x in (("offset", offset), ("size", length)) if x]
    return g.select(*cols)


def record_layout(refs: DataFrame, arrays: DataFrame, record_size: int = 100_000) -> DataFrame:
    """Add the record file and row of each chunk: its number in C order, by record_size."""
    from chunkloom.functions.keys import c_order

    a = arrays.select("var", grid_of(F.col("shape"), F.col("chunks")).alias("grid"))
    j = refs.join(a, "var").withColumn("number", c_order(F.col("index"), F.col("grid")))
    return j.withColumn("rec_no", F.expr(f"number div {record_size}")).withColumn("row_no", F.col("number") % record_size).drop("grid")
