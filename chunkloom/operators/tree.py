"""Messages as a tree of groups, arrays as relational rows, and batches of inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = ["varname", "stepType", "typeOfLevel"]


def message_tree(messages: DataFrame) -> DataFrame:
    """(path, key, uri, offset, length, n_levels): chunks of each group, combined over time, step and level.

    messages: varname, stepType, typeOfLevel, time, step_h, level, uri, offset, length. A message named
    ``unknown``, or without a name, is dropped. The level axis exists where a group has several.
    """
    m = messages.filter(F.col("varname").isNotNull() & (F.col("varname") != "unknown"))
    w = Window.partitionBy(*GROUP)
    for c in ("time", "step_h", "level"):
        axis = m.select(*GROUP, c).distinct().withColumn(f"i_{c}", F.dense_rank().over(w.orderBy(c)) - 1).withColumn(f"n_{c}", F.count("*").over(w))
        m = m.join(axis, [*GROUP, c])
    index = F.array("i_time", "i_step_h")
    index = F.when(F.col("n_level") > 1, F.concat(index, F.array("i_level"))).otherwise(index)
    path = F.concat_ws("/", *GROUP)
    tail = F.array_join(F.concat(index, F.array(F.lit(0), F.lit(0))).cast("array<string>"), ".")
    return m.select(path.alias("path"), F.concat_ws("/", path, "varname", tail).alias("key"), "uri", "offset", "length", F.col("n_level").alias("n_levels"))


def dropped_messages(messages: DataFrame) -> DataFrame:
    """(unknown, unnamed): how many messages a tree leaves out."""
    return messages.agg(F.count_if(F.col("varname") == "unknown").alias("unknown"), F.count_if(F.col("varname").isNull()).alias("unnamed"))


def extract_chunk_index(refs: DataFrame, coords: DataFrame, dims: list[str], grids: dict[str, tuple[int, int]]) -> DataFrame:
    """References of one variable as rows with coordinate values.

    refs: index, path, offset, size, raw. coords: dim, ord, value. grids: (size, chunk) of each
    dimension; a chunk has to be one cell or the whole dimension. Dimensions in one chunk get no column;
    inline chunks have offset and length -1. A chunk whose coordinate is missing stays, with a null.
    """
    for d, (n, c) in grids.items():
        if c not in (1, n):
            raise ValueError(f"the chunk of {d} is neither 1 nor the whole dimension")
    inline = F.col("raw").isNotNull()
    out = refs.withColumns({"uri": F.col("path"), "length": F.when(inline, -1).otherwise(F.col("size")), "offset": F.when(inline, -1).otherwise(F.col("offset")), "inline_value": F.when(inline, F.base64("raw"))})
    names = []
    for i, d in enumerate(dims):
        if grids[d][1] == 1:
            c = coords.filter(F.col("dim") == d).select(F.col("ord").alias("__ord"), F.col("value").alias(d))
            out = out.join(c, F.get("index", F.lit(i)) == F.col("__ord"), "left").drop("__ord")
            names.append(d)
    return out.select(*names, "uri", "offset", "length", "inline_value")


def inherited_attribute(groups: DataFrame, name: str) -> DataFrame:
    """(path, value): the group's attribute, or that of its nearest ancestor.

    groups: path, attrs (map). Every path meets its ancestors by its own prefixes.
    """
    g = groups.select("path", F.split("path", "/").alias("p"))
    up = g.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("anc"))
    a = groups.select(F.col("path").alias("anc"), F.element_at("attrs", name).alias("v")).filter("v is not null")
    best = up.join(a, "anc").groupBy("path").agg(F.max_by("v", F.length("anc")).alias("value"))
    return groups.select("path").join(best, "path", "left")


def tiled_steps(positions: DataFrame, steps: list) -> DataFrame:
    """Add step to (pos): the list repeated to any length."""
    return positions.withColumn("step", F.get(F.array(*map(F.lit, steps)), F.pmod("pos", F.lit(len(steps))).cast("int")))


def batch_number(ds_idx: Column, n_inputs: int, n_batches: int) -> Column:
    """The batch of an input: runs of ceil(n / batches) inputs."""
    per = -(-n_inputs // n_batches)
    return F.floor(ds_idx / per).cast("int")


def combine_all(scan: Callable[[list[str]], DataFrame], paths: list[str], preprocess: Callable[[DataFrame], DataFrame] | None = None, combine: Callable[[DataFrame], DataFrame] | None = None, postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scan, preprocess, combine and postprocess many inputs in one job; partial aggregation takes the place of batches."""
    out = scan(paths)
    for f in (preprocess, combine, postprocess):
        if f is not None:
            out = out.transform(f)
    return out


def coordinate_chunks(coords: DataFrame) -> DataFrame:
    """(dim, shape, values): each coordinate axis as one list of values in order; axes are short."""
    lists = coords.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("value").cast("double").alias("value")))).alias("v"))
    return lists.select("dim", F.size("v").alias("shape"), F.transform("v", lambda x: x["value"]).alias("values"))
