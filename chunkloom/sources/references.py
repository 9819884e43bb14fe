"""Reading and writing reference sets: JSON of both versions, gzip, Parquet record files."""

from __future__ import annotations

import ast
import itertools
import json
import operator
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions.encoding import decode_inline, encode_inline, encode_json_value
from chunkloom.functions.keys import chunk_index, grid_of, is_meta, variable_of
from chunkloom.operators.rewrite import record_layout, rename_targets

REFS = "ds_idx int, ds_url string, key string, path string, offset bigint, size bigint, raw binary"

#: A template with anything but a bare name in it, which takes the slower way through Python.
_EXPRESSION = r"\{\{\s*[A-Za-z_]\w*\s*[^\s\w}]|\{\{\s*[^\sA-Za-z_]"

_OPERATORS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
    ast.USub: operator.neg,
    ast.UAdd: operator.pos,
}


def evaluate(text: str, names: dict):
    """An arithmetic expression over names; a name that stands for a template may be called with its parameters."""

    def value(node: ast.AST):
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id not in names:
                raise ValueError(f"unknown name {node.id} in a template")
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.args:
            return render(str(names.get(node.func.id, "")), names | {k.arg: value(k.value) for k in node.keywords})
        raise ValueError(f"not allowed in a template: {text}")

    return value(ast.parse(text.strip(), mode="eval").body)


def render(text: str, names: dict) -> str:
    """A text with each ``{{expression}}`` replaced by its value."""
    return re.sub(r"\{\{(.*?)\}\}", lambda m: str(evaluate(m[1], names)), text)


def expand_set(doc: dict) -> Iterator[tuple[str, object]]:
    """(key, string, list or object) of a set with its templates rendered and its generators run."""
    names = dict(doc.get("templates") or {})
    for g in doc.get("gen") or ():
        axes = [(n, d if isinstance(d, list) else range(d.get("start", 0), d["stop"], d.get("step", 1))) for n, d in g["dimensions"].items()]
        for at in itertools.product(*(v for _, v in axes)):
            here = names | dict(zip((n for n, _ in axes), at, strict=True))
            ref = [render(g["url"], here)]
            if "offset" in g and "length" in g:
                ref += [int(render(str(g[k]), here)) for k in ("offset", "length")]
            yield render(g["key"], here), ref
    for key, x in (doc.get("refs") or {}).items():
        yield key, [render(x[0], names), *x[1:]] if isinstance(x, list) else x


def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for ds_idx, url, text in zip(b["ds_idx"], b["ds_url"], b["value"], strict=True):
            rows = ((k, json.dumps(x)) for k, x in expand_set(json.loads(text)))
            while part := list(itertools.islice(rows, 10_000)):
                yield pd.DataFrame({"ds_idx": ds_idx, "ds_url": url, "key": [k for k, _ in part], "x": [x for _, x in part]})


def _plain_path(c: Column) -> Column:
    """A file's path as it was given: unescaped, a local one without its scheme."""
    return F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def number_files(spark: SparkSession, t: DataFrame, paths: list[str] | str) -> DataFrame:
    """Add ds_idx to (ds_url, ...): the place in a list of paths, or that of the name among all for one path or pattern."""
    given = [paths] if isinstance(paths, str) else list(paths)
    if len(given) == 1:
        names = t.select("ds_url").distinct()
        number = names.withColumn("ds_idx", (F.row_number().over(Window.orderBy("ds_url")) - 1).cast("int"))  # one row a file
        return t.join(number, "ds_url")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.FileSystem.get(conf).getWorkingDirectory().toString()
    full = [p if "://" in p or p.startswith(("/", "file:/")) else f"{here}/{p}" for p in given]
    number = spark.createDataFrame(list(enumerate(re.sub("^file:/+", "/", p) for p in full)), "ds_idx int, __name string")
    t = t.withColumn("__name", _plain_path(F.col("ds_url"))).join(number, "__name", "left").drop("__name")
    return t.withColumn("ds_idx", F.coalesce("ds_idx", F.raise_error(F.concat(F.lit("not a path of the list: "), F.col("ds_url"))).cast("int")))


def read_json(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """References of JSON files, version 0 or 1, plain or compressed by extension, with templates rendered.

    A string value is inline; a list is [path] or [path, offset, size]; an object is inline JSON.
    ds_idx follows the order of ``paths``, or of the names where one folder or pattern is given.
    Sets with generators, or with templates that compute or take parameters, are expanded in Python.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    t = spark.read.text(given, wholetext=True).select(F.col("_metadata.file_path").alias("ds_url"), "value")
    t = number_files(spark, t, paths).withColumn("v", F.parse_json("value"))
    generated = F.try_variant_get("v", "$.gen", "variant").isNotNull()
    computed = F.coalesce(generated | (F.try_variant_get("v", "$.templates", "variant").isNotNull() & F.col("value").rlike(_EXPRESSION)), F.lit(False))
    body = F.coalesce(F.try_variant_get("v", "$.refs", "variant"), F.col("v"))
    templates = F.coalesce(F.try_variant_get("v", "$.templates", "map<string,string>"), F.create_map().cast("map<string,string>"))
    plain = t.filter(~computed).select("ds_idx", "ds_url", templates.alias("templates"), F.explode(F.from_json(F.to_json(body), "map<string,variant>")).alias("key", "x"))
    other = t.filter(computed).select("ds_idx", "ds_url", "value").mapInPandas(_expanded, "ds_idx int, ds_url string, key string, x string")
    other = other.select("ds_idx", "ds_url", F.create_map().cast("map<string,string>").alias("templates"), "key", F.parse_json("x").alias("x"))
    return _references(plain.union(other))


def _references(t: DataFrame) -> DataFrame:
    """Rows of REFS from (ds_idx, ds_url, templates, key, x variant)."""
    kind = F.schema_of_variant("x")
    listed = kind.startswith("ARRAY")
    path = F.when(listed, F.try_variant_get("x", "$[0]", "string"))
    rendered = F.aggregate(F.map_entries("templates"), path, lambda p, e: F.replace(p, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))
    inline = F.when(kind == "STRING", decode_inline(F.try_variant_get("x", "$", "string"))).when(~listed, F.encode(F.to_json("x"), "UTF-8"))
    return t.select("ds_idx", "ds_url", "key", rendered.alias("path"), F.when(listed, F.coalesce(F.try_variant_get("x", "$[1]", "bigint"), F.lit(0))).alias("offset"), F.when(listed, F.coalesce(F.try_variant_get("x", "$[2]", "bigint"), F.lit(0))).alias("size"), inline.alias("raw"))


def rename_target_files(spark: SparkSession, paths: list[str], renames: DataFrame, out: list[str]) -> None:
    """Write each JSON set again, with the targets that renames(old, new) names replaced."""
    for source, target in zip(paths, out, strict=True):
        suffix = "gzip" if target.endswith(".gz") else "none"
        write_json(rename_targets(read_json(spark, source), renames), target, suffix)


def with_keys(refs: DataFrame) -> DataFrame:
    """Add var, is_meta and index, parsed from the key."""
    k = F.col("key")
    return refs.withColumns({"var": variable_of(k), "is_meta": is_meta(k), "index": chunk_index(k)})


def json_entries(refs: DataFrame) -> DataFrame:
    """(key, value): each reference as JSON text."""
    quoted = F.to_json(F.array(encode_inline(F.col("raw"))))
    inline = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    arr = F.when(F.col("size") > 0, F.format_string('["%s",%d,%d]', F.regexp_replace("path", '(["\\\\])', "\\\\$1"), "offset", "size")).otherwise(F.format_string('["%s"]', F.regexp_replace("path", '(["\\\\])', "\\\\$1")))
    key = F.regexp_replace("key", "^/+", "")
    return refs.filter("raw is not null or path is not null").select(key.alias("key"), F.when(F.col("raw").isNotNull(), inline).otherwise(arr).alias("value"))


_SUFFIX = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}


def write_json(refs: DataFrame, path: str, compression: str = "none", version: int = 1) -> None:
    """One JSON document, the file ``path``, with its keys in order.

    The entries are written as sorted parts by many tasks; the driver then copies the parts, as a
    stream of bytes, behind each other (gzip and bzip2 streams may be joined so too). No row and
    no process holds the whole set.
    """
    spark = refs.sparkSession
    e = json_entries(refs)
    quoted = F.to_json(F.array("key"))
    pair = F.concat(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2), F.lit(":"), F.col("value"))
    least = e.agg(F.min("key")).first()[0]
    line = F.concat(F.when(F.col("key") == F.lit(least), F.lit("")).otherwise(F.lit(",")), pair)
    head, tail = ('{"version":1,"refs":{', "}}") if version == 1 else ("{", "}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    work = jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    try:
        parts = {"0": spark.createDataFrame([(head,)], "value string").coalesce(1), "1": e.orderBy("key").select(line.alias("value")), "2": spark.createDataFrame([(tail,)], "value string").coalesce(1)}
        for name, d in parts.items():
            d.write.option("compression", compression).text(f"{work.toString()}/{name}")
        out = fs.create(target, True)
        try:
            for name in parts:
                listed = sorted(s.getPath().toString() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{work.toString()}/{name}")))
                for p in listed:
                    if p.rsplit("/", 1)[-1].startswith("part-"):
                        source = fs.open(jvm.org.apache.hadoop.fs.Path(p))
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                        source.close()
        finally:
            out.close()
    finally:
        fs.delete(work, True)


def write_parquet(refs: DataFrame, arrays: DataFrame, path: str, record_size: int = 100_000) -> None:
    """Record files as the reference format has them: ``<path>/<var>/refs.<n>.parq`` and ``.zmetadata``.

    A file holds the chunks n * record_size and on of its variable in C order, one row each; missing
    chunks are rows without path and bytes. Rows are dealt by record file and put in order there.
    """
    spark = refs.sparkSession
    r = refs if "index" in refs.columns else with_keys(refs)
    rows = record_layout(r.filter("index is not null"), arrays, record_size).select("var", "rec_no", "row_no", "path", "offset", "size", "raw")
    chunks = F.aggregate(grid_of(F.col("shape"), F.col("chunks")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    whole = rows.select("var", "rec_no").distinct().join(arrays.select("var", chunks.alias("chunks")), "var")
    last = F.least(F.lit(record_size), F.col("chunks") - F.col("rec_no") * record_size) - 1
    whole = whole.select("var", "rec_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("row_no"))
    full = whole.join(rows, ["var", "rec_no", "row_no"], "left")
    full = full.withColumns({"offset": F.coalesce("offset", F.lit(0)).cast("bigint"), "size": F.coalesce("size", F.lit(0)).cast("bigint")})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    work = hadoop(f"{path}/.parts-{uuid.uuid4().hex}")
    fs = work.getFileSystem(conf)
    # Folder names keep slashes out; one task writes one record file.
    full = full.withColumn("at", F.hex(F.encode("var", "UTF-8")))
    # The writer asks for the order of its folders' columns; rows keep theirs only behind these.
    full = full.repartition("at", "rec_no").sortWithinPartitions("at", "rec_no", "row_no")
    full.select("at", "rec_no", "path", "offset", "size", "raw").write.partitionBy("at", "rec_no").parquet(work.toString())
    for status in fs.globStatus(hadoop(f"{work.toString()}/at=*/rec_no=*/part-*")) or ():
        p = status.getPath()
        var = bytes.fromhex(p.getParent().getParent().getName()[3:]).decode()
        to = hadoop(f"{path}/{var}/refs.{p.getParent().getName()[7:]}.parq")
        fs.mkdirs(to.getParent())
        fs.rename(p, to)
    fs.delete(work, True)
    meta = consolidated_metadata(refs).first()[0]
    out = fs.create(hadoop(f"{path}/.zmetadata"), True)
    try:
        out.write(bytearray(f'{{"metadata":{meta or "{}"},"record_size":{record_size}}}'.encode()))
    finally:
        out.close()


def read_parquet(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """(key, var, index, rec_no, row_no, path, offset, size, raw) of record files, metadata rows included.

    Only the folders of ``variables`` are read, if given; missing chunks have no row.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    top = hadoop(f"{path.rstrip('/')}/.zmetadata")
    fs = top.getFileSystem(conf)
    stream = fs.open(top)
    try:
        head = json.loads(bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
    finally:
        stream.close()
    record_size, meta = head["record_size"], head["metadata"]
    arrays = {k.rpartition("/")[0]: v if isinstance(v, dict) else json.loads(v) for k, v in meta.items() if k.rpartition("/")[2] == ".zarray"}
    names = [v for v in arrays if (variables is None or v in variables) and fs.exists(hadoop(f"{path}/{v}"))]
    keys = spark.createDataFrame([(k, bytearray((v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))).encode())) for k, v in meta.items()], "key string, raw binary")
    none = F.lit(None)
    out = keys.select("key", variable_of(F.col("key")).alias("var"), none.cast("array<int>").alias("index"), none.cast("bigint").alias("rec_no"), none.cast("bigint").alias("row_no"), none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), "raw")
    if not names:
        return out
    shape = "path string, offset bigint, size bigint, raw binary"
    t = spark.read.schema(shape).option("recursiveFileLookup", "true").option("pathGlobFilter", "refs.*.parq").parquet(*[f"{path}/{v}" for v in names])
    t = t.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("row_no")).filter("path is not null or raw is not null")
    top = fs.makeQualified(hadoop(path.rstrip("/"))).toUri().getPath()
    file = F.regexp_extract(_plain_path(F.regexp_replace("__file", "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/", "/")), re.escape(top) + r"/(.*)/refs\.([0-9]+)\.parq$", 1)
    t = t.withColumns({"var": file, "rec_no": F.regexp_extract("__file", r"refs\.([0-9]+)\.parq$", 1).cast("bigint")})
    grids = [(v, [-(-s // c) for s, c in zip(arrays[v]["shape"], arrays[v]["chunks"], strict=True)]) for v in names]
    t = t.join(spark.createDataFrame(grids, "var string, grid array<bigint>"), "var")  # one row an array
    number = F.col("rec_no") * record_size + F.col("row_no")
    below = lambda i: F.aggregate(F.slice("grid", i + 2, F.size("grid")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    index = F.transform("grid", lambda g, i: (F.floor(number / below(i)) % g).cast("int"))
    t = t.withColumn("index", F.when(F.size("grid") > 0, index).otherwise(F.array().cast("array<int>")))
    tail = F.when(F.size("index") > 0, F.array_join(F.col("index").cast("array<string>"), ".")).otherwise(F.lit("0"))
    t = t.withColumn("key", F.when(F.col("var") == "", tail).otherwise(F.concat("var", F.lit("/"), tail)))
    return out.unionByName(t.select(out.columns))


def consolidated_metadata(refs: DataFrame) -> DataFrame:
    """(value): one JSON document of all metadata keys."""
    return refs.filter(is_meta(F.col("key"))).agg(F.array_sort(F.collect_list(F.struct("key", encode_json_value(F.col("raw")).alias("text")))).alias("m")).select(F.to_json(F.map_from_entries(F.transform("m", lambda x: F.struct(x["key"], F.parse_json(x["text"]))))).alias("value"))
