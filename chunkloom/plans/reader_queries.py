"""Queries that go through reference sets, codecs and readers, each with its DuckDB SQL; registers with ``queries``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import calendars, encoding, keys
from chunkloom.functions.codecs import encode_chunk, numpy_dtype
from chunkloom.operators import fmrc, multi, rewrite
from chunkloom.operators.combine import number_values
from chunkloom.plans import recipes as r
from chunkloom.plans.queries import _whole_axis, query
from chunkloom.sources import dataset, references


def _meta(shape: list[int], chunks: list[int], dtype: str, **more) -> dict:
    return {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "fill_value": None, "order": "C", "compressor": {"id": "zlib"}, "filters": None} | more


def _chunk_refs(values: DataFrame, meta: dict) -> DataFrame:
    """(key, path, offset, size, raw) of arrays from (var, number, values): one inline chunk a row, packed as ``meta`` says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [encode_chunk(np.resize(np.asarray(v, np.float64), meta["chunks"]), meta | {"filters": [f for f in meta["filters"] or [] if f["id"] != "physical"]}) for v in b["values"]]
            tail = [".".join([str(n), *["0"] * (len(meta["shape"]) - 1)]) for n in b["number"]]
            yield pd.DataFrame({"key": [f"{v}/{t}" for v, t in zip(b["var"], tail, strict=True)], "path": None, "offset": None, "size": None, "raw": raw}).astype({"offset": "Int64", "size": "Int64"})

    shape = "key string, path string, offset bigint, size bigint, raw binary"
    chunks = values.select("var", "number", "values").mapInPandas(run, shape)
    none = F.lit(None)
    heads = values.select("var").distinct().select(F.concat("var", F.lit("/.zarray")).alias("key"), none.cast("string"), none.cast("bigint"), none.cast("bigint"), F.lit(json.dumps(meta).encode()))
    return chunks.union(heads)


def _embedding_refs(spark: SparkSession, d: str) -> DataFrame:
    """An array for each label: a row a vector (by vec_id), in a shuffled and deflated chunk of its own."""
    e = r.table(spark, d, "embeddings").filter("label is not null")
    width, rows = e.agg(F.max(F.size("embedding")), F.max("vec_id")).first()
    meta = _meta([rows + 1, width], [1, width], "<f4", filters=[{"id": "shuffle", "elementsize": 4}], fill_value="NaN")
    return _chunk_refs(e.select(F.col("label").cast("string").alias("var"), F.col("vec_id").alias("number"), F.col("embedding").alias("values")), meta)


_CELLS_SQL = "cells AS (SELECT label, vec_id, unnest(embedding) AS value, unnest(range(len(embedding))) AS x FROM embeddings WHERE label IS NOT NULL)"


@query(f"WITH {_CELLS_SQL} SELECT x, max(CAST(value AS DOUBLE)) AS top FROM cells GROUP BY x")
def cells_max_over_time(spark: SparkSession, d: str) -> DataFrame:
    c = dataset.open_cells(_embedding_refs(spark, d))
    return c.groupBy(F.get("position", F.lit(1)).alias("x")).agg(F.max("value").alias("top"))


@query(f"WITH {_CELLS_SQL} SELECT label, x, round(avg(CAST(value AS DOUBLE)), 9) AS mean FROM cells GROUP BY label, x")
def cells_mean(spark: SparkSession, d: str) -> DataFrame:
    c = dataset.open_cells(_embedding_refs(spark, d))
    return c.groupBy(F.col("var").cast("int").alias("label"), F.get("position", F.lit(1)).alias("x")).agg(F.round(F.avg("value"), 9).alias("mean"))


#: Records in a chunk of the table of events, and cells along an axis that has no end: chunks that no task wrote hold nothing.
EVENT_ROWS, ENDLESS = 4096, 1 << 31
#: The records: whether one is there (the last of a chunk may not be), whether its event_id is, and the stored value.
EVENT_FIELDS = [["used", "|b1"], ["known", "|b1"], ["event_id", "<i8"], ["value", "<f8"]]


def _event_refs(spark: SparkSession, events: DataFrame) -> DataFrame:
    """(key, path, offset, size, raw) of a table of records (task, row) from (event_id, value): whole numbers below the values, to be scaled when read.

    Rows are placed by the task that reads them and not by event_id, so ids may be null, negative, repeated or far apart, and no row is shuffled.
    """
    meta = _meta([ENDLESS, ENDLESS], [1, EVENT_ROWS], EVENT_FIELDS, filters=[{"id": "physical", "field": "value", "scale": 2.0, "zero": 1.5}])
    stored = meta | {"filters": None}  # the scale is of the physical values; what is stored is packed only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for first in range(0, b.num_rows, EVENT_ROWS):
                ids, values = b.slice(first, EVENT_ROWS).columns
                chunk = np.zeros((1, EVENT_ROWS), numpy_dtype(EVENT_FIELDS))
                part = chunk[0, : len(ids)]
                part["used"], part["known"] = True, ids.is_valid().to_numpy(zero_copy_only=False)
                part["event_id"], part["value"] = ids.fill_null(0).to_numpy(), np.floor(values.to_numpy())
                yield pa.RecordBatch.from_pydict({"key": [f"events/{task}.{n}"], "raw": pa.array([encode_chunk(chunk, stored)], pa.binary())})
                n += 1

    none = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("size")]
    chunks = events.select("event_id", "value").mapInArrow(run, "key string, raw binary").select("key", *none, "raw")
    return chunks.union(spark.range(1).select(F.lit("events/.zarray").alias("key"), *none, F.lit(json.dumps(meta).encode())))


@query("SELECT event_id, CAST(floor(value) AS DOUBLE) * 2.0 + 1.5 AS physical FROM events WHERE value IS NOT NULL")
def scale_offset(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events").filter("value is not null")
    rows = dataset.open_records(_event_refs(spark, e), {"used": "boolean", "known": "boolean", "event_id": "bigint", "value": "double"})
    return rows.filter("used").select(F.when(F.col("known"), F.col("event_id")).alias("event_id"), F.col("value").alias("physical"))


@query(f"WITH {r.MANIFEST_SQL} SELECT ds_idx, key, path, \"offset\", size FROM m")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d)
    listed = F.parse_json(F.format_string('["%s",%d,%d]', F.replace("path", F.lit("s3://arc"), F.lit("{{u}}")), "offset", "size"))
    t = m.select("ds_idx", F.col("path").alias("ds_url"), F.create_map(F.lit("u"), F.lit("s3://arc")).alias("templates"), "key", listed.alias("x"))
    return references._references(t).select("ds_idx", "key", "path", "offset", "size")


@query("""SELECT n_nationkey AS ds_idx, 'v/' || i || '.' || j AS key, 's3://' || n_name || '/' || w || '_' || i AS path, CAST((i + 1) * 1000 + n_nationkey AS BIGINT) AS "offset", CAST(100 + j AS BIGINT) AS size
FROM nation, range(5) a(i), range(0, 6, 2) b(j), (VALUES ('x'), ('y')) c(w) UNION ALL SELECT n_nationkey, 'k', 's3://' || n_name || '/plain', 7, 8 FROM nation""")
def gen_expand(spark: SparkSession, d: str) -> DataFrame:
    n = r.table(spark, d, "nation")
    head = F.concat(F.lit('{"version":1,"templates":{"u":"s3://'), "n_name", F.lit('","p":"{{u}}/{{w}}_{{i}}"},"gen":[{"key":"v/{{i}}.{{j}}","url":"{{p(w=w,i=i)}}","offset":"{{(i + 1) * 1000 + '), F.col("n_nationkey").cast("string"))
    tail = F.lit('}}","length":"{{100 + j}}","dimensions":{"i":{"stop":5},"j":{"stop":6,"step":2},"w":["x","y"]}}],"refs":{"k":["{{u}}/plain",7,8]}}')
    docs = n.select(F.col("n_nationkey").cast("int").alias("ds_idx"), F.col("n_name").alias("ds_url"), F.concat(head, tail).alias("value"))
    rows = docs.mapInPandas(references._expanded, "ds_idx int, ds_url string, key string, x string")
    rows = rows.select("ds_idx", "ds_url", F.create_map().cast("map<string,string>").alias("templates"), "key", F.parse_json("x").alias("x"))
    return references._references(rows).select("ds_idx", "key", "path", "offset", "size")


@query(f"""WITH {r.MANIFEST_SQL} SELECT ds_idx, key, CASE WHEN i = 0 THEN '["' || path || '",' || "offset" || ',' || size || ']' ELSE '"' || var || '"' END AS value FROM m WHERE i = 1 OR size > 0""")
def json_reference_values(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).filter("index[0] = 1 or size > 0")
    inline = F.when(F.get("index", F.lit(0)) == 1, F.encode("var", "UTF-8"))
    refs = m.withColumn("raw", inline).withColumn("key", F.concat(F.col("ds_idx").cast("string"), F.lit("|"), "key"))
    e = references.json_entries(refs)
    return e.select(F.split_part("key", F.lit("|"), F.lit(1)).cast("int").alias("ds_idx"), F.split_part("key", F.lit("|"), F.lit(2)).alias("key"), "value")


def _input_refs(spark: SparkSession, d: str) -> DataFrame:
    """Reference sets of recipe M: for each input its coordinate t (big-endian, inline), a variable's chunks, and metadata."""
    m = r.manifest(spark, d)
    c = r.coordinates(spark, d)
    none = F.lit(None)
    url = F.concat(F.lit("s3://arc/"), F.col("ds_idx").cast("string"), F.lit(".nc"))
    meta = lambda dtype, n: F.concat(F.lit('{"zarr_format":2,"order":"C","compressor":null,"filters":null,"fill_value":null,"dtype":"' + dtype + '","shape":['), n.cast("string"), F.lit('],"chunks":['))
    inline = lambda frame, key, text: frame.select("ds_idx", url.alias("ds_url"), key.alias("key"), none.cast("string").alias("path"), none.cast("bigint").alias("offset"), none.cast("bigint").alias("size"), text.alias("raw"))
    t = c.groupBy("ds_idx").agg(F.array_sort(F.collect_list("value")).alias("v"))  # eight values an input
    hexes = F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 16, "0")), "")
    out = inline(t, F.lit("t/0"), F.unhex(hexes))
    out = out.union(inline(t, F.lit("t/.zarray"), F.encode(F.concat(meta(">i8", F.size("v")), F.size("v").cast("string"), F.lit("]}")), "UTF-8")))
    out = out.union(inline(t, F.lit("t/.zattrs"), F.lit(b'{"_ARRAY_DIMENSIONS":["t"],"units":"steps"}')))
    out = out.union(inline(t, F.lit(".zgroup"), F.lit(b'{"zarr_format":2}')))
    a = r.arrays(spark, d)
    out = out.union(inline(a, F.concat("var", F.lit("/.zarray")), F.encode(F.concat(meta("<f8", F.get("shape", F.lit(0))), F.lit("4]}")), "UTF-8")))
    out = out.union(inline(a, F.concat("var", F.lit("/.zattrs")), F.lit(b'{"_ARRAY_DIMENSIONS":["t"]}')))
    return out.union(m.select("ds_idx", url, "key", "path", "offset", "size", none.cast("binary")))


_COMBINED_SQL = f"""WITH {r.MANIFEST_SQL}, {r.COORDINATES_SQL}, u AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS ord FROM (SELECT DISTINCT value FROM c)),
s AS (SELECT ds_idx, ord FROM (SELECT ds_idx, min(value) AS value FROM c GROUP BY ds_idx) JOIN u USING (value))"""


@query(_COMBINED_SQL + """ SELECT var || '/' || (ord // 4 + i) AS key, path, "offset", size, NULL AS shape FROM m JOIN s USING (ds_idx)
UNION ALL SELECT DISTINCT var || '/.zarray', NULL, NULL, NULL, (SELECT count(*) FROM u) FROM m
UNION ALL SELECT 't/.zarray', NULL, NULL, NULL, (SELECT count(*) FROM u)""")
def combined_references(spark: SparkSession, d: str) -> DataFrame:
    out = multi.combine_references(_input_refs(spark, d), "t", inline_threshold=0)
    last = F.element_at(F.split("key", "/"), -1)
    shape = F.when(last == ".zarray", F.try_variant_get(F.try_parse_json(F.col("raw").cast("string")), "$.shape[0]", "bigint"))
    return out.filter((last == ".zarray") | F.col("path").isNotNull()).select("key", "path", "offset", "size", shape.alias("shape"))


@query(f"WITH {r.COORDINATES_SQL} SELECT dense_rank() OVER (ORDER BY value) - 1 AS ord, CAST(value AS DOUBLE) AS value FROM (SELECT DISTINCT value FROM c WHERE value IS NOT NULL)")
def store_coordinates(spark: SparkSession, d: str) -> DataFrame:
    c = r.coordinates(spark, d)
    axis = multi.Axis("t", c.select("ds_idx", "value"), "<i8")
    n = number_values(c.select("value"))
    refs = multi._stored_axis(axis, n, n.count(), None, None)
    return dataset.open_cells(refs).select(F.get("position", F.lit(0)).alias("ord"), "value")


@query("""SELECT event_id, strftime(make_date(2000, 1, 1), '%Y') IS NOT NULL AS ok, printf('%04d-%02d-%02dT00:00:00', CAST(2000 + event_id // 360 AS INTEGER), CAST(event_id % 360 // 30 + 1 AS INTEGER), CAST(event_id % 30 + 1 AS INTEGER)) AS even,
strftime(TIMESTAMP '2000-01-01' + to_hours(CAST(event_id AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS usual FROM events""")
def calendar_times(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events").select("event_id")
    even = calendars.cf_text(F.col("event_id"), F.lit("days since 2000-01-01"), F.lit("360_day"))
    usual = calendars.cf_text(F.col("event_id"), F.lit("hours since 2000-01-01"), F.lit(None).cast("string"))
    return e.select("event_id", F.lit(True).alias("ok"), even.alias("even"), usual.alias("usual"))


@query("SELECT event_id, split_part(event_type || chr(1) || 'tail', chr(1), 1) AS name, CAST(event_id AS DECIMAL(20,0)) AS number, '{\"a\":' || event_id || ',\"b\":[1,2]}' AS small FROM events")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events")
    raw = F.unhex(F.lpad(F.hex("event_id"), 16, "0"))
    loose = F.encode(F.concat(F.lit(' { "a" : '), F.col("event_id").cast("string"), F.lit(' , "b" : [ 1, 2 ] } ')), "UTF-8")
    return e.select("event_id", keys.nul_trim(F.concat("event_type", F.lit("\0tail"))).alias("name"), encoding.big_endian(raw).alias("number"), encoding.encode_json_value(loose).alias("small"))


@query(f"""WITH {r.MANIFEST_SQL} SELECT ds_idx, var, (i * 4 + p) // 2 AS a, (i * 4 + p) % 2 AS b, "offset" + p * (size // 4) AS "offset", size // 4 AS size FROM m, range(4) t(p)""")
def subchunk_two_axes(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).withColumn("raw", F.lit(None).cast("binary"))
    s = rewrite.subchunk(m.withColumn("index", F.array(F.get("index", F.lit(0)), F.lit(0))), [4, 6], [2, 6], 4)
    return s.select("ds_idx", "var", F.get("index", F.lit(0)).alias("a"), F.get("index", F.lit(1)).alias("b"), "offset", "size")


@query(f"""WITH {r.K_INDEX_SQL}, n AS (SELECT varname, max(nlev) AS nlev FROM lev GROUP BY varname), s AS (SELECT count(DISTINCT run) AS nt, count(DISTINCT step_h) AS ns FROM k)
SELECT g || '/' || x AS key, shape FROM (SELECT varname || '/instant/surface' AS g, varname AS x, nt || ',' || ns || CASE WHEN nlev > 1 THEN ',' || nlev ELSE '' END || ',2,3' AS shape FROM n, s
UNION ALL SELECT varname || '/instant/surface', 'step', CAST(ns AS VARCHAR) FROM n, s UNION ALL SELECT varname || '/instant/surface', 'time', CAST(nt AS VARCHAR) FROM n, s
UNION ALL SELECT varname || '/instant/surface', 'valid_time', nt || ',' || ns FROM n, s UNION ALL SELECT varname || '/instant/surface', 'surface', CAST(nlev AS VARCHAR) FROM n WHERE nlev > 1)""")
def fmrc_store_arrays(spark: SparkSession, d: str) -> DataFrame:
    k = r.k_index(spark, d)
    base = k.select(F.concat_ws("/", "varname", F.lit("instant/surface"), "varname").alias("at")).distinct()
    zarray = F.lit(b'{"shape":[1,1,2,3],"chunks":[1,1,2,3],"dtype":"<f8","fill_value":"NaN","filters":null,"compressor":null,"order":"C","zarr_format":2}')
    store = base.select(F.concat("at", F.lit("/.zarray")).alias("key"), zarray.alias("raw")).union(base.select(F.concat("at", F.lit("/.zattrs")), F.lit(b'{"_ARRAY_DIMENSIONS":["time","step","latitude","longitude"]}')))
    axes = {"step": _whole_axis(spark, d, "step"), "time": _whole_axis(spark, d, "time")}
    out = fmrc.reinflate_store(k, fmrc.Aggregation.RUN_TIME, axes, store)
    arrays = out.filter("key like '%/.zarray'")
    shape = F.try_variant_get(F.try_parse_json(F.col("raw").cast("string")), "$.shape", "array<bigint>")
    return arrays.select(F.regexp_replace("key", r"/\.zarray$", "").alias("key"), F.array_join(shape.cast("array<string>"), ",").alias("shape"))


@query(f"""WITH {r.K_INDEX_SQL}, t AS (SELECT DISTINCT run FROM k), s AS (SELECT DISTINCT step_h FROM k)
SELECT dense_rank() OVER (ORDER BY run) - 1 AS i, dense_rank() OVER (ORDER BY step_h) - 1 AS j, CAST(epoch(run) + step_h * 3600 AS DOUBLE) AS seconds FROM t, s""")
def fmrc_valid_time_cells(spark: SparkSession, d: str) -> DataFrame:
    axes = {"step": _whole_axis(spark, d, "step"), "time": _whole_axis(spark, d, "time")}
    c = fmrc.time_coordinates(fmrc.Aggregation.RUN_TIME, axes).filter("name = 'valid_time'")
    return c.select(F.col("part").cast("bigint").alias("i"), F.posexplode("values").alias("j", "seconds")).select("i", F.col("j").cast("bigint").alias("j"), F.col("seconds").cast("double").alias("seconds"))
