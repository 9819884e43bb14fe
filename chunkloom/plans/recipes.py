"""Manifests derived from the TPC-H-like tables, which hold no scientific files.

M: chunk references from orders; K: a forecast chunk index from events; I: index lines from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds_idx, var, index, path, offset, size): 8 coordinate values an input, in chunks of 4."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    t = F.expr("cast(o_orderkey div 32 as int)")
    g = o.withColumn("t", t).withColumn("ds_idx", F.expr("t div 8").cast("int")).withColumn("i", F.expr("(t % 8) div 4").cast("int"))
    g = g.groupBy("ds_idx", F.col("o_orderpriority").alias("var"), "i").agg((F.min("o_orderkey") * 1000).alias("offset"), (F.sum(F.floor("o_totalprice").cast("bigint")) % 5000).alias("size"))
    path = F.concat(F.lit("s3://arc/"), F.col("ds_idx").cast("string"), F.lit(".nc"))
    return g.select("ds_idx", "var", F.array("i").alias("index"), path.alias("path"), "offset", "size", F.concat("var", F.lit("/"), F.col("i").cast("string")).alias("key"))


MANIFEST_SQL = """m AS (SELECT ds_idx, var, i, 's3://arc/' || ds_idx || '.nc' AS path, "offset", size, var || '/' || i AS key FROM (
  SELECT CAST(t // 8 AS INTEGER) AS ds_idx, var, CAST((t % 8) // 4 AS INTEGER) AS i, min(k) * 1000 AS "offset", CAST(sum(p) % 5000 AS BIGINT) AS size
  FROM (SELECT o_orderkey // 32 AS t, o_orderkey AS k, o_orderpriority AS var, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) GROUP BY ALL))"""


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds_idx, dim, value) of recipe M."""
    t = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 32").alias("value")).distinct()
    return t.select(F.expr("cast(value div 8 as int)").alias("ds_idx"), F.lit("t").alias("dim"), "value")


COORDINATES_SQL = """c AS (SELECT DISTINCT CAST((o_orderkey // 32) // 8 AS INTEGER) AS ds_idx, 't' AS dim, o_orderkey // 32 AS value FROM orders)"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds_idx, var, dims, shape, chunks, itemsize): one array per input and variable of recipe M."""
    m = manifest(spark, sf_dir).groupBy("ds_idx", "var").agg(F.max(F.get("index", F.lit(0))).alias("top"))
    return m.select("ds_idx", "var", F.array(F.lit("t")).alias("dims"), F.array(((F.col("top") + 1) * 4).cast("bigint")).alias("shape"), F.array(F.lit(4).cast("bigint")).alias("chunks"), F.lit(8).alias("itemsize"))


ARRAYS_SQL = """a AS (SELECT ds_idx, var, CAST((max(i) + 1) * 4 AS BIGINT) AS n, CAST(4 AS BIGINT) AS ch FROM m GROUP BY ds_idx, var)"""


def k_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk index from events: runs every 6 hours, steps 0 to 5 hours, levels 0 to 3."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    run = F.window(F.col("ts").cast("timestamp_ntz"), "6 hours")["start"].cast("timestamp_ntz")
    e = e.select(F.col("event_type").alias("varname"), run.alias("time"), (F.col("event_id") % 6).cast("int").alias("step_h"), (F.col("user_id") % 4).cast("double").alias("level"), "event_id", "user_id")
    g = e.groupBy("varname", "time", "step_h", "level").agg(F.min_by(F.struct("event_id", "user_id"), "event_id").alias("e"))
    step = F.make_dt_interval(F.lit(0), F.col("step_h"))
    return g.select(
        "varname", F.lit("surface").alias("typeOfLevel"), F.lit("instant").alias("stepType"), F.col("varname").alias("name"), step.alias("step"), "step_h", "level", "time", (F.col("time") + step).alias("valid_time"),
        F.concat(F.lit("s3://gfs/"), F.col("e.user_id").cast("string")).alias("uri"), (F.col("e.event_id") * 1000).alias("offset"), (F.lit(100) + F.col("e.event_id") % 900).alias("length"), F.lit(None).cast("string").alias("inline_value"),
    )


K_INDEX_SQL = """k AS (SELECT varname, run, step_h, level, 's3://gfs/' || u AS uri, eid * 1000 AS "offset", 100 + eid % 900 AS length FROM (
  SELECT event_type AS varname, time_bucket(INTERVAL 6 HOUR, ts) AS run, CAST(event_id % 6 AS INTEGER) AS step_h, CAST(user_id % 4 AS DOUBLE) AS level, min(event_id) AS eid, arg_min(user_id, event_id) AS u
  FROM events GROUP BY ALL)),
lev AS (SELECT varname, level, dense_rank() OVER (PARTITION BY varname ORDER BY level) - 1 AS lord, count(*) OVER (PARTITION BY varname) AS nlev FROM (SELECT DISTINCT varname, level FROM k))"""


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, line_no, value): index text of one file a user, a line an event."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    uri = F.concat(F.lit("s3://idx/"), F.col("user_id").cast("string"))
    date = F.date_format("ts", "yyyyMMddHH")
    attrs = F.concat_ws(":", F.col("event_type"), F.concat(F.lit("level "), (F.col("event_id") % 7).cast("string")), F.lit("fcst"), F.lit(""))
    value = F.concat_ws(":", (F.col("event_id") % 1000).cast("string"), (F.col("event_id") * 100).cast("string"), F.concat(F.lit("d="), date), attrs)
    return e.select(uri.alias("uri"), F.col("event_id").alias("line_no"), value.alias("value"))


LINES_SQL = """l AS (SELECT 's3://idx/' || user_id AS uri, event_id AS line_no, (event_id % 1000) || ':' || (event_id * 100) || ':d=' || strftime(ts, '%Y%m%d%H') || ':' || event_type || ':level ' || (event_id % 7) || ':fcst:' AS value FROM events),
p AS (SELECT uri, line_no, CAST(split_part(value, ':', 1) AS INTEGER) AS idx, CAST(split_part(value, ':', 2) AS BIGINT) AS "offset", split_part(value, ':', 3) AS date,
  regexp_extract(value, '^[^:]*:[^:]*:[^:]*:(.*)$', 1) AS attrs FROM l)"""
