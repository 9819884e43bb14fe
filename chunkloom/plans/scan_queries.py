"""Queries for what scanners and trees derive, each with its DuckDB SQL; registers with ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import encoding
from chunkloom.operators import scanning, tree
from chunkloom.plans import recipes as r
from chunkloom.plans.queries import query


@query("SELECT l_orderkey, l_linenumber, l_quantity, [CAST(l_orderkey // 100 AS INTEGER), CAST(l_partkey // 7 AS INTEGER)][2] AS second, CAST(l_orderkey // 100 AS INTEGER) AS first, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey + 10 - 4 ELSE l_suppkey + 10 END AS size FROM lineitem")
def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = r.table(spark, d, "lineitem").withColumn("n", scanning.chunk_number(F.array("l_orderkey", "l_partkey"), F.array(F.lit(100), F.lit(7))))
    return n.select("l_orderkey", "l_linenumber", "l_quantity", F.get("n", F.lit(1)).alias("second"), F.get("n", F.lit(0)).alias("first"), scanning.trim_checksum(F.col("l_suppkey") + 10, F.col("l_linenumber") % 2 == 0).alias("size"))


@query("SELECT event_id, CASE n WHEN 1 THEN 'zlib' WHEN 2 THEN 'shuffle' WHEN 32015 THEN 'zstd' END AS codec, CASE WHEN n IN (1, 2, 32015) THEN 'decode' WHEN event_id % 50 < 20 THEN 'inline' ELSE 'fail' END AS action FROM (SELECT event_id, [1, 2, 6, 32015, 32004][event_id % 5 + 1] AS n FROM events)")
def filter_codecs(spark: SparkSession, d: str) -> DataFrame:
    n = F.get(F.array(*map(F.lit, (1, 2, 6, 32015, 32004))), (F.col("event_id") % 5).cast("int"))
    return r.table(spark, d, "events").select("event_id", scanning.filter_codec(n).alias("codec"), scanning.unsupported_action(n, F.col("event_id") % 50, 20).alias("action"))


@query("SELECT c_custkey, 1 + CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1 END AS n_attrs FROM customer")
def transferred_attributes(spark: SparkSession, d: str) -> DataFrame:
    attrs = F.create_map(F.lit("CLASS"), F.lit("x"), F.lit("_FillValue"), F.lit("0"), F.lit("units"), F.col("c_name"), F.lit("role"), F.when(F.col("c_nationkey") % 2 == 0, "DIMENSION_SCALE").otherwise("y"))
    return r.table(spark, d, "customer").select("c_custkey", F.size(scanning.passed_attrs(attrs)).alias("n_attrs"))


@query("""SELECT c_name AS "array", axis, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN c_name ELSE 'phony_dim_' || axis END AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1), (2)) t(axis)""")
def dimension_naming(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    c = r.table(spark, d, "customer").join(r.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.withColumn("axis", F.explode(F.array(*map(F.lit, range(3)))))
    scales = F.when(k == 0, F.array("n_name")).when((k == 1) & (F.col("axis") == 2), F.array("n_name", "c_name")).otherwise(F.array().cast("array<string>"))
    return scanning.dimension_names(c.select(F.col("c_name").alias("array"), "axis", scales.alias("scales"), (k == 1).alias("is_scale")))


@query("SELECT p_name AS var, p_name || '/' || i || CASE WHEN p_size % 2 = 0 THEN '.0' ELSE '' END AS key, p_partkey + i * 100 AS \"offset\", CAST(p_size AS BIGINT) AS size FROM part, range(50) t(i) WHERE i < p_size % 5 + 1")
def netcdf_records(spark: SparkSession, d: str) -> DataFrame:
    p = r.table(spark, d, "part").select(F.col("p_name").alias("var"), F.when(F.col("p_size") % 2 == 0, 2).otherwise(1).alias("rank"), F.col("p_partkey").alias("begin"), F.col("p_size").cast("bigint").alias("nbytes"), (F.col("p_size") % 5 + 1).alias("n_records"), F.lit(100).alias("step"))
    return scanning.record_chunks(p)


@query("SELECT p_brand || p_size AS file, CAST(CASE WHEN count(*) = 1 THEN sum(p_size) ELSE sum(p_size + (4 - p_size % 4) % 4) END AS BIGINT) AS step FROM part GROUP BY 1")
def netcdf_record_step(spark: SparkSession, d: str) -> DataFrame:
    return scanning.record_step(r.table(spark, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("file"), F.col("p_size").cast("bigint").alias("nbytes")))


@query(f"WITH {r.K_INDEX_SQL} SELECT varname, run, level, uri FROM k WHERE level IN (1, 2) AND varname = 'view'")
def grib_message_filter(spark: SparkSession, d: str) -> DataFrame:
    k = r.k_index(spark, d).select("varname", F.col("time").alias("run"), "level", "uri")
    return scanning.message_filter(k, {"level": [1.0, 2.0], "varname": "view"})


@query(f"""WITH {r.K_INDEX_SQL}, n AS (SELECT uri, "offset", row_number() OVER (PARTITION BY uri ORDER BY "offset") AS idx FROM k) SELECT uri, "offset", CAST(idx AS INTEGER) AS idx FROM n WHERE idx <= 3""")
def grib_first_messages(spark: SparkSession, d: str) -> DataFrame:
    return scanning.first_messages(r.k_index(spark, d).select("uri", "offset"), 3)


@query("""SELECT 'f' || o_custkey AS uri, o_orderkey AS line_no, last_value(CASE WHEN o_orderkey % 3 = 0 THEN 'O' || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS object, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS value FROM orders
QUALIFY object IS NOT NULL AND value IS NOT NULL""")
def archive_object_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("  OBJECT = O"), k.cast("string"))).otherwise(F.concat(F.lit('  VALUE = "'), "o_orderstatus", F.lit('"')))
    return scanning.object_values(r.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("uri"), k.alias("line_no"), line.alias("value")))


@query("SELECT DISTINCT c_custkey AS ref FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 <> 0)")
def root_groups(spark: SparkSession, d: str) -> DataFrame:
    return scanning.roots(r.table(spark, d, "customer").select(F.col("c_custkey").alias("ref")), r.table(spark, d, "orders").filter("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("child")))


@query("SELECT p_partkey, 10.5 + (p_size + 1 - 3.0) * 0.25 AS world FROM part")
def wcs_linear(spark: SparkSession, d: str) -> DataFrame:
    return r.table(spark, d, "part").select("p_partkey", scanning.linear_world(F.col("p_size"), F.lit(3.0), F.lit(10.5), F.lit(0.25)).alias("world"))


@query("SELECT o_orderkey, o_custkey AS id, c_name AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0")
def vlen_lookup(spark: SparkSession, d: str) -> DataFrame:
    labels = r.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return scanning.vlen_labels(r.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), labels)


@query(f"""WITH {r.K_INDEX_SQL}, m AS (SELECT * FROM k WHERE varname <> 'view'),
x AS (SELECT *, dense_rank() OVER (PARTITION BY varname ORDER BY run) - 1 AS ti, dense_rank() OVER (PARTITION BY varname ORDER BY step_h) - 1 AS si, dense_rank() OVER (PARTITION BY varname ORDER BY level) - 1 AS li FROM m),
n AS (SELECT varname, count(DISTINCT level) AS nl FROM m GROUP BY varname)
SELECT varname || '/instant/surface/' || varname || '/' || ti || '.' || si || CASE WHEN nl > 1 THEN '.' || li ELSE '' END || '.0.0' AS key, uri, "offset", length FROM x JOIN n USING (varname)""")
def grib_tree(spark: SparkSession, d: str) -> DataFrame:
    k = r.k_index(spark, d).withColumn("varname", F.when(F.col("varname") == "view", "unknown").otherwise(F.col("varname")))
    return tree.message_tree(k).select("key", "uri", "offset", "length")


@query("SELECT count(*) FILTER (event_type = 'view') AS unknown, count(*) FILTER (event_type = 'click') AS unnamed FROM events")
def grib_dropped(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("event_type")
    return tree.dropped_messages(r.table(spark, d, "events").select(F.when(v == "view", "unknown").when(v != "click", v).alias("varname")))


@query(f"""WITH {r.MANIFEST_SQL}, {r.COORDINATES_SQL}, u AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS ord FROM (SELECT DISTINCT value FROM c))
SELECT value AS t, path AS uri, CASE WHEN i = 1 THEN -1 ELSE "offset" END AS "offset", CASE WHEN i = 1 THEN -1 ELSE size END AS length, CASE WHEN i = 1 THEN 'eA==' END AS inline_value FROM m JOIN u ON m.ds_idx = u.ord""")
def extract_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    from chunkloom.operators.combine import union_coordinates

    m = r.manifest(spark, d)
    refs = m.select(F.array("ds_idx", F.lit(0)).alias("index"), "path", "offset", "size", F.when(F.get("index", F.lit(0)) == 1, F.lit(b"x")).alias("raw"))
    return tree.extract_chunk_index(refs, union_coordinates(r.coordinates(spark, d)), ["t", "x"], {"t": (9, 1), "x": (10, 10)})


@query("""SELECT 'r' || r_regionkey || '/n' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region""")
def inherited_attributes(spark: SparkSession, d: str) -> DataFrame:
    reg, nat = r.table(spark, d, "region"), r.table(spark, d, "nation")
    path = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    top = reg.select(path.alias("path"), F.create_map(F.lit("a"), "r_name").alias("attrs"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), "n_name")).otherwise(F.create_map(F.lit("b"), "n_name"))
    low = nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(path, F.lit("/n"), F.col("n_nationkey").cast("string")).alias("path"), own.alias("attrs"))
    return tree.inherited_attribute(top.union(low), "a")


@query("SELECT event_id AS pos, [0, 15, 45][event_id % 3 + 1] AS step, CAST(event_id // ((SELECT count(*) + 6 FROM events) // 7) AS INTEGER) AS batch FROM events")
def tiled_steps(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events").select(F.col("event_id").alias("pos"))
    return tree.tiled_steps(e, [0, 15, 45]).withColumn("batch", tree.batch_number(F.col("pos"), e.count(), 7))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'false' ELSE 'true' END WHEN 3 THEN base64(encode(event_type)) END AS fill FROM events")
def fill_values(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("event_id") % 5, F.col("event_id")
    value = F.when(k == 0, "nan").when(k == 1, e.cast("string")).when(k == 2, (e % 2).cast("string")).when(k == 3, F.col("event_type"))
    kind = F.get(F.array(*map(F.lit, "fibSU")), k.cast("int"))
    return r.table(spark, d, "events").select("event_id", encoding.encode_fill_value(value, kind).alias("fill"))
