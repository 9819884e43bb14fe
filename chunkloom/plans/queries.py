"""Queries over the manifests of ``recipes``, each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import encoding, keys
from chunkloom.operators import combine, fmrc, idx, rewrite
from chunkloom.plans import recipes as r

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add




# --- index sidecars ---------------------------------------------------------------------------


def _sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("uri").agg((F.max("line_no") * 100 + 5000).alias("file_size"))


@query(f"""WITH {r.LINES_SQL}, s AS (SELECT uri, max(line_no) * 100 + 5000 AS fs FROM l GROUP BY uri)
SELECT p.uri, line_no, idx, "offset", date, attrs, coalesce(lead("offset") OVER (PARTITION BY p.uri ORDER BY line_no), fs) - "offset" AS length FROM p JOIN s ON p.uri = s.uri""")
def idx_parse_lead_length(spark: SparkSession, d: str) -> DataFrame:
    lines = r.index_lines(spark, d)
    return idx.message_lengths(idx.parse_lines(lines), _sizes(lines)).select("uri", "line_no", "idx", "offset", "date", "attrs", "length")


@query(f"WITH {r.LINES_SQL} SELECT uri, attrs, count(*) AS n FROM p GROUP BY uri, attrs HAVING count(*) > 1")
def idx_duplicate_attrs(spark: SparkSession, d: str) -> DataFrame:
    return idx.duplicate_attrs(idx.parse_lines(r.index_lines(spark, d)))


@query(f"""WITH {r.LINES_SQL} SELECT uri, line_no, attrs, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY uri, attrs ORDER BY line_no) AS n FROM p) WHERE n = 1""")
def idx_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return idx.keep_first(idx.parse_lines(r.index_lines(spark, d))).select("uri", "line_no", "attrs", "offset")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events").filter("event_type <> 'view'")
    return e.select(F.concat(F.lit("s3://idx/"), F.col("user_id").cast("string")).alias("uri"), F.col("event_id").cast("int").alias("idx"), (F.col("event_id") * 100).alias("offset"), F.lit(100).alias("length"), F.col("event_type").alias("varname"))


@query(f"""WITH {r.LINES_SQL}, g AS (SELECT 's3://idx/' || user_id AS uri, CAST(event_id AS INTEGER) AS idx, event_id * 100 AS og, 100 AS lg, event_type AS varname FROM events WHERE event_type <> 'view'),
q AS (SELECT *, lead("offset") OVER (PARTITION BY uri ORDER BY line_no) - "offset" AS length FROM p)
SELECT q.uri, q.line_no, attrs, "offset" AS offset_idx, length AS length_idx, og AS offset_grib, lg AS length_grib, varname FROM q LEFT JOIN g ON q.uri = g.uri AND q.line_no = g.idx""")
def idx_grib_mapping(spark: SparkSession, d: str) -> DataFrame:
    lines = idx.message_lengths(idx.parse_lines(r.index_lines(spark, d)))
    m = idx.grib_mapping(lines.select("uri", F.col("line_no").cast("int").alias("idx"), "line_no", "attrs", "offset", "length"), _messages(spark, d))
    return m.select("uri", "line_no", "attrs", "offset_idx", "length_idx", "offset_grib", "length_grib", "varname")


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    first = idx.keep_first(idx.parse_lines(r.index_lines(spark, d).withColumn("uri", F.lit("all"))))
    step = F.make_dt_interval(F.lit(0), F.substring("attrs", -7, 1).cast("int"))
    return first.select("attrs", F.split_part("attrs", F.lit(":"), F.lit(1)).alias("varname"), F.lit("surface").alias("typeOfLevel"), F.lit("instant").alias("stepType"), F.lit("n").alias("name"), F.make_dt_interval(F.lit(0), F.regexp_extract("attrs", "level ([0-9])", 1).cast("int")).alias("step"), F.lit(0.0).alias("level")).filter("varname <> 'view'")


@query(f"""WITH {r.LINES_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, attrs ORDER BY line_no) AS n FROM p) WHERE n = 1),
t AS (SELECT *, strptime(date, 'd=%Y%m%d%H') AS run, CAST(regexp_extract(attrs, 'level ([0-9])', 1) AS INTEGER) AS h FROM f WHERE split_part(attrs, ':', 1) <> 'view')
SELECT uri, split_part(attrs, ':', 1) AS varname, run AS "time", run + to_hours(h) AS valid_time, "offset" FROM t""")
def map_from_index(spark: SparkSession, d: str) -> DataFrame:
    new = idx.keep_first(idx.parse_lines(r.index_lines(spark, d))).withColumn("length", F.lit(1)).withColumn("run", F.to_timestamp_ntz("date", F.lit("'d='yyyyMMddHH")))
    return idx.map_from_index(new, _mapping(spark, d)).select("uri", "varname", "time", "valid_time", "offset")


# --- forecast collections ---------------------------------------------------------------------

_DAY = dt.datetime(2024, 1, 1)
_GRID_SQL = "v AS (SELECT CAST(x AS INTEGER) AS vo, TIMESTAMP '2024-01-01' + to_hours(CAST(x AS INTEGER)) AS valid FROM range(96) t(x))"
_KEY_SQL = "k.varname || '/instant/surface/' || k.varname || '/' || {i} || CASE WHEN nlev > 1 THEN '.' || lord ELSE '' END || '.0.0'"
_OUT_SQL = 'SELECT {key} AS key, uri, "offset", length FROM {grid} JOIN k ON k.run = g.run AND k.step_h = g.h JOIN lev ON lev.varname = k.varname AND lev.level = k.level'


def _valid(spark: SparkSession, hours: int = 96) -> DataFrame:
    return spark.range(hours).select(F.col("id").cast("int").alias("valid_time_ord"), (F.lit(_DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("valid_time"))


def _steps(spark: SparkSession, hours: int = 3) -> DataFrame:
    return spark.range(hours).select(F.col("id").cast("int").alias("step_ord"), F.make_dt_interval(F.lit(0), F.col("id").cast("int")).alias("step"))


def _fmrc(spark: SparkSession, d: str, kind: fmrc.Aggregation, axes: dict, ref=None) -> DataFrame:
    return fmrc.reinflate(r.k_index(spark, d), kind, axes, ref).select("key", "uri", "offset", "length")


@query(f"WITH {r.K_INDEX_SQL}, {_GRID_SQL}, g AS (SELECT h, vo, valid - to_hours(CAST(h AS INTEGER)) AS run, h || '.' || vo AS i FROM v, range(3) t(h)) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_horizon(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark).select(F.col("step_ord").alias("h"), F.lit(0).alias("step_no"), "step")
    return _fmrc(spark, d, fmrc.Aggregation.HORIZON, {"step": steps, "valid_time": _valid(spark)})


@query(f"WITH {r.K_INDEX_SQL}, {_GRID_SQL}, g AS (SELECT h, vo, valid - to_hours(CAST(h AS INTEGER)) AS run, vo || '.' || h AS i FROM v, range(3) t(h)) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_valid_time(spark: SparkSession, d: str) -> DataFrame:
    return _fmrc(spark, d, fmrc.Aggregation.VALID_TIME, {"step": _steps(spark), "valid_time": _valid(spark)})


@query(f"WITH {r.K_INDEX_SQL}, g AS (SELECT h, TIMESTAMP '2024-01-01' + to_hours(CAST(6 * x AS INTEGER)) AS run, x || '.' || h AS i FROM range(8) t(x), range(3) s(h)) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_run_time(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.range(8).select(F.col("id").cast("int").alias("time_ord"), (F.lit(_DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") * 6).cast("int"))).alias("time"))
    return _fmrc(spark, d, fmrc.Aggregation.RUN_TIME, {"step": _steps(spark), "time": runs})


@query(f"""WITH {r.K_INDEX_SQL}, {_GRID_SQL}, g AS (SELECT least(valid, TIMESTAMP '2024-01-03') AS run, CAST(date_diff('hour', least(valid, TIMESTAMP '2024-01-03'), valid) AS INTEGER) AS h, CAST(vo AS VARCHAR) AS i FROM v) """ + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_best_available(spark: SparkSession, d: str) -> DataFrame:
    return _fmrc(spark, d, fmrc.Aggregation.BEST_AVAILABLE, {"valid_time": _valid(spark)}, dt.datetime(2024, 1, 3))


# The same on axes derived from the whole index: every step, valid time and run that it holds.

_AXES_SQL = """v AS (SELECT valid, CAST(dense_rank() OVER (ORDER BY valid) - 1 AS INTEGER) AS vo FROM (SELECT DISTINCT run + to_hours(step_h) AS valid FROM k)),
st AS (SELECT h, CAST(dense_rank() OVER (ORDER BY h) - 1 AS INTEGER) AS so FROM (SELECT DISTINCT step_h AS h FROM k)),
tm AS (SELECT run, CAST(dense_rank() OVER (ORDER BY run) - 1 AS INTEGER) AS ro FROM (SELECT DISTINCT run FROM k))"""


def _whole_axis(spark: SparkSession, d: str, name: str) -> DataFrame:
    values = r.k_index(spark, d).select(name).distinct()
    return values.select((F.dense_rank().over(Window.orderBy(name)) - 1).alias(f"{name}_ord"), name)  # short: one row a cell of the axis


@query(f"WITH {r.K_INDEX_SQL}, {_AXES_SQL}, g AS (SELECT h, valid - to_hours(h) AS run, so || '.' || vo AS i FROM v, st) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_horizon_whole(spark: SparkSession, d: str) -> DataFrame:
    steps = _whole_axis(spark, d, "step").select(F.col("step_ord").alias("h"), F.lit(0).alias("step_no"), "step")
    return _fmrc(spark, d, fmrc.Aggregation.HORIZON, {"step": steps, "valid_time": _whole_axis(spark, d, "valid_time")})


@query(f"WITH {r.K_INDEX_SQL}, {_AXES_SQL}, g AS (SELECT h, valid - to_hours(h) AS run, vo || '.' || so AS i FROM v, st) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_valid_time_whole(spark: SparkSession, d: str) -> DataFrame:
    return _fmrc(spark, d, fmrc.Aggregation.VALID_TIME, {"step": _whole_axis(spark, d, "step"), "valid_time": _whole_axis(spark, d, "valid_time")})


@query(f"WITH {r.K_INDEX_SQL}, {_AXES_SQL}, g AS (SELECT h, run, ro || '.' || so AS i FROM tm, st) " + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_run_time_whole(spark: SparkSession, d: str) -> DataFrame:
    return _fmrc(spark, d, fmrc.Aggregation.RUN_TIME, {"step": _whole_axis(spark, d, "step"), "time": _whole_axis(spark, d, "time")})


@query(f"""WITH {r.K_INDEX_SQL}, {_AXES_SQL}, ref AS (SELECT max(run) AS last FROM k), g AS (SELECT least(valid, last) AS run, CAST(date_diff('hour', least(valid, last), valid) AS INTEGER) AS h, CAST(vo AS VARCHAR) AS i FROM v, ref) """ + _OUT_SQL.format(key=_KEY_SQL.format(i="g.i"), grid="g"))
def fmrc_best_available_whole(spark: SparkSession, d: str) -> DataFrame:
    last = r.k_index(spark, d).agg(F.max("time")).first()[0]
    return _fmrc(spark, d, fmrc.Aggregation.BEST_AVAILABLE, {"valid_time": _whole_axis(spark, d, "valid_time")}, last)


@query(f"WITH {r.K_INDEX_SQL} SELECT varname, level, CAST(lord AS INTEGER) AS level_ord, nlev AS n_levels FROM lev")
def kindex_levels(spark: SparkSession, d: str) -> DataFrame:
    return fmrc.level_axis(r.k_index(spark, d)).select("varname", "level", "level_ord", "n_levels")


_TREE_SQL = """t AS (SELECT DISTINCT event_type || '/' || s || '/surface/' || x AS key FROM events, (VALUES ('instant'), ('avg')) a(s), (VALUES ('.zarray'), ('0.0.0'), ('latitude/0.0'), ('longitude/.zattrs')) b(x)
  UNION ALL SELECT * FROM (VALUES ('.zgroup'), ('other/.zgroup'), ('view/.zgroup'), ('click/instant/.zgroup')) c(key))"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    v = r.table(spark, d, "events").select("event_type").distinct()
    k = v.select("event_type", F.explode(F.array(*map(F.lit, ("instant", "avg")))).alias("s")).select("*", F.explode(F.array(*map(F.lit, (".zarray", "0.0.0", "latitude/0.0", "longitude/.zattrs")))).alias("x"))
    k = k.select(F.concat_ws("/", "event_type", "s", F.lit("surface"), "x").alias("key"))
    return k.union(spark.createDataFrame([(x,) for x in (".zgroup", "other/.zgroup", "view/.zgroup", "click/instant/.zgroup")], "key string"))


@query(f"""WITH {_TREE_SQL}, f AS (SELECT key, array_to_string(string_split(key, '/')[1:least(3, len(string_split(key, '/')) - 1)], '/') AS prefix FROM t),
g AS (SELECT '' AS prefix UNION SELECT event_type FROM events UNION SELECT event_type || '/instant' FROM events UNION SELECT event_type || '/instant/surface' FROM events)
SELECT key FROM f WHERE prefix IN (SELECT prefix FROM g)""")
def group_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return fmrc.group_prefix_filter(_tree(spark, d), r.k_index(spark, d))


@query(f"WITH {_TREE_SQL} SELECT key FROM t WHERE NOT regexp_matches(key, '^(.*)/([0-9]+[0-9.]*)$') OR ends_with(regexp_extract(key, '^(.*)/([0-9]+[0-9.]*)$', 1), 'latitude') OR ends_with(regexp_extract(key, '^(.*)/([0-9]+[0-9.]*)$', 1), 'longitude')")
def strip_datavar(spark: SparkSession, d: str) -> DataFrame:
    return fmrc.strip_data_chunks(_tree(spark, d))


@query("SELECT DISTINCT event_type AS variable FROM events UNION SELECT unnest(['.zgroup', 'other', 'view', 'click'])")
def reference_variables(spark: SparkSession, d: str) -> DataFrame:
    return fmrc.variables(_tree(spark, d))


# --- combine ----------------------------------------------------------------------------------


@query(f"WITH {r.COORDINATES_SQL} SELECT 't' AS dim, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT value FROM c)")
def coords_union(spark: SparkSession, d: str) -> DataFrame:
    return combine.union_coordinates(r.coordinates(spark, d))


@query(f"WITH {r.COORDINATES_SQL} SELECT ds_idx, dim, min(value) AS value FROM c GROUP BY ALL")
def coords_first(spark: SparkSession, d: str) -> DataFrame:
    return combine.first_values(r.coordinates(spark, d))


@query("SELECT 'm' AS dim, count(DISTINCT o_orderstatus) AS n FROM orders WHERE o_orderstatus = 'F' HAVING count(DISTINCT o_orderstatus) < 2")
def coords_thin(spark: SparkSession, d: str) -> DataFrame:
    o = r.table(spark, d, "orders")
    c = o.filter("o_orderstatus = 'F'").select(F.lit("m").alias("dim"), F.col("o_orderstatus").alias("value"))
    return combine.thin_coordinates(c.union(o.select(F.lit("p"), F.col("o_orderpriority"))))


_REKEY_SQL = f"WITH {r.MANIFEST_SQL}, {r.COORDINATES_SQL}, u AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS ord FROM (SELECT DISTINCT value FROM c)), s AS (SELECT ds_idx, ord FROM (SELECT ds_idx, min(value) AS value FROM c GROUP BY ds_idx) JOIN u USING (value))"


@query(_REKEY_SQL + """ SELECT var || '/' || (ord // 4 + i) AS key, path, "offset", size FROM m JOIN s USING (ds_idx)""")
def combine_rekey(spark: SparkSession, d: str) -> DataFrame:
    o = combine.dataset_ordinals(r.coordinates(spark, d))
    out = combine.rekey(r.manifest(spark, d), o, ["t"], ["t"], {"t": 4})
    return out.select(keys.chunk_key(F.col("var"), F.col("index")).alias("key"), "path", "offset", "size")


@query("""WITH b AS (SELECT date_trunc('month', o_orderdate) AS mon, o_orderpriority AS var, min(o_orderkey) AS k FROM orders GROUP BY ALL),
u AS (SELECT mon, dense_rank() OVER (ORDER BY mon) - 1 AS ord FROM (SELECT DISTINCT mon FROM b)) SELECT var || '/' || ord || '.0' AS key, k * 1000 AS "offset" FROM b JOIN u USING (mon)""")
def combine_new_dimension(spark: SparkSession, d: str) -> DataFrame:
    o = r.table(spark, d, "orders")
    mon = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    m = o.groupBy(mon.cast("int").alias("ds_idx"), F.col("o_orderpriority").alias("var")).agg((F.min("o_orderkey") * 1000).alias("offset")).withColumn("index", F.array(F.lit(0)))
    c = m.select("ds_idx", F.lit("month").alias("dim"), F.col("ds_idx").alias("value")).distinct()
    out = combine.rekey(m, combine.dataset_ordinals(c), ["x"], ["month"], {})
    return out.select(keys.chunk_key(F.col("var"), F.col("index")).alias("key"), "offset")


@query(f"WITH {r.MANIFEST_SQL}, {r.COORDINATES_SQL} SELECT DISTINCT var, 't' AS dim, (SELECT count(DISTINCT value) FROM c) AS size FROM m")
def combine_shape(spark: SparkSession, d: str) -> DataFrame:
    return combine.output_shape(r.arrays(spark, d), r.coordinates(spark, d), ["t"])


@query(f"WITH {r.MANIFEST_SQL}, {r.ARRAYS_SQL} SELECT var, min(ds_idx) AS ds_idx, arg_min(n, ds_idx) AS n FROM a GROUP BY var")
def combine_first_meta(spark: SparkSession, d: str) -> DataFrame:
    return combine.first_metadata(r.arrays(spark, d)).select("var", "ds_idx", F.get("shape", F.lit(0)).alias("n"))


@query("SELECT o_orderpriority AS var, count(DISTINCT o_orderkey % 3) AS n FROM orders WHERE o_orderpriority < '3' GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1")
def chunk_mismatch(spark: SparkSession, d: str) -> DataFrame:
    o = r.table(spark, d, "orders").select(F.col("o_orderkey").alias("ds_idx"), F.col("o_orderpriority").alias("var"), F.when(F.col("o_orderpriority") < "3", F.array(F.col("o_orderkey") % 3)).otherwise(F.array(F.lit(1).cast("bigint"))).alias("chunks"))
    return combine.chunk_mismatch(o)


@query(f"WITH {r.MANIFEST_SQL} SELECT DISTINCT var FROM m WHERE var < '3'")
def coordinate_detection(spark: SparkSession, d: str) -> DataFrame:
    a = r.arrays(spark, d).withColumn("dims", F.when(F.col("var") < "3", F.array("var")).otherwise(F.array(F.lit("t"))))
    return combine.coordinate_variables(a)


@query(f"""WITH {r.MANIFEST_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds_idx) AS n FROM m WHERE NOT starts_with(var, '5'))
SELECT ds_idx, key FROM x WHERE NOT (starts_with(var, '1') OR starts_with(var, '2')) OR n = 1""")
def combine_route(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d)
    v = F.col("var")
    return combine.route_by(m, v.startswith("5"), v.startswith("1"), m.filter(v.startswith("2")).select("var").distinct()).select("ds_idx", "key")


@query(f"""WITH {r.MANIFEST_SQL}, {r.COORDINATES_SQL}, b AS (SELECT max(ds_idx) + 1 AS n FROM c WHERE ds_idx % 2 = 0),
c2 AS (SELECT ds_idx, value FROM c WHERE ds_idx % 2 = 0 UNION ALL SELECT ds_idx + n, value FROM c, b WHERE ds_idx % 2 = 1),
u AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS ord FROM (SELECT DISTINCT value FROM c2))
SELECT CAST(ds_idx AS INTEGER) AS ds_idx, 't' AS dim, CAST(ord AS INTEGER) AS ord FROM (SELECT ds_idx, min(value) AS value FROM c2 GROUP BY ds_idx) JOIN u USING (value)""")
def append_rekey(spark: SparkSession, d: str) -> DataFrame:
    c = r.coordinates(spark, d)
    both = combine.append(c.filter("ds_idx % 2 = 0"), c.filter("ds_idx % 2 = 1"))
    return combine.dataset_ordinals(both)


@query(f"WITH {r.MANIFEST_SQL} SELECT DISTINCT path, ds_idx AS by_index, regexp_extract(path, 'arc/([0-9]+)', 1) AS by_group, regexp_extract(path, '[0-9]+[.]nc', 0) AS whole, 7 AS constant, 'x' AS word, 'v' || ds_idx AS attr, (ds_idx % 4 + 1) * 10 AS listed, make_timestamp(1970, 1, 1, 0, 0, 0) + to_days(ds_idx) AS cf FROM m")
def selectors(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).select("ds_idx", "path").distinct()
    attrs = F.concat(F.lit('{"units":"days since 1970-01-01","a":"v'), F.col("ds_idx").cast("string"), F.lit('"}'))
    s = lambda x, i=F.col("ds_idx"): combine.selector(x, url=F.col("path"), ds_idx=i, attrs=attrs, var=F.lit("q"), values=F.col("ds_idx").cast("double"))
    listed = s([10, 20, 30, 40], F.col("ds_idx") % 4)
    return m.select("path", s("INDEX").alias("by_index"), s(re.compile("arc/([0-9]+)")).alias("by_group"), s(re.compile("[0-9]+[.]nc")).alias("whole"), s(7).alias("constant"), s("x").alias("word"), s("attr:a").alias("attr"), listed.alias("listed"), s("cf:q").alias("cf"))


@query(f"WITH {r.MANIFEST_SQL}, n AS (SELECT ds_idx, CAST(max(i) + 1 AS BIGINT) AS n_chunks FROM m GROUP BY ds_idx) SELECT ds_idx, n_chunks, CAST(coalesce(sum(n_chunks) OVER (ORDER BY ds_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def concat_offsets(spark: SparkSession, d: str) -> DataFrame:
    a = r.arrays(spark, d).groupBy("ds_idx").agg(F.max("shape").alias("shape"), F.first("chunks").alias("chunks"))
    return combine.concat_offsets(a, 0)


@query(f"WITH {r.MANIFEST_SQL}, {r.ARRAYS_SQL}, n AS (SELECT ds_idx, max(n) AS n FROM a GROUP BY ds_idx) SELECT CAST(0 AS INTEGER) AS dim_no, CAST(sum(n) AS BIGINT) AS size FROM n UNION ALL SELECT 1, CAST(10 AS BIGINT)")
def concat_shape(spark: SparkSession, d: str) -> DataFrame:
    a = r.arrays(spark, d).groupBy("ds_idx").agg(F.max("shape").alias("shape"))
    return combine.concat_shape(a.withColumn("shape", F.concat("shape", F.array(F.lit(10).cast("bigint")))), 0)


@query(f"""WITH {r.MANIFEST_SQL} SELECT key, max(ds_idx) AS ds_idx, arg_max(path, ds_idx) AS path, arg_max("offset", ds_idx) AS "offset" FROM m GROUP BY key""")
def merge_vars_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return combine.merge_variables(r.manifest(spark, d).select("key", "ds_idx", "path", "offset"))


# --- rewrites ---------------------------------------------------------------------------------


@query(f"""WITH {r.MANIFEST_SQL} SELECT ds_idx, key, CASE WHEN ds_idx % 3 = 0 THEN 'gs://new/' || ds_idx ELSE path END AS path FROM m""")
def rename_target(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).select("ds_idx", "key", "path")
    new = m.filter("ds_idx % 3 = 0").select(F.col("path").alias("old"), F.concat(F.lit("gs://new/"), F.col("ds_idx").cast("string")).alias("new")).distinct()
    return rewrite.rename_targets(m, new)


@query(f"""WITH {r.MANIFEST_SQL} SELECT ds_idx, key, size > 0 AND size < 1000 AS inline, CASE WHEN size > 0 THEN size < 500 ELSE ds_idx * 100 < 500 END AS inline_combined FROM m""")
def inline_predicate(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).withColumn("raw", F.lit(None).cast("binary"))
    return m.select("ds_idx", "key", rewrite.should_inline(1000).alias("inline"), rewrite.should_inline_combined(500, F.col("ds_idx") * 100).alias("inline_combined"))


@query(f"WITH {r.MANIFEST_SQL}, {r.ARRAYS_SQL} SELECT ds_idx, var, n * 8 AS nbytes, n * 8 < 64 OR var = '1-URGENT' AS inline, CASE WHEN n * 8 < 64 OR var = '1-URGENT' THEN n ELSE ch END AS chunk FROM a")
def inline_array_sizes(spark: SparkSession, d: str) -> DataFrame:
    a = rewrite.arrays_to_inline(r.arrays(spark, d), 64, ("1-URGENT",))
    return a.select("ds_idx", "var", keys.nbytes(F.col("shape"), F.col("itemsize")).alias("nbytes"), "inline", F.get("chunks", F.lit(0)).alias("chunk"))


@query(f"""WITH {r.MANIFEST_SQL} SELECT ds_idx, var || '/' || (i * 4 + p) AS key, "offset" + p * (size // 4) AS "offset", size // 4 AS size FROM m, range(4) t(p)""")
def subchunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = rewrite.subchunk(r.manifest(spark, d).withColumn("raw", F.lit(None).cast("binary")), [8], [4], 4)
    return s.select("ds_idx", keys.chunk_key(F.col("var"), F.col("index")).alias("key"), "offset", "size")


@query(f"""WITH {r.MANIFEST_SQL}, x AS (SELECT ds_idx, key, "offset", CASE WHEN i = 0 THEN 0 ELSE size END AS size FROM m)
SELECT ds_idx, key, CASE WHEN ds_idx % 5 <> 4 THEN 's3://a.zip' ELSE 'zip://' || ds_idx || '::s3://a.zip' END AS path, CASE WHEN ds_idx % 5 <> 4 THEN "offset" + ds_idx * 7 ELSE "offset" END AS "offset",
CASE WHEN ds_idx % 5 <> 4 AND size = 0 THEN 9999 ELSE size END AS size FROM x""")
def archive_deref(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d)
    refs = m.select("ds_idx", "key", F.concat(F.lit("zip://"), F.col("ds_idx").cast("string"), F.lit("::s3://a.zip")).alias("path"), "offset", F.when(F.get("index", F.lit(0)) == 0, 0).otherwise(F.col("size")).alias("size"))
    members = m.filter("ds_idx % 5 <> 4").select(F.lit("s3://a.zip").alias("archive"), F.col("ds_idx").cast("string").alias("member"), (F.col("ds_idx") * 7).alias("member_offset"), F.lit(9999).alias("member_size")).distinct()
    return rewrite.dereference_archives(refs, members)


@query(f"""WITH {r.MANIFEST_SQL}, b AS (SELECT min(path) AS lo, max(path) AS hi FROM m),
x AS (SELECT max(n) AS n, any_value(lo) AS lo FROM b, range(200) t(n) WHERE n <= least(length(lo), length(hi)) AND lo[1:n] = hi[1:n])
SELECT ds_idx, key, CASE WHEN n >= 9 THEN lo[1:n] END AS template, CASE WHEN n >= 9 THEN '{{u}}' || substr(path, CAST(n + 1 AS INTEGER)) ELSE path END AS path FROM m, x""")
def templateize(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.templateize(r.manifest(spark, d).select("ds_idx", "key", "path"), 9)


@query("SELECT event_id, props AS plain, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'base64:' || base64(encode('é' || event_type)) END AS inline FROM events")
def consolidate_encode(spark: SparkSession, d: str) -> DataFrame:
    e = r.table(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.encode("event_type", "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), F.col("event_type")), "UTF-8"))
    text = encoding.encode_inline(F.encode("props", "UTF-8"))
    return e.select("event_id", F.decode(encoding.decode_inline(text), "UTF-8").alias("plain"), encoding.encode_inline(raw).alias("inline"))


@query(f"WITH {r.MANIFEST_SQL} SELECT ds_idx, var, i, ds_idx * 2 + i AS number, (ds_idx * 2 + i) // 10 AS rec_no, (ds_idx * 2 + i) % 10 AS row_no FROM m")
def parquet_record_layout(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d)
    n = F.lit(10_000_000).cast("bigint")
    a = m.select("var").distinct().select("var", F.array(n, F.lit(8).cast("bigint")).alias("shape"), F.array(F.lit(1).cast("bigint"), F.lit(4).cast("bigint")).alias("chunks"))
    refs = m.select("ds_idx", "var", F.get("index", F.lit(0)).alias("i"), F.array("ds_idx", F.get("index", F.lit(0))).alias("index"))
    return rewrite.record_layout(refs, a, 10).select("ds_idx", "var", "i", "number", "rec_no", "row_no")


@query("SELECT p_partkey, 100.0 + (x + 0.5) * 2.0 AS x, 50.0 - (x + 0.5) * 0.25 AS y FROM part, range(4) t(x)")
def geotiff_coords(spark: SparkSession, d: str) -> DataFrame:
    from chunkloom.sources.tiff import pixel_centres

    return r.table(spark, d, "part").select("p_partkey", F.posexplode(F.arrays_zip(pixel_centres(F.lit(100.0), F.lit(2.0), 4).alias("x"), pixel_centres(F.lit(50.0), F.lit(-0.25), 4).alias("y"))).alias("k", "c")).select("p_partkey", "c.x", "c.y")


@query(f"WITH {r.K_INDEX_SQL} SELECT varname, run, level, step_h + 0.0 AS step_hours, uri FROM k")
def step_correction(spark: SparkSession, d: str) -> DataFrame:
    return r.k_index(spark, d).select("varname", F.col("time").alias("run"), "level", encoding.step_hours(F.col("valid_time"), F.col("time")).alias("step_hours"), "uri")


@query(f"WITH {r.COORDINATES_SQL}, u AS (SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT value FROM c)), q AS (SELECT unnest([0.4, 7.6, 1e9]) AS point) SELECT point, arg_min(ord, abs(value - point) * 1000000 + ord) AS ord FROM u, q GROUP BY point")
def nearest_select(spark: SparkSession, d: str) -> DataFrame:
    pts = spark.createDataFrame([(0.4,), (7.6,), (1e9,)], "point double")
    return combine.nearest(combine.union_coordinates(r.coordinates(spark, d)), pts)


@query(f"WITH {r.MANIFEST_SQL} SELECT ds_idx, key FROM m WHERE NOT (starts_with(key, '1-') OR starts_with(key, '5-LOW/1'))")
def drop_prefix(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.drop_prefixes(r.manifest(spark, d), ("1-", "5-LOW/1")).select("ds_idx", "key")


@query(f"WITH {r.MANIFEST_SQL} SELECT key, var, CAST([i] AS INTEGER[])[1] AS i, false AS meta, 'g/' || key AS path FROM m")
def key_parts(spark: SparkSession, d: str) -> DataFrame:
    m = r.manifest(spark, d).select("key")
    k = F.col("key")
    return m.select("key", keys.variable_of(k).alias("var"), F.get(keys.chunk_index(k), F.lit(0)).alias("i"), keys.is_meta(k).alias("meta"), keys.build_path(F.lit("/g"), F.lit(None).cast("string"), k).alias("path"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'step' WHEN 1 THEN 'level' WHEN 2 THEN 'level' ELSE 'latitude' END AS coord FROM events")
def unify_levels(spark: SparkSession, d: str) -> DataFrame:
    n = F.get(F.array(*map(F.lit, ("step", "isobaricInhPa", "surface", "latitude"))), (F.col("event_id") % 4).cast("int"))
    return r.table(spark, d, "events").select("event_id", keys.grib_coord(n).alias("coord"))
