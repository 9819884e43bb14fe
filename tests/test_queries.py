import time

import duckdb
import pytest

import __spark_entry__
import chunkloom.plans.scan_queries  # noqa: F401
from chunkloom.plans import reader_queries
from chunkloom.plans.queries import ORACLE, QUERIES
from chunkloom.plans.recipes import k_index
from tests.duck import SF, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLE[name]) > 0


@pytest.mark.parametrize("kind", ["horizon", "valid_time", "run_time"])
def test_whole_forecast_grid_has_every_chunk(spark, kind):
    assert QUERIES[f"fmrc_{kind}_whole"](spark, SF).count() == k_index(spark, SF).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scaled_events_are_packed_in_wide_chunks(spark):
    """100,000 events took 44 s and more when each had a chunk of its own."""
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/events.parquet").filter("value is not null")
    chunks = reader_queries._event_refs(spark, e).filter("key != 'events/.zarray'").count()
    assert chunks * reader_queries.EVENT_ROWS < 2 * e.count()
    began = time.time()
    QUERIES["scale_offset"](spark, d).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 25
    assert same(QUERIES["scale_offset"](spark, d), ORACLE["scale_offset"], d) == e.count()


@pytest.mark.parametrize("where", ["true", "false"])
def test_scaled_events_of_any_id_and_value(spark, tmp_path, where):
    rows = "(0, '1.5'), (0, '1.5'), (0, '2.5'), (-7, '-0.5'), (NULL, '3.5'), (NULL, NULL), (4, NULL), (9223372036854775807, '1e30'), (-9223372036854775808, '0'), (5, 'nan'), (6, 'inf'), (7, '-inf'), (8, '-1e-300')"
    duckdb.execute(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, CAST(b AS DOUBLE) AS value FROM (VALUES {rows}) t(a, b) WHERE {where}) TO '{tmp_path}/events.parquet'")
    assert same(QUERIES["scale_offset"](spark, str(tmp_path)), ORACLE["scale_offset"], str(tmp_path)) == (11 if where == "true" else 0)
