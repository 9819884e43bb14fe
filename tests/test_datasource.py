import pytest

from chunkloom.sources import datasource
from tests.test_sources import netcdf


@pytest.mark.parametrize("push", ["false", "true"])
def test_array_refs(spark, tmp_path, push):
    raw, x, a, b = netcdf()
    for n in ("1.nc", "2.nc"):
        (tmp_path / n).write_bytes(raw)
    datasource.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
    try:
        df = spark.read.format("array_refs").option("inline_threshold", "0").option("push", push).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == 2
        got = df.filter("var = 'b' and size is not null").orderBy("ds_url", "offset").collect()
        assert [r.key for r in got] == ["b/0.0", "b/1.0"] * 2
        assert all(raw[r.offset : r.offset + r.size] == b[int(r.key[2])].tobytes() for r in got)
        assert df.filter("key = 'x/0'").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
