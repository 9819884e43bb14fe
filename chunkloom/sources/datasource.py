"""``spark.read.format("array_refs")``: a file's references through a Python data source.

Options: ``path`` (files in a folder that driver and executors both see), ``kind`` (a format of
``scan``), ``inline_threshold``. One partition per file. With
``spark.sql.python.filterPushdown.enabled`` equality filters on ``var`` drop other variables' rows
in the reader. Stores that only Spark reads go through ``scan`` instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from chunkloom.sources.scan import FORMATS

SCHEMA = "ds_url string, key string, var string, path string, offset bigint, size bigint, raw binary"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "netcdf3")
        parse, default = FORMATS[self.kind]
        self.limit = int(options.get("inline_threshold", default))
        self.var: str | None = None

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if not n.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for key, v in FORMATS[self.kind][0](data):
            var = key.rsplit("/", 1)[0] if "/" in key else ""
            if self.var is not None and var != self.var:
                continue
            if isinstance(v, bytes):
                yield partition.path, key, var, None, None, None, v
            elif v[1] < self.limit:
                yield partition.path, key, var, None, None, None, data[v[0] : v[0] + v[1]]
            else:
                yield partition.path, key, var, partition.path, v[0], v[1], None


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("var",):
                self.var = f.value
            else:
                yield f


class ArrayRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_refs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        active = SparkSession.getActiveSession()
        push = active is not None and active.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
        return (_PushingReader if push or self.options.get("push") == "true" else _Reader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayRefs)
