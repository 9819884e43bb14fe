"""An extension: new index files stream into the chunk index as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators.idx import map_from_index, message_lengths, parse_lines


def index_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, line_no, value) of the lines of each new file in ``folder``."""
    t = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(folder)
    return t.select(F.col("_metadata.file_path").alias("uri"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def ingest(spark: SparkSession, folder: str, mapping: DataFrame, sink: str, checkpoint: str, run_pattern: str = "d=(\\d{10})", sizes: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append the chunk index rows of new files to Parquet at ``sink``, a folder per batch, so a repeated batch replaces itself.

    sizes: from a batch's (uri) of index files to (uri, file_size) of the files that they index, which
    give the last message of each its length; without it that length is null.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        idx = message_lengths(parse_lines(batch), sizes(batch.select("uri").distinct()) if sizes else None)
        idx = idx.withColumn("run", F.to_timestamp_ntz(F.regexp_extract("date", run_pattern, 1), F.lit("yyyyMMddHH")))
        map_from_index(idx, mapping, validate=False).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        batch.unpersist()

    return index_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
