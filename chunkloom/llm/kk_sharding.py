"""Byte-balanced sharding by Karmarkar-Karp differencing, in levels.

Equal texts form one indivisible group. Groups are hashed into buckets; in each bucket the
differencing method combines, again and again, the two partial partitions of largest spread,
oppositely ordered, until one partition into ``shards`` bundles is left. The bundles of all
buckets are the items of the next level, down to one bucket, which yields the shards. Groups
that hold a large part of the bytes or rows skip the lower levels, so that their shard gets
little else. Each level's buckets hold a bounded number of items; no level sees all documents.

Defined results: a null text has size 16, checksum null and is in one group with the other null texts; an
empty text has size 16 and checksum 0; repeated rows are in one group and get slots of their
own; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chunkloom.llm.common import Scratch, table

SHARDS = 40
ROW_BYTES = 16
#: Items that one task combines; the last level may have as many.
BUCKET_ITEMS = 20_000
#: A group above total / (shards * LARGE_PART) bytes or rows goes straight to the last level; at most 2 * shards * LARGE_PART groups do.
LARGE_PART = 64


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each item, bytes of each slot) by largest differencing into k slots."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(k, np.int64)
    order = np.argsort(-sizes, kind="stable")
    # A partial partition: sums, descending, and for each sum the node-local slot it came from.
    sums = {}
    heap = []
    for rank, i in enumerate(order):
        s = np.zeros(k, np.int64)
        s[0] = sizes[i]
        sums[rank] = s
        heap.append((-int(sizes[i]), rank))
    heapq.heapify(heap)
    joined = []  # (left, right, left slot and right slot behind each new slot)
    top = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        perm = np.argsort(-total, kind="stable")
        s = total[perm]
        sums[top] = s
        joined.append((a, b, perm.astype(np.int32)))
        heapq.heappush(heap, (-int(s[0] - s[-1]), top))
        top += 1
    root = heap[0][1]
    place: dict[int, np.ndarray] = {root: np.arange(k, dtype=np.int32)}
    out = np.zeros(n, np.int32)
    for node in range(top - 1, n - 1, -1):
        a, b, perm = joined[node - n]
        at = place.pop(node)
        left = np.empty(k, np.int32)
        left[perm] = at  # slot j of the left part became the new slot where perm == j
        place[a], place[b] = left, left[::-1]
    for rank, i in enumerate(order):
        out[i] = place[rank][0]
    return out, sums[root]


def _bucketed(k: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        slot, _ = difference(pdf["size"].to_numpy(np.int64), k)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "size": pdf["size"].to_numpy(), "bundle": int(key[0]) * k + slot.astype(np.int64)})

    return run


def assign_groups(groups: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(item, shard) from (item string, size long, rows long), each item once."""
    groups = scratch.keep(groups)
    n, total, rows = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    large = (F.col("size") * (shards * LARGE_PART) > total) | (F.col("rows") * (shards * LARGE_PART) > rows)
    below = groups.filter(~large).select("item", "size")
    kept = groups.filter(large).select("item", "size")
    spark = groups.sparkSession
    maps = []
    while n > BUCKET_ITEMS:
        buckets = -(-n // BUCKET_ITEMS)
        level = below.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        level = scratch.keep(level.groupBy("bucket").applyInPandas(_bucketed(shards), "item string, size long, bundle long"))
        maps.append(level.select("item", "bundle"))
        below = level.groupBy(F.concat(F.lit(f"{len(maps)}:"), F.col("bundle")).alias("item")).agg(F.sum("size").alias("size"))
        n = buckets * shards
    last = below.union(kept).toPandas().sort_values(["size", "item"], ascending=[False, True], kind="stable")  # at most BUCKET_ITEMS and the large groups
    slot, _ = difference(last["size"].to_numpy(np.int64), shards)
    top = spark.createDataFrame(pd.DataFrame({"item": last["item"].astype(str), "shard": slot.astype(np.int32)}), "item string, shard int")
    if not maps:
        return top
    out = top
    for k in range(len(maps), 0, -1):
        m = maps[k - 1].withColumn("up", F.concat(F.lit(f"{k}:"), F.col("bundle")))
        lower = m.join(out.select(F.col("item").alias("up"), "shard"), "up").select("item", "shard")
        out = lower.union(top.filter(~F.col("item").contains(":"))) if k == 1 else lower
    return out


def slots(rows: DataFrame, by: str, order: list[str], parts: int) -> DataFrame:
    """Add ``slot``: gapless from 0 in each value of ``by``, by salted windows and counted offsets."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = salted.groupBy(by, "_salt").count()  # at most values x parts rows
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_salt").alias("_s"), before.alias("_before"))
    w = Window.partitionBy(by, "_salt").orderBy(*order)
    numbered = salted.withColumn("_rn", F.row_number().over(w))
    numbered = numbered.join(F.broadcast(offsets), (F.col(by) == F.col("_by")) & (F.col("_salt") == F.col("_s")))
    return numbered.withColumn("slot", F.col("_before") + F.col("_rn") - 1).drop("_by", "_s", "_salt", "_rn", "_before")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    text = F.col("text")
    item = F.coalesce(F.md5(text), F.lit("null"))
    d = documents.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), item.alias("item"))
    d = scratch.keep(d)
    groups = d.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    assigned = scratch.keep(assign_groups(groups, shards, scratch))
    parts = min(1024, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out = slots(scratch.keep(d.join(assigned, "item").drop("item")), "shard", ["doc_id", "size", "text_crc32"], parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast(T.IntegerType()).alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_kk_sharding": op3_kk_sharding}
