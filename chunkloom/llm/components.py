"""Connected components by alternating large-star and small-star steps.

Each step gives every node the smallest node it can see, by a partial aggregation, then
re-hangs the edges; the number of rounds grows with the logarithm of a component's size.
Edges never leave the executors: the driver reads one count and one hash a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    m = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    # edges point down: u > v
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges(u, v)``; the component is its smallest node.

    Self-loops, repeated edges, both directions and nulls (ignored) are allowed; an empty
    table gives an empty result.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.filter(u.isNotNull() & v.isNotNull() & (u != v))
    e = scratch.keep(e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = sign(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        new = scratch.keep(_small(_large(e)))
        now = sign(new)
        scratch.drop(e)
        e = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
