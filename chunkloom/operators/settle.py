"""Cutting a plan: rows are written once to the shared checkpoint folder and read from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a reliable checkpoint in the folder that the session names.

    One of our own is set only on a single machine whose session names none.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="chunkloom-"))
    return df.checkpoint()
