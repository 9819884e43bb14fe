"""TIFF pieces that need no file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_centres(origin: Column, step: Column, n: int) -> Column:
    """Coordinates of n pixel centres from an edge and a signed pixel size."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: origin + (i + 0.5) * step)
