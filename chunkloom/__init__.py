"""Chunkloom: virtual array datasets and their manifests as Spark DataFrames."""

__version__ = "0.1.0"
