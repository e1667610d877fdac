"""Domains: directory segments that enough symbols share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SKIPPED_SEGMENTS


def discovered(symbols: DataFrame, path: str = "path") -> DataFrame:
    """(domain, n): lowered directory segments of at least three bytes that occur twice or more."""
    parts = F.split(F.col(path), "/")
    segments = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    found = symbols.where(F.size(parts) > 1).select(F.explode(segments).alias("domain")).where((F.octet_length("domain") >= 3) & ~F.col("domain").isin(*SKIPPED_SEGMENTS))
    return found.groupBy("domain").agg(F.count("*").alias("n")).where("n >= 2")
