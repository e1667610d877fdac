"""State on immutable tables: change detection, upserts, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) from snapshots (path, hash): added, changed or removed; equal files are left out."""
    both = now.join(before.withColumnRenamed("hash", "old"), "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old"), "changed")
    return both.select("path", kind.alias("change")).where("change is not null")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with new rows in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def merge_overrides(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """The column taken from the overrides where they have the key; overrides without a row are added."""
    o = overrides.withColumnRenamed(column, "override")
    return rows.join(o, key, "full_outer").select(key, F.coalesce("override", column).alias(column), F.col("override").isNotNull().alias("confirmed"))
