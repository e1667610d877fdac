"""Exact nearest neighbours and hash embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 384


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, distance) of the k vectors nearest to a query by L2 distance, ties by id: one scan and a top-k."""
    target = F.array(*(F.lit(float(x)) for x in query))
    distance = F.sqrt(F.aggregate(F.zip_with("embedding", target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    return vectors.select("id", distance.alias("distance")).orderBy("distance", "id").limit(k)


def neighbours(vectors: DataFrame, own: str | int, embedding: list[float], k: int) -> DataFrame:
    """(id, distance) of the k vectors nearest to that of `own`, itself left out."""
    return nearest(vectors, embedding, k + 1).where(F.col("id") != own).orderBy("distance", "id").limit(k)


def _bucket(digest: F.Column, at: int) -> F.Column:
    little = F.concat(*(F.substring(digest, at + 1 + 2 * i, 2) for i in (3, 2, 1, 0)))
    return (F.conv(little, 16, 10).cast("long") % WIDTH).cast("int")


def hash_embedding(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, value): nonzero cells of the unit-length feature-hashed vector of words and adjacent pairs."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: w != "")
    tokens = texts.select(F.col(key), words.alias("w")).select(key, F.explode(F.concat(F.transform("w", lambda w: F.struct(w.alias("t"), F.lit(1.0).alias("weight"))), F.expr("transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> struct(concat(x, '_', w[i + 1]) as t, double(0.5) as weight))"))).alias("x"))
    hashed = tokens.select(key, F.col("x.weight").alias("weight"), F.sha2(F.col("x.t").cast("binary"), 256).alias("h"))
    cells = hashed.select(key, F.explode(F.array(F.struct(_bucket(F.col("h"), 0).alias("bucket"), F.col("weight")), F.struct(_bucket(F.col("h"), 8).alias("bucket"), (F.col("weight") / 2).alias("weight")))).alias("c"))
    sums = cells.groupBy(key, "c.bucket").agg(F.sum("c.weight").alias("v"))
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def symbol_embeddings(symbols: DataFrame) -> DataFrame:
    """(symbol_id, embedding): the hashed vector of each symbol's name, kind, path and lines."""
    text = F.format_string("%s %s %s lines %d-%d", "name", F.initcap("kind"), "file_path", "start_line", "end_line")
    cells = hash_embedding(symbols.select(F.col("id").alias("symbol_id"), text.alias("text")), "symbol_id", "text")
    dense = cells.groupBy("symbol_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("value").cast("float")))).alias("m"))
    return dense.select("symbol_id", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float"))).alias("embedding"))
