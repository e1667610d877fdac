"""Which strings lie within which others, by an inverted index of rare grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; shorter needles are grams themselves.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The different substrings of a size."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): every pair of a string of `needles` (needle) and one of `texts` (text) that holds it, itself included. Nulls and empty
    strings take no part.

    A needle is looked up by that of its grams that the fewest texts have, so what is compared is no more than its rarest gram allows; a needle with a
    gram that no text has is dropped at once. No pair is skipped: a text that holds the needle has all its grams."""
    asked = needles.select("needle").where("needle <> ''").distinct()
    held = texts.select("text").where("text <> ''").distinct()
    own = asked.select("needle", F.explode(_grams(F.col("needle"), F.least(F.lit(GRAM), F.length("needle")))).alias("gram"))
    sizes = [r[0] for r in asked.select(F.least(F.lit(GRAM), F.length("needle"))).distinct().collect()]  # up to three numbers
    none = F.array().cast("array<string>")
    all_grams = F.concat(none, *(F.when(F.length("text") >= s, _grams(F.col("text"), F.lit(s))).otherwise(none) for s in sorted(sizes)))
    by_gram = held.select("text", F.explode(all_grams).alias("gram"))
    counts = by_gram.groupBy("gram").agg(F.count("*").alias("n"))
    met = own.join(counts, "gram", "left")
    rare = met.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("needle", "r.gram")
    return rare.join(by_gram, "gram").where(F.col("text").contains(F.col("needle"))).select("needle", "text")
