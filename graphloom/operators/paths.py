"""Many path patterns at once, as an equi-join of prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(files: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(key, path): for each different path of `files` the keys of the patterns (key, pattern) that it matches, as `text.matches_glob` does.

    A pattern is a prefix: of whole directories (`src/pay`, `src/pay/**`) or, up to its first star, of characters (`src/pa*`). A path brings one
    row for each of its directories and itself, and one for each length that a prefix of characters has, and meets the patterns by equality. So the
    rows are bounded by the lengths of paths, whatever the number of patterns, and a prefix that most paths have is a skewed but splittable join."""
    whole = F.col("pattern").endswith("/**") | ~F.col("pattern").contains("*")
    prefix = F.when(whole, F.regexp_replace("pattern", r"/\*\*$", "")).otherwise(F.substring_index("pattern", "*", 1))
    wanted = patterns.where("pattern is not null").select(key, whole.alias("whole"), prefix.alias("prefix")).distinct()
    lengths = [r[0] for r in wanted.where("not whole").select(F.length("prefix")).distinct().collect()]  # no more than the longest pattern has characters
    paths = files.select("path").where("path is not null").distinct()
    parts = F.split("path", "/")
    directories = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.lit(True).alias("whole"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.struct(F.lit(False).alias("whole"), F.substring("path", F.lit(1), n).alias("prefix")))
    rows = paths.select("path", F.explode(F.concat(directories, starts)).alias("p")).select("path", "p.*")
    return rows.join(wanted, ["whole", "prefix"]).select(key, "path").distinct()
