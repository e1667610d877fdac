"""Ranking and packing within a token budget, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import OVERHEAD_TOKENS


def ranked(candidates: DataFrame, by: str) -> DataFrame:
    """candidates (by, id, priority, ord): the best row of each id, numbered from 1 in rank order."""
    best = candidates.groupBy(by, "id").agg(F.min(F.struct("priority", "ord")).alias("b")).select(by, "id", "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("priority", "ord", "id")))


def fits(run: Column, rank: Column, budget: int | Column, header: int | Column = 0, cap: int | None = None) -> Column:
    """Whether an item is in the longest prefix within the budget, by the running sum of tokens; the first item always fits once the header does."""
    fit = ((run + header <= budget) | (rank == 1)) & F.lit(header <= budget)
    return fit if cap is None else fit & (rank <= cap)


def packed(items: DataFrame, by: str, budget: int | Column, header: int | Column = 0, cap: int | None = None) -> DataFrame:
    """items (by, rank, tokens): those that fit. The budget may be a column."""
    run = F.sum("tokens").over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("running", run + header).where(fits(F.col("running") - header, F.col("rank"), budget, header, cap))


def recommended(total: Column) -> Column:
    """Tokens with a margin of 15 percent in single precision, rounded up."""
    return F.ceil((total + OVERHEAD_TOKENS).cast("float") * F.lit(1.15).cast("float")).cast("long")
