"""Statistics over named columns, exact and in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of counts, 0 where there is nothing to divide by."""
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def index_quantiles(rows: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The value at index floor(q * n) of the sorted values (the last at most), by group.

    Unlike an interpolated percentile.  Only the counts of different values are sorted.
    """
    by = by or []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    up = Window.partitionBy(*by).orderBy(column)
    reach = counts.withColumn("__to", F.sum("__n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = lambda q: F.least(F.floor(F.col("__all") * q), F.col("__all") - 1)
    return reach.groupBy(*by).agg(*(F.min(F.when(F.col("__to") > at(q), F.col(column))).alias(name) for name, q in shares.items()))


def entropy(rows: DataFrame, column: str, by: list[str] | None = None, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of a column's values: log2(n) - sum(c log2 c) / n."""
    by = by or []
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("__n"))
    n = F.sum("__n")
    return counts.groupBy(*by).agg(F.greatest(F.lit(0.0), F.log2(n) - F.sum(F.col("__n") * F.log2("__n")) / n).alias(name))
