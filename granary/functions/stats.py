"""Order statistics and rates with the exact definitions that reports rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, fraction: float) -> Column:
    """The value at place ceil(fraction * n) of the sorted values of a column; counted by value, in partial aggregates."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")


def rounded_indices(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, names): the value at index round((n - 1) * fraction) of the sorted values, halves to even, for each name's fraction. Equal values are counted first; nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    c = counts.withColumns({"__upto": F.sum("__n").over(w.orderBy(value)), "__all": F.sum("__n").over(w)})
    index = {n: F.bround((F.col("__all") - 1) * F.lit(f)).cast("long") for n, f in wanted.items()}
    return c.groupBy(*keys).agg(*[F.max(F.when((F.col("__upto") > i) & (F.col("__upto") - F.col("__n") <= i), F.col(value))).alias(n) for n, i in index.items()])


def rate(count: Column, total: Column) -> Column:
    return count / F.greatest(total, F.lit(1))


def clamped_delta(value: Column | str, at: Column | str) -> Column:
    """Last value less first of a counter, not below zero."""
    return F.greatest(F.max_by(value, at) - F.min_by(value, at), F.lit(0))
