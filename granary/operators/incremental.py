"""Carrying results from one version of a corpus to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rekeyed(key: Column, old: str, new: str) -> Column:
    """The key with one prefix for the other; an error if it hasn't the old one."""
    return F.when(key.startswith(old), F.concat(F.lit(new), F.substring(key, F.lit(len(old) + 1), F.length(key)))).otherwise(F.raise_error(F.lit("a key has another prefix")))


def reusable(target: DataFrame, source: DataFrame, content: Sequence[str], target_id: str, value: str, source_order: Sequence[Column]) -> DataFrame:
    """(target id, value): the value of the first source row with the same content. One equi join on the content key; the source is made unique first, so that repeated content doesn't multiply."""
    w = Window.partitionBy(*content).orderBy(*source_order)
    one = source.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*content, value)
    return target.select(target_id, *content).join(one, list(content)).select(target_id, value)


def extended_run(old_units: DataFrame, new_articles: DataFrame, extract, article: str, unit: str, old_prefix: str, new_prefix: str) -> DataFrame:
    """Units of a run that grows: those of articles that it had are copied under new keys, only articles that are new are extracted."""
    copied = old_units.withColumn(unit, rekeyed(F.col(unit), old_prefix, new_prefix))
    fresh = new_articles.join(old_units.select(article).distinct(), article, "left_anti")
    return copied.unionByName(extract(fresh))


def next_articles(articles: DataFrame, done: DataFrame, article: str, order: Sequence[Column], n: int) -> DataFrame:
    """The next ``n`` articles that aren't done, in source order."""
    return articles.join(done.select(article), article, "left_anti").orderBy(*order).limit(n)


def canonicalised(values: DataFrame, key: str, value: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(key, previous, value, origin): rows that a source changes; earlier sources come first.

    Raises in the job if one source has two values for a key. Applied again, it
    gives no row.
    """
    out = values.select(key, F.col(value).alias("previous"))
    picks = []
    for name, s in sources:
        s = s.groupBy(key).agg(F.min(value).alias("__a"), F.max(value).alias("__z"))
        s = s.select(key, F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise(F.raise_error(F.lit(f"{name}: two values for a key"))).alias(f"__{name}"))
        out = out.join(s, key, "left")
        picks.append((name, F.col(f"__{name}")))
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in picks])
    return out.select(key, "previous", F.coalesce(*[c for _, c in picks]).alias(value), origin.alias("origin")).where(F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("previous")))
