"""Stratified samples that can be drawn again."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered


class Unreachable(ValueError):
    """No selection meets the floors."""


@dataclass(frozen=True)
class Metric:
    """What is known of an article when it may be drawn."""

    article: int
    size: int
    units: int
    roles: Mapping[str, int] = field(default_factory=dict)
    features: frozenset = frozenset()


def drawn_order(article: int, salt: str = "pilot-v1") -> str:
    return sha256(f"{salt}:{article}".encode()).hexdigest()


def mandatory(metrics: DataFrame) -> DataFrame:
    """Articles that are always in: least, middle, 95th percentile and largest by size, the one with most units, and for each feature the first in hash order."""
    r = numbered(metrics.select("article", "size"), "k", F.col("size"), F.col("article"))
    n = metrics.agg(F.count("*").alias("n"))
    by_size = r.crossJoin(n).where((F.col("k") == 0) | (F.col("k") == F.expr("n div 2")) | (F.col("k") == F.floor((F.col("n") - 1) * 0.95)) | (F.col("k") == F.col("n") - 1)).select("article")
    most = metrics.agg(F.max_by("article", F.struct("units", -F.col("article"))).alias("article"))
    h = F.sha2(F.concat(F.lit("pilot-v1:"), F.col("article").cast("string")), 256)
    featured = metrics.select("article", F.explode("features").alias("f")).groupBy("f").agg(F.min_by("article", h).alias("article")).select("article")
    return by_size.union(most).union(featured).distinct()


def select(metrics: list[Metric], mandatory_ids: set[int], min_units: int, floors: Mapping[str, int]) -> set[int]:
    """The mandatory articles, then for each role in order of its shortfall the next by hash, then by hash to the total. Works on a pilot's candidates, a small table."""
    by_hash = sorted(metrics, key=lambda m: drawn_order(m.article))
    chosen = {m.article for m in metrics if m.article in mandatory_ids}
    count = lambda role: sum(m.roles.get(role, 0) for m in metrics if m.article in chosen)
    for role, least in sorted(floors.items()):
        for m in by_hash:
            if count(role) >= least:
                break
            if m.article not in chosen and m.roles.get(role, 0):
                chosen.add(m.article)
        if count(role) < least:
            raise Unreachable(role)
    for m in by_hash:
        if sum(x.units for x in metrics if x.article in chosen) >= min_units:
            break
        chosen.add(m.article)
    if sum(x.units for x in metrics if x.article in chosen) < min_units:
        raise Unreachable("units")
    return chosen


def capped(df: DataFrame, kind: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each kind."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
