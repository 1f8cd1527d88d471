"""Constraints as queries: each returns the rows that break it, and a write goes ahead only if none does."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank


class ConstraintError(ValueError):
    """A named constraint has violations."""


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. A key with a null isn't held against another, as in SQL."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def references(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has; a null key refers to nothing."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def satisfies(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false (null passes, as a CHECK does)."""
    return df.where(f"NOT ({condition})")


def contiguous(df: DataFrame, group: str, start: str, size: str) -> DataFrame:
    """Records that don't begin where the one before them ends."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(start)
    expected = F.coalesce(F.lag(F.col(start) + F.col(size)).over(w), F.lit(0))
    return df.withColumn("expected", expected).where(F.col("expected") != F.col(start))


def counts(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, violations), one row for each check."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out


def require(checks: Mapping[str, DataFrame]) -> None:
    """Raises for the first constraint with a violation; only one row of it is looked for."""
    for name, bad in checks.items():
        if not bad.isEmpty():
            raise ConstraintError(name)


def identity_report(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (missing, extra, passed) of the distinct rows that one side has alone."""
    x, y = a.select(*columns), b.select(*columns)
    missing = x.subtract(y).agg(F.count("*").alias("missing"))
    extra = y.subtract(x).agg(F.count("*").alias("extra"))
    return missing.crossJoin(extra).withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def replay_plan(records: DataFrame, expected: DataFrame, ingested: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, state): ``pending``, ``replayed`` (ingested alike before), ``conflict`` (ingested otherwise, or twice here with different contents), ``unknown`` or ``absent``."""
    r = records.groupBy(key).agg(F.min(fingerprint).alias("__a"), F.max(fingerprint).alias("__z"))
    e = expected.select(key).distinct().withColumn("__e", F.lit(True))
    i = ingested.groupBy(key).agg(F.max(fingerprint).alias("__i"))
    j = r.join(e, key, "full_outer").join(i, key, "left")
    state = (
        F.when(F.col("__a").isNull(), "absent")
        .when(F.col("__e").isNull(), "unknown")
        .when((F.col("__a") != F.col("__z")) | (F.col("__i") != F.col("__a")), "conflict")
        .when(F.col("__i").isNotNull(), "replayed")
        .otherwise("pending")
    )
    return j.select(key, state.alias("state"))


def token_audit(requests: DataFrame, run: str, tokens: str, window: int, headroom: float) -> DataFrame:
    """One row per run: number of requests, least, middle, p95, p99, most and total input tokens by nearest rank, how often the largest fits the window, and whether that is ``headroom`` times or more. A run without requests has no row and hasn't passed."""
    g = requests.groupBy(run).agg(
        F.count(tokens).alias("requests"),
        F.min(tokens).alias("least"),
        *[nearest_rank(tokens, f).alias(n) for n, f in (("middle", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.max(tokens).alias("most"),
        F.sum(tokens).alias("total"),
    )
    return g.withColumn("headroom", F.lit(float(window)) / F.col("most")).withColumn("passed", F.col("headroom") >= headroom)
