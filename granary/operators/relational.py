"""Relational patterns that the bound queries share, by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import checkpointed


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``, which has to be total."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def divided(groups: DataFrame, members: DataFrame, good: DataFrame, key: str, member: str) -> DataFrame:
    """Relational division: groups all of whose members are good. A group without members qualifies."""
    bad = members.join(good.select(member), member, "left_anti").select(key)
    return groups.join(bad, key, "left_anti")


def min_rank(df: DataFrame, term: str, rank: str) -> DataFrame:
    """Best rank of each term, in order of rank and term."""
    return df.groupBy(term).agg(F.min(rank).alias(rank)).orderBy(rank, term)


def prioritised(probes: DataFrame, probe: str, candidates: DataFrame, item: str, fields: Sequence[str]) -> DataFrame:
    """(probe, item, field): each pair once, by the first field that equals the probe."""
    found = None
    for n, f in enumerate(fields):
        hit = probes.select(probe).distinct().join(candidates.select(F.col(f).alias(probe), item), probe).withColumns({"match_kind": F.lit(f), "__p": F.lit(n)})
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(probe, item).agg(F.min_by("match_kind", "__p").alias("match_kind"))
    return best.select(probe, item, "match_kind")


def exact_then_unique(left: DataFrame, right: DataFrame, exact: Sequence[str], fallback: str, value: str) -> DataFrame:
    """``value`` by all ``exact`` columns, else by ``fallback`` where that names one row alone."""
    by_key = right.groupBy(*exact).agg(F.max(value).alias("__exact"))
    unique = right.where(F.col(fallback).isNotNull()).groupBy(fallback).agg(F.count("*").alias("__n"), F.max(value).alias("__unique")).where("__n = 1").drop("__n")
    return left.join(by_key, list(exact), "left").join(unique, fallback, "left").withColumn(value, F.coalesce("__exact", "__unique")).drop("__exact", "__unique")


def reconciled(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Both sides by key: ``missing`` on the right, ``extra`` there, ``different`` in some field, or ``same``."""
    a = left.select(*keys, *[F.col(f).alias(f"__a_{f}") for f in fields], F.lit(True).alias("__a"))
    b = right.select(*keys, *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(True).alias("__b"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}"))
    state = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~same, "different").otherwise("same")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def appended(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that ignores rows whose key is there already; of repeated new keys one row comes in."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that replaces rows of the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(r, o, p): rows, what they are ordered by, and the number of their range. Ranges are written down with their rows: read twice, two plans of one shuffle could cut them differently."""
    cut = df.select(F.struct("*").alias("r"), F.struct(*order).alias("o")).repartitionByRange("o")
    return checkpointed(cut.select("r", "o", F.spark_partition_id().alias("p")))


def running(df: DataFrame, value: Column, name: str, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, in a total order, within ``by``.

    No task sees all rows: ranges are sorted and summed, and the sums of the
    ranges before are added.
    """
    keys = [F.col("r")[b].alias(f"__by{k}") for k, b in enumerate(by)]
    names = [f"__by{k}" for k in range(len(by))]
    rows = _ranged(df.withColumn("__v", value), order).select("r", "o", "p", F.col("r")["__v"].alias("v"), *keys)
    inside = Window.partitionBy("p", *names).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("p", *names).agg(F.sum("v").alias("m"))
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("p", *names, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("b"))
    left = rows.withColumn("i", F.coalesce(F.sum("v").over(inside), F.lit(0)))
    match = left["p"] == sums["p"]
    for n in names:
        match = match & left[n].eqNullSafe(sums[n])
    return left.join(sums, match).select(*[F.col("r")[c].alias(c) for c in df.columns], (F.col("i") + F.col("b")).alias(name))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the place of each row from 0 by a total order."""
    return running(df, F.lit(1).cast("long"), name, order)


def pages(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Adds ``page`` from 1 and ``place`` on it from 0 by a total order."""
    placed = numbered(df, "__k", *order)
    return placed.select(*df.columns, (F.expr(f"__k div {size}") + 1).alias("page"), (F.col("__k") % size).alias("place"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by hashes of the keys, before work that is large beside their bytes: files are cut by bytes and row groups, so that a small table of many rows would be one task's work. Adaptive execution decides on the number of tasks."""
    return df.repartition(*keys)
