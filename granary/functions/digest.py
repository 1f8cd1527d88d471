"""Digests of whole tables that neither order nor partitioning changes."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import utc_text

_LIMBS = 8


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as text: each value with its length before it, null as ``-``, timestamps in UTC."""
    parts = []
    for name, kind in df.dtypes:
        if columns is None or name in columns:
            x = utc_text(df[name]) if kind.startswith("timestamp") else df[name].cast("string") if not kind.startswith(("array", "struct", "map")) else F.to_json(F.struct(df[name]))
            parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.concat(*parts)


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, total, mixed): number of rows, sum modulo 2^256 and exclusive or of their SHA-256.

    Equal tables have equal digests in any order; a repeated row changes the sum.
    The digest of a row is summed in eight 32-bit limbs, so partial sums run where
    the rows are and one row comes out; the carries are done on it.
    """
    h = F.sha2(row_text(df, columns), 256)
    limbs = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(_LIMBS)]
    sums = df.select(h.alias("h")).select(*[x.alias(f"x{k}") for k, x in enumerate(limbs)]).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"x{k}").cast("decimal(20,0)")).alias(f"s{k}") for k in range(_LIMBS)], *[F.bit_xor(f"x{k}").alias(f"m{k}") for k in range(_LIMBS)]
    )
    carry, out = F.lit(0).cast("decimal(38,0)"), []
    two32 = F.lit(1 << 32).cast("decimal(38,0)")
    for k in reversed(range(_LIMBS)):
        v = F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("decimal(38,0)") + carry
        out.append(F.lpad(F.lower(F.hex((v % two32).cast("long"))), 8, "0"))
        carry = F.floor(v / two32).cast("decimal(38,0)")
    mixed = [F.lpad(F.lower(F.hex(F.coalesce(F.col(f"m{k}"), F.lit(0)))), 8, "0") for k in range(_LIMBS)]
    return sums.select("n", F.concat(*reversed(out)).alias("total"), F.concat(*mixed).alias("mixed"))


def history_digest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(place, name, n, total, mixed, upto): the digest of each table in the order given, and the SHA-256 of its line put after that of the tables before it, so that the last row stands for all of them in this order."""
    rows = None
    for k, (name, df) in enumerate(tables.items()):
        one = table_digest(df).select(F.lit(k).alias("place"), F.lit(name).alias("name"), "n", "total", "mixed")
        rows = one if rows is None else rows.unionByName(one)
    line = lambda r: F.concat_ws(":", r["name"], r["n"].cast("string"), r["total"], r["mixed"])
    # one row for each table: a short list, folded in one place
    all_ = rows.agg(F.sort_array(F.collect_list(F.struct("place", "name", "n", "total", "mixed"))).alias("x"))
    upto = lambda k: F.aggregate(F.slice("x", 1, k + 1), F.lit(""), lambda a, r: F.sha2(F.concat(a, line(r)), 256))
    return all_.select(F.explode(F.transform("x", lambda r: F.struct(r.alias("r"), upto(r["place"]).alias("upto")))).alias("y")).select("y.r.*", "y.upto")


def parity(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n_left, n_right, state): whether two copies of each table hold the same rows, by their digests; ``missing`` or ``extra`` where one side lacks the table."""
    out = None
    for name in sorted({*left, *right}):
        sides = [table_digest(side[name]).select("n", F.concat("total", "mixed").alias("d")) if name in side else None for side in (left, right)]
        a = sides[0].select(F.col("n").alias("n_left"), F.col("d").alias("a")) if sides[0] is not None else sides[1].select(F.lit(None).cast("long").alias("n_left"), F.lit(None).cast("string").alias("a"))
        b = sides[1].select(F.col("n").alias("n_right"), F.col("d").alias("b")) if sides[1] is not None else sides[0].select(F.lit(None).cast("long").alias("n_right"), F.lit(None).cast("string").alias("b"))
        state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("different")
        row = a.crossJoin(b).select(F.lit(name).alias("name"), "n_left", "n_right", state.alias("state"))
        out = row if out is None else out.unionByName(row)
    return out


def digest_of_rows(texts: Sequence[str]) -> tuple[int, str, str]:
    """The same for row texts in memory."""
    total = mixed = 0
    for t in texts:
        h = int(hashlib.sha256(t.encode()).hexdigest(), 16)
        total, mixed = (total + h) % (1 << 256), mixed ^ h
    return len(texts), f"{total:064x}", f"{mixed:064x}"
