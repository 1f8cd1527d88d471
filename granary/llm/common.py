"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import checkpoint_dir, checkpointed, forget, new_folder, stored  # noqa: F401

ROW = "__row"
KEY = "__key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Identity of a row for decisions: its id with its text, so rows alike in both share one fate."""
    return F.xxhash64(df[id_col].cast("string"), F.lit("\x1f"), df[text_col].cast("string"))


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row in one struct, so that no input column can clash with a working column."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias(ROW), *[v.alias(k) for k, v in extra.items()])


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns])


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def rows_of(batches: Iterable, width: int):
    """Arrow batches cut to at most ``width`` rows, so that no Python batch grows with row size."""
    for batch in batches:
        for at in range(0, batch.num_rows, width):
            yield batch.slice(at, width)


def give_back() -> None:
    """Returns to the system what this process has freed; where the C library can't, only what Arrow holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run``, after whose end the worker gives back what it has freed: Spark keeps workers for later stages, and the C library keeps their freed pages, which lie between small arrays."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
