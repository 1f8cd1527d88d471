"""Greedy packing in order: sequential within a run, parallel over runs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class TooLarge(ValueError):
    """One item is beyond a hard limit."""


def manifest_bytes(items: Iterable[int], empty: int) -> int:
    """Size of a manifest: the empty one, its items, and a comma between two."""
    items = list(items)
    return empty + sum(items) + max(0, len(items) - 1)


def packs(items: Iterable[tuple[int, int]], max_items: int, max_bytes: int, max_units: int, alone_from: int, hard_bytes: int, hard_units: int, empty: int = 0) -> Iterator[list[int]]:
    """Places of the items in each pack; an item is (bytes, units).

    A pack is closed when the next item would take it over a soft limit. An
    item of ``alone_from`` bytes or more gets its own; one beyond a hard limit is
    an error.
    """
    pack: list[int] = []
    size = units = 0
    for place, (b, u) in enumerate(items):
        if b > hard_bytes or u > hard_units:
            raise TooLarge(f"item {place}: {b} bytes, {u} units")
        if b >= alone_from:
            if pack:
                yield pack
            yield [place]
            pack, size, units = [], 0, 0
            continue
        grown = size + b + (1 if pack else empty)
        if pack and (len(pack) >= max_items or grown > max_bytes or units + u > max_units):
            yield pack
            pack, size, units = [], 0, 0
            grown = empty + b
        pack.append(place)
        size, units = grown, units + u
    if pack:
        yield pack


def pack(df: DataFrame, run: str, order: list[str], item: str, size: str, units: str, **limits) -> DataFrame:
    """(run, item, pack, place): packs of each run, numbered from 0.

    Packing depends on order, so a run is folded by one task over its ids and
    sizes alone, never the payloads; runs go in parallel.
    """
    slim = df.select(run, item, *[c for c in order if c not in (run, item)], size, units)
    schema = T.StructType([slim.schema[run], slim.schema[item], T.StructField("pack", T.LongType()), T.StructField("place", T.LongType())])

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        number, place = [], []
        for n, p in enumerate(packs(zip(f[size].tolist(), f[units].tolist()), **limits)):
            number += [n] * len(p)
            place += range(len(p))
        return pd.DataFrame({run: f[run], item: f[item], "pack": number, "place": place})

    return slim.groupBy(run).applyInPandas(fold, schema)


def chunks(sizes: Iterable[int], max_bytes: int) -> Iterator[list[int]]:
    """Places of rows in chunks that are JSON arrays of at most ``max_bytes``, unless one row alone is larger."""
    chunk: list[int] = []
    total = 2
    for place, b in enumerate(sizes):
        grown = total + b + (1 if chunk else 0)
        if chunk and grown > max_bytes:
            yield chunk
            chunk, grown = [], 2 + b
        chunk.append(place)
        total = grown
    if chunk:
        yield chunk


def chunk(df: DataFrame, group: str, order: list[str], item: str, size: str, max_bytes: int) -> DataFrame:
    """(group, item, chunk): chunk numbers from 1 in order."""
    slim = df.select(group, item, *[c for c in order if c not in (group, item)], size)
    schema = T.StructType([slim.schema[group], slim.schema[item], T.StructField("chunk", T.LongType())])

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        number = [n for n, c in enumerate(chunks(f[size].tolist(), max_bytes), 1) for _ in c]
        return pd.DataFrame({group: f[group], item: f[item], "chunk": number})

    return slim.groupBy(group).applyInPandas(fold, schema)


def halves(articles: list[list]) -> list[list[list]] | None:
    """A failed batch cut in two: between articles if there are several, else between the units of the one; None if nothing can be cut."""
    if len(articles) > 1:
        mid = len(articles) // 2
        return [articles[:mid], articles[mid:]]
    if articles and len(articles[0]) > 1:
        mid = len(articles[0]) // 2
        return [[articles[0][:mid]], [articles[0][mid:]]]
    return None


def row_bytes(row) -> int:
    """Size of a row in a compact JSON array."""
    return len(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode())
