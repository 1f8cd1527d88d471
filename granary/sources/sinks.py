"""Writers. Rows and bodies are made by Spark; only the packing of one file is left to one process."""

from __future__ import annotations

import hashlib
import html
import json
import os
import tomllib
from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped, stable_key
from ..operators import export, packing
from ..operators.integrity import require
from ..operators.relational import pages


def config(path: str, prefix: str = "GRANARY_") -> dict:
    """A TOML file, with values of top-level keys from the environment in front."""
    with open(path, "rb") as f:
        out = tomllib.load(f)
    return out | {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}


def pinned(spark: SparkSession, path: str, sha256: Mapping[str, str]) -> DataFrame:
    """(path, sha256, expected) of files whose content isn't what was agreed, or that nobody agreed on."""
    want = spark.createDataFrame(list(sha256.items()), "name string, expected string")
    have = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return have.join(want, "name", "full_outer").where("NOT (sha256 <=> expected)")


def atomic_write(path: str, data: bytes) -> None:
    """All of the file or nothing: written beside its place, then moved there."""
    beside = f"{path}.{os.getpid()}.part"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def append(df: DataFrame, path: str, checks: Mapping[str, DataFrame] | None = None) -> None:
    """Appends rows once all constraints hold."""
    require(checks or {})
    df.write.mode("append").parquet(path)


def copy_tables(source: Mapping[str, DataFrame], path: str) -> None:
    for name, df in source.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_manifests(batches: DataFrame, path: str) -> None:
    """One canonical JSON line for each batch (``batch``, ``manifest``), a folder for each batch."""
    batches.select("batch", F.col("manifest").alias("value")).write.partitionBy("batch").mode("overwrite").text(path)


def chunked_json(df: DataFrame, body: str, order: list[str], max_bytes: int = 4 << 20) -> DataFrame:
    """(chunk, body): JSON arrays of at most ``max_bytes`` in order; ``df`` has the JSON text of each row."""
    rows = df.select(*order, body).withColumns({"__g": F.lit(0), "__id": F.sha2(F.concat_ws("\x1f", *order), 256), "__size": F.octet_length(body)})
    numbered = packing.chunk(rows, "__g", order, "__id", "__size", max_bytes)
    joined = rows.join(numbered.select("__id", "chunk"), "__id").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(body).alias("__b")))).alias("x"))
    return joined.select("chunk", F.concat(F.lit("["), F.array_join(F.col("x.__b"), ","), F.lit("]")).alias("body"))


def write_archive(path: str, bodies: Mapping[str, DataFrame], extra: Mapping[str, bytes] | None = None) -> str:
    """A reproducible ZIP of chunked banks (``name_N.json``) and extra members; its digest. Members are compressed where they are; the driver gets their compressed bytes one after another and holds none of them."""

    def compress(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                name, body = (c.to_pylist()[0] for c in batch.slice(at, 1).columns)
                yield pa.record_batch([pa.array([x]) for x in (name, *export.deflated(body.encode()))], names=["name", "crc", "size", "data"])

    def banks():
        named = [df.select(F.concat(F.lit(f"{name}_"), F.col("chunk").cast("string"), F.lit(".json")).alias("name"), "body") for name, df in bodies.items()]
        if named:
            for r in reduce(DataFrame.union, named).orderBy("name").mapInArrow(compress, "name string, crc long, size long, data binary").toLocalIterator():
                yield r["name"], r["crc"], r["size"], bytes(r["data"])

    def members():
        rest = [(name, *export.deflated(data)) for name, data in sorted((extra or {}).items())]
        for bank in banks():
            while rest and rest[0][0] <= bank[0]:
                if (one := rest.pop(0))[0] < bank[0]:
                    yield one
            yield bank
        yield from rest

    export.archive_deflated(path, members())
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_index_bundle(folder: str, entries: DataFrame, synonyms: DataFrame, title: str) -> dict[str, int]:
    """Body, index and synonym files of the index-and-body format: entries (expression, markup) in stable order, synonyms by place of their entry."""
    os.makedirs(folder, exist_ok=True)
    placed = export.offsets(entries, "expression", "markup").join(entries.select("expression", "markup"), "expression").orderBy(*stable_key("expression"))
    number, n = {}, 0
    with open(f"{folder}/dict.dict", "wb") as body, open(f"{folder}/dict.idx", "wb") as index:
        for r in placed.toLocalIterator():
            if body.tell() != r["start"]:
                raise ValueError("offsets don't follow one another")
            body.write(r["markup"].encode())
            index.write(export.index_record(r["expression"], r["start"], r["size"]))
            number[r["expression"]] = n
            n += 1
        size = index.tell()
    s = sorted(((r["word"].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})), r["word"], number[r["expression"]]) for r in synonyms.toLocalIterator()))
    with open(f"{folder}/dict.syn", "wb") as f:
        for _, word, k in s:
            f.write(export.index_record(word, k))
    atomic_write(f"{folder}/dict.ifo", f"StarDict's dict ifo file\nversion=2.4.2\nbookname={title}\nwordcount={n}\nsynwordcount={len(s)}\nidxfilesize={size}\n".encode())
    return {"words": n, "synonyms": len(s)}


def verify_index_bundle(folder: str) -> list[str]:
    """What is wrong with a bundle: order, offsets that leave gaps, synonyms of nothing, counts."""
    read = lambda n: open(f"{folder}/dict.{n}", "rb").read()
    out, at, last = [], 0, None
    index = export.parse_records(read("idx"), 2)
    for word, (start, size) in index:
        key = ("".join(c.lower() if c < "\x80" else c for c in word).encode(), word.encode())
        if last is not None and key < last:
            out.append(f"order: {word}")
        if start != at:
            out.append(f"offset: {word}")
        at, last = start + size, key
    if at != len(read("dict")):
        out.append("body size")
    syn = export.parse_records(read("syn"), 1)
    out += [f"synonym: {w}" for w, (k,) in syn if k >= len(index)]
    head = export.parse_header(read("ifo").decode())
    if int(head["wordcount"]) != len(index) or int(head["synwordcount"]) != len(syn):
        out.append("counts")
    return out


def xdxf_articles(entries: DataFrame) -> DataFrame:
    """(key, value): one ``ar`` element for each entry (expression, markup)."""
    return entries.select(F.col("expression").alias("key"), F.concat(F.lit("<ar><k>"), escaped("expression"), F.lit("</k>"), "markup", F.lit("</ar>")).alias("value"))


def write_ordered_text(df: DataFrame, path: str, head: str, tail: str) -> None:
    """Lines in stable order of ``key`` between a head and a tail, in one file, streamed range by range."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(head)
        for r in df.orderBy(*stable_key("key")).toLocalIterator():
            f.write(r["value"] + "\n")
        f.write(tail)
    os.replace(f"{path}.part", path)


def xml_entries(entries: DataFrame) -> DataFrame:
    """(key, value): ``d:entry`` elements with an index for the expression and for each other reading (identity, expression, readings, markup)."""
    words = F.array_distinct(F.concat(F.array("expression"), "readings"))
    index = F.array_join(F.transform(words, lambda w: F.concat(F.lit('<d:index d:value="'), escaped(w), F.lit('"/>'))), "")
    return entries.select(F.col("expression").alias("key"), F.concat(F.lit('<d:entry id="'), "identity", F.lit('">'), index, "markup", F.lit("</d:entry>")).alias("value"))


def page_files(df: DataFrame, order: list[str], cells: list[str], size: int = 100) -> DataFrame:
    """(page, body): table rows of each page of a site."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    p = pages(df.withColumn("__row", row), size, *[F.col(c) for c in order])
    return p.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "__row"))), lambda x: x["__row"]), "\n").alias("body"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files of a folder in stable order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy(*stable_key("path"))


def update_index(metadata: Mapping[str, str]) -> bytes:
    """The index that tells a client of a new revision: just these fields, all of them."""
    fields = ("title", "revision", "format", "indexUrl", "downloadUrl")
    if missing := [f for f in fields if not metadata.get(f)]:
        raise ValueError(f"missing: {missing}")
    return json.dumps({f: metadata[f] for f in fields}, ensure_ascii=False, indent=2).encode()


def markdown_report(title: str, rows: list[Mapping[str, object]]) -> str:
    """A heading and a table."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join(html.escape(str(r[n]), quote=False).replace("|", "\\|") for n in names) + " |" for r in rows]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"
