"""Archives and logs as DataFrames.

An archive is one file, so it is opened by one task; many archives are opened by
many. Strict readers fail on what they don't know.
"""

from __future__ import annotations

import io
import json
import re
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontree import canonical, digest

TERM = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("bank", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("expression", T.StringType()),
        T.StructField("reading", T.StringType()),
        T.StructField("definition_tags", T.StringType()),
        T.StructField("rules", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("glossary", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("term_tags", T.StringType()),
        T.StructField("raw_json", T.StringType()),
        T.StructField("source_sha256", T.StringType()),
    ]
)
TAG = T.StructType([T.StructField(n, t) for n, t in (("archive", T.StringType()), ("bank", T.IntegerType()), ("ordinal", T.IntegerType()), ("code", T.StringType()), ("category", T.StringType()), ("position", T.DoubleType()), ("description", T.StringType()), ("score", T.DoubleType()))])
RANK = T.StructType([T.StructField(n, t) for n, t in (("archive", T.StringType()), ("bank", T.IntegerType()), ("ordinal", T.IntegerType()), ("term", T.StringType()), ("rank", T.LongType()))])


def banks(names: list[str], kind: str) -> list[tuple[int, str]]:
    """Bank files of a kind in the order of their numbers."""
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(rf"{kind}_bank_(\d+)\.json", n)))


def rank_of(value) -> int | None:
    """A rank given as a number, or as an object's ``frequency`` or ``value``; booleans and others are none."""
    if isinstance(value, dict):
        value = value.get("frequency", value.get("value"))
    return None if isinstance(value, bool) or not isinstance(value, (int, float)) else int(value)


def _members(spark: SparkSession, path: str, kind: str, schema: T.StructType, make) -> DataFrame:
    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for number, member in banks(z.namelist(), kind):
                        rows = [(name, number, k, *r) for k, row in enumerate(json.loads(z.read(member))) if (r := make(row)) is not None]
                        yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the term banks; rows of fewer than eight fields, or without an integer sequence, are left out."""

    def make(row):
        match row:
            case [_, _, _, _, _, _, sequence, _, *_] if type(sequence) is int:
                pass
            case _:
                return None
        return row[0], row[1], row[2] or "", row[3] or "", float(row[4]), canonical(row[5]), row[6], row[7] or "", canonical(row), digest(row)

    return _members(spark, path, "term", TERM, make)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _members(spark, path, "tag", TAG, lambda r: (r[0], r[1], float(r[2]), r[3], float(r[4])))


def read_ranks(spark: SparkSession, path: str, limit: int, recorded: bool) -> DataFrame:
    """(archive, term, rank): by recorded rank within the limit, ties kept, or by place among the first ``limit`` rows. The best rank of a term counts."""
    raw = _members(spark, path, "term_meta", RANK, lambda r: (r[0], rank_of(r[2])) if len(r) > 2 and r[1] == "freq" else None)
    if recorded:
        kept = raw.where(F.col("rank").between(1, limit))
    else:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("archive").orderBy("bank", "ordinal"))
        kept = raw.withColumn("rank", place.cast("long")).where(F.col("rank") <= limit)
    return kept.groupBy("archive", "term").agg(F.min("rank").alias("rank"))


def split_fields(raw: Column, names: list[str]) -> Column:
    """Fields at U+001F by name; missing ones are empty."""
    parts = F.split(raw, "\x1f")
    return F.struct(*[F.coalesce(F.trim(F.get(parts, F.lit(k))), F.lit("")).alias(n) for k, n in enumerate(names)])


def read_notes(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Notes of flash-card packages: (archive, note_id, fields), notes without a required field left out. The newest collection in a package counts."""

    def run(frames):
        import zstandard

        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    have = set(z.namelist())
                    member = next(m for m in ("collection.anki21b", "collection.anki21", "collection.anki2") if m in have)
                    data = z.read(member)
                if member.endswith("b"):
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                db = sqlite3.connect(":memory:")
                db.deserialize(data)
                models = json.loads(db.execute("SELECT models FROM col").fetchone()[0])
                rows = []
                for note, model, fields in db.execute("SELECT id, mid, flds FROM notes ORDER BY id"):
                    names = [x["name"] for x in models[str(model)]["flds"]]
                    values = dict(zip(names, [v.strip() for v in fields.split("\x1f")] + [""] * len(names)))
                    if all(values.get(r) for r in required):
                        rows.append((name, note, values))
                db.close()
                yield pd.DataFrame(rows, columns=["archive", "note_id", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, note_id long, fields map<string,string>")


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """A CSV file whose header and types have to be the schema's, with so many rows."""
    with_header = spark.read.text(path, wholetext=False).limit(1).first()
    header = (with_header[0] if with_header else "").lstrip("﻿")
    if header.split(",") != schema.fieldNames():
        raise ValueError("the header differs from the schema")
    out = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=True)
    if rows is not None and out.count() != rows:
        raise ValueError("another number of rows than agreed")
    return out


def read_strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object on each line; a blank or broken line is an error."""
    lines = spark.read.text(path)
    checked = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line"))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def responses(df: DataFrame, body: str) -> DataFrame:
    """Adds ``text``: the one output text of a response; an error if there are none or several."""
    shape = "struct<output array<struct<content array<struct<type string, text string>>>>>"
    texts = F.filter(F.flatten(F.col("__b.output.content")), lambda c: c["type"] == "output_text")
    out = df.withColumn("__b", F.from_json(body, shape)).withColumn("__t", texts)
    return out.withColumn("text", F.when(F.size("__t") == 1, F.col("__t")[0]["text"]).otherwise(F.raise_error(F.lit("not one output text")))).drop("__b", "__t")


def process_log(df: DataFrame, line: str, order: str) -> DataFrame:
    """(thread, input_tokens, output_tokens): last values of a process log; lines that aren't JSON are passed over."""
    e = df.select(order, F.from_json(line, "type string, thread_id string, usage struct<input_tokens long, output_tokens long>").alias("e"))
    return e.agg(
        F.max_by(F.when(F.col("e.type") == "thread.started", F.col("e.thread_id")), F.when(F.col("e.type") == "thread.started", F.col(order))).alias("thread"),
        F.max_by(F.col("e.usage.input_tokens"), F.when(F.col("e.type") == "turn.completed", F.col(order))).alias("input_tokens"),
        F.max_by(F.col("e.usage.output_tokens"), F.when(F.col("e.type") == "turn.completed", F.col(order))).alias("output_tokens"),
    )
