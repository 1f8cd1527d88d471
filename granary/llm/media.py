"""Media columns: payloads cut into content-defined chunks, stored once, put together again and verified."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, table

#: A cut is made where the top MASK_BITS bits of the rolling hash are 0, at least LEAST and at most MOST bytes after the last.
LEAST, MOST, MASK_BITS = 256, 16_384, 10
#: Bytes that the 32-bit gear hash remembers.
MEMORY = 32
LEVEL = 3
#: Rows of an Arrow batch that are taken up together.
ROWS = 100
#: Bytes hashed together, so that memory doesn't grow with a payload.
PART = 1 << 22

_GEAR = np.random.Generator(np.random.PCG64(0x6EA2)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 h + G[byte] modulo 2^32, by doubling the span summed instead of byte by byte."""
    h = _GEAR[data]
    span = 1
    while span < MEMORY and span < len(h):
        h = h.copy()
        h[span:] += h[:-span] << np.uint32(span) if span < 32 else 0
        span *= 2
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks. They depend on the bytes around them only, so an insertion moves no far-off cut."""
    n = len(payload)
    data = np.frombuffer(payload, np.uint8)
    marks = []
    for at in range(0, n, PART):
        before = max(0, at - MEMORY + 1)
        h = gear(data[before : at + PART])[at - before :]
        marks.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    out, last = [], 0
    for m in (np.concatenate(marks).tolist() if marks else []) + [n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    if last < n:
        out.append(n)
    return out


def chunk_payload(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


_CHUNK = T.StructType([T.StructField("seq", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType())])


def media_chunks(df: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """One row per payload: id, ``n_bytes``, ``sha256``, ``n_chunks``, ``n_stored``, ``chunks`` and ``verified``.

    ``chunks`` is the payload's ordered chunk list: (digest, size, payload),
    where the payload, zstd-compressed, is there in just one place of the whole
    table for each digest: the first by id, a hash of the row and position. The
    lists are the manifest, the filled places the chunk store. ``verified`` says
    that the payload, put together from stored chunks whose digests were
    checked, has the SHA-256 of the original.

    Digests alone are joined to find each chunk's owner. A payload moves once,
    compressed; after that a row holds the chunks that it owns, and only chunks
    with several users are sent to them.

    Null payloads give nulls and no chunks; an empty one has no chunks and is
    verified; an empty table gives no rows. A payload of any length is hashed in
    parts and cut whole. Rows alike in id and payload count as one. A string payload
    stands for its UTF-8 bytes. Other columns are ignored.
    """
    rows = df.select(df[id_col].alias("i"), df[payload_col].cast("binary").alias("p"))
    # 128 bits stand for a row's id and payload
    ident = F.md5(F.coalesce(F.concat(F.lit("i"), F.col("i").cast("string")), F.lit("none")).cast("binary"))
    rows = rows.withColumn("k", F.unhex(F.md5(F.concat(ident.cast("binary"), F.col("p")))))
    kind = rows.schema["i"].dataType
    absent = rows.where("p IS NULL").select("i").distinct()
    there = rows.where("p IS NOT NULL")

    def cut(batches):
        for batch in rows_of(batches, ROWS):
            ks, ns, ds, ss, at = [], [], [], [], []
            for r, (k, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n, c in enumerate(chunk_payload(p)):
                    at.append(r)
                    ks.append(k)
                    ns.append(n)
                    ds.append(hashlib.sha256(c).digest())
                    ss.append(len(c))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ks, pa.binary()), pa.array(ns, pa.int32()), pa.array(ds, pa.binary()), pa.array(ss, pa.int32())], names=["i", "k", "seq", "digest", "size"]
            )

    refs = there.select("i", "k", "p").mapInArrow(cut, T.StructType([T.StructField("i", kind), T.StructField("k", T.BinaryType()), *_CHUNK.fields]))
    # owners by partial sums and a join with skew handling: a digest with very many users isn't one task's work. Repeated rows give repeated references, which the sets below make one
    first = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "k", "seq"))
    owned = refs.join(refs.groupBy("digest").agg(first.alias("owner"), F.count("*").alias("uses")), "digest")
    owned = owned.select("k", "seq", "digest", "size", (F.col("owner.k").eqNullSafe(F.col("k")) & (F.col("owner.seq") == F.col("seq"))).alias("own"), (F.col("uses") > 1).alias("shared"))
    lists = owned.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("seq", "digest", "size", "own", "shared"))).alias("list"))

    def pack(batches):
        z = zstandard.ZstdCompressor(level=LEVEL)
        for batch in rows_of(batches, ROWS):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(p) for p in batch.column(2).to_pylist()], pa.binary())], names=["i", "k", "z"])

    moved = there.select("i", "k", "p").mapInArrow(pack, T.StructType([T.StructField("i", kind), T.StructField("k", T.BinaryType()), T.StructField("z", T.BinaryType())]))
    moved = moved.repartition("k").withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("k"))).where("n = 1").drop("n")
    placed = moved.join(lists, "k", "left").select("i", "k", "z", "list")

    def serve(batches):
        z, d = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in rows_of(batches, ROWS):
            digests, bodies = [], []
            for packed, chunks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                p, at = d.decompress(packed), 0
                for c in chunks or ():
                    if c["own"] and c["shared"]:
                        digests.append(c["digest"])
                        bodies.append(z.compress(p[at : at + c["size"]]))
                    at += c["size"]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["digest", "body"])

    # both uses of ``placed``, and both of ``owned``, take the same columns, so that each is shuffled once and read twice
    served = placed.select("i", "z", "list").mapInArrow(serve, "digest binary, body binary")
    wanted = owned.where("NOT own AND shared").select("k", "seq", "digest", "size")
    foreign = wanted.join(served, "digest").groupBy("k").agg(F.collect_set(F.struct("seq", "body", "size")).alias("foreign"))
    joined = placed.join(foreign, "k", "left").select("i", "z", "list", "foreign")
    out = T.StructType(
        [
            T.StructField("i", kind),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("sha256", T.StringType()),
            T.StructField("n_chunks", T.IntegerType()),
            T.StructField("n_stored", T.IntegerType()),
            T.StructField("chunks", T.ArrayType(T.StructType([T.StructField("digest", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("payload", T.BinaryType())]))),
            T.StructField("verified", T.BooleanType()),
        ]
    )
    struct = pa.list_(pa.struct([("digest", pa.string()), ("size", pa.int32()), ("payload", pa.binary())]))

    def rebuild(batches):
        z, d = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in rows_of(batches, ROWS):
            cols: list[list] = [[], [], [], [], [], []]
            for packed, chunks, others in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)]):
                original = d.decompress(packed)
                sha, chunks = hashlib.sha256(original).hexdigest(), chunks or []
                got = {o["seq"]: o["body"] for o in others or ()}
                at, listed, parts, sound = 0, [], [], True
                for c in chunks:
                    body = z.compress(original[at : at + c["size"]]) if c["own"] else None
                    at += c["size"]
                    stored = body if c["own"] else got.get(c["seq"])
                    part = d.decompress(stored) if stored is not None else b""
                    sound &= hashlib.sha256(part).digest() == c["digest"]
                    parts.append(part)
                    listed.append({"digest": c["digest"].hex(), "size": c["size"], "payload": body})
                for col, v in zip(cols, (len(original), sha, len(chunks), sum(c["own"] for c in chunks), listed, sound and hashlib.sha256(b"".join(parts)).hexdigest() == sha)):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), struct, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=out.names)

    done = joined.mapInArrow(rebuild, out)
    empty = absent.select("i", *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.fields[1:]])
    return done.union(empty).withColumnRenamed("i", id_col)


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks(table(spark, sf_dir, "pages"))
