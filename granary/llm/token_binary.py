"""Token ids as directly addressable codes: any id of a document can be read without decoding the others."""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import rows_of, table

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAGIC = b"DAC1"
#: Bits of a code's chunk at each level; the last is repeated as often as the largest id needs.
LEVEL_BITS = 8
#: Bits between two entries of a rank directory.
RANK_BLOCK = 512
#: A text is tokenised in one call up to this length, else cut where a pre-token surely ends.
CUT = 200_000
#: Runs of white space from this length on are encoded by themselves, as the pattern's look-ahead would go through them with a stack of their length.
RUN = 1_000
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUNS = re.compile(f"{_WHITE}{{{RUN},}}")


def dac_encode(ids: np.ndarray) -> bytes:
    """Levels of 8-bit chunks, low chunk first. Level k holds the k-th chunks of the ids that have one; its bitmap says which ids go on at level k+1, and its rank directory counts the set bits before every 512-bit block, so that an id's place at the next level is one directory read and one popcount away. An empty array has no level."""
    ids = np.asarray(ids, dtype=np.uint64)
    head, body = [], []
    while len(ids):
        chunk = (ids & np.uint64((1 << LEVEL_BITS) - 1)).astype(np.uint8)
        more = ids >= np.uint64(1 << LEVEL_BITS)
        bits = np.packbits(more, bitorder="little")
        pad = -len(bits) % (RANK_BLOCK // 8)
        bits = np.concatenate([bits, np.zeros(pad, np.uint8)])
        per_block = np.bitwise_count(bits.view(np.uint64)).reshape(-1, RANK_BLOCK // 64).sum(axis=1)
        directory = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        head.append(len(ids))
        body += [chunk.tobytes(), bits.tobytes(), directory.tobytes()]
        ids = ids[more] >> np.uint64(LEVEL_BITS)
    return MAGIC + struct.pack(f"<I{len(head)}I", len(head), *head) + b"".join(body)


def _levels(code: bytes):
    """(count, offset of chunks, of bitmap, of directory) of each level, from the header alone."""
    if code[:4] != MAGIC:
        raise ValueError("not a directly addressable code")
    (n,) = struct.unpack_from("<I", code, 4)
    at, out = 8 + 4 * n, []
    for count in struct.unpack_from(f"<{n}I", code, 8):
        blocks = -(-count // RANK_BLOCK)
        out.append((count, at, at + count, at + count + blocks * (RANK_BLOCK // 8)))
        at += count + blocks * (RANK_BLOCK // 8) + 4 * blocks
    return out


def dac_length(code: bytes) -> int:
    levels = _levels(code)
    return levels[0][0] if levels else 0


def dac_get(code: bytes, i: int) -> int:
    """Id number ``i``: per level one chunk, one bit and one rank, whatever the length."""
    levels = _levels(code)
    if not levels or not 0 <= i < levels[0][0]:
        raise IndexError(i)
    value = shift = 0
    for _, chunks, bitmap, directory in levels:
        value |= code[chunks + i] << shift
        if not code[bitmap + (i >> 3)] >> (i & 7) & 1:
            break
        block = i // RANK_BLOCK
        (rank,) = struct.unpack_from("<I", code, directory + 4 * block)
        start = bitmap + block * (RANK_BLOCK // 8)
        inside = int.from_bytes(code[start : bitmap + (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BLOCK)) - 1)
        i = rank + inside.bit_count()
        shift += LEVEL_BITS
    return value


def dac_decode(code: bytes) -> np.ndarray:
    """All ids at once."""
    levels = _levels(code)
    out = np.zeros(levels[0][0] if levels else 0, dtype=np.uint64)
    at = np.arange(len(out))
    for k, (count, chunks, bitmap, _) in enumerate(levels):
        out[at] |= np.frombuffer(code, np.uint8, count, chunks).astype(np.uint64) << np.uint64(k * LEVEL_BITS)
        more = np.unpackbits(np.frombuffer(code, np.uint8, -(-count // 8), bitmap), bitorder="little", count=count).astype(bool)
        at = at[more]
    return out


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str):
    """Long texts cut before a space that follows a letter: a pre-token never reaches over that place."""
    while len(text) > CUT:
        at = CUT
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[:at]
        text = text[at:]
    yield text


def _encoded(text: str, e) -> list[np.ndarray]:
    return [e.encode_to_numpy(p, disallowed_special=()) for p in (_pieces(text) if len(text) > CUT else (text,)) if p]


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of the whole text. Of a run of white space, all but the last character are one pre-token if something follows, else all."""
    e = byte_encoder(path)
    if len(text) < RUN:
        return e.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    for run in _RUNS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += [*_encoded(text[at : run.start()], e), np.array(e._encode_single_piece(text[run.start() : stop]), dtype=np.uint32)]
        at = stop
    out += _encoded(text[at:], e)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def token_codes(docs: DataFrame, ranks_path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_bytes`` and ``code``, its token ids as directly addressable codes.

    A null text gives nulls, an empty text (of an empty table there is none) a
    code without levels. A text of any length is encoded whole. Repeated rows
    give repeated rows; columns other than the id and the text are ignored.
    Nothing is shuffled or collected; a code is a document's own, so a reader
    needs one row to get at any of its tokens.
    """
    picked = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, picked.schema[0].dataType),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("n_bytes", T.IntegerType()),
            T.StructField("code", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in rows_of(batches, 1000):
            n, codes = [], []
            for text in batch.column(1).to_pylist():
                if text is None:
                    n.append(None)
                    codes.append(None)
                    continue
                ids = token_ids(text, ranks_path)
                n.append(len(ids))
                codes.append(dac_encode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array([None if c is None else len(c) for c in codes], pa.int32()), pa.array(codes, pa.binary())],
                names=[id_col, "n_tokens", "n_bytes", "code"],
            )

    return picked.mapInArrow(run, schema)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(table(spark, sf_dir, "documents"))
