"""SentencePiece encoding and decoding of a text column by the weighted transducer of :mod:`.fst`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import rows_of, table
from .fst import machine

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of a text column that go through the machine together.
ROWS = 500


def encode_decode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (array of int), ``n_tokens`` and ``decoded``, the text that the ids stand for.

    ``ids`` is what the model's own library encodes. A null text gives nulls,
    an empty text no ids. ``decoded`` is the text itself unless the model's
    normaliser alters it. Repeated rows give repeated rows; columns other than
    the id and the text are ignored. There is no shuffle: rows stream through
    Arrow batches, whole texts at a time.
    """
    picked = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, picked.schema[0].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches):
        m = machine(model_path)
        for batch in rows_of(batches, ROWS):
            coded = m.encode(batch.column(1).to_pylist())
            arrays = [None if c is None else np.frombuffer(c, dtype=m.dtype) for c in coded]
            lengths = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int64)
            missing = np.array([a is None for a in arrays], dtype=bool)
            offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
            np.cumsum(lengths, out=offsets[1:])
            kept = [a for a in arrays if a is not None]
            flat = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
            mask = pa.array(missing) if missing.any() else None
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask)
            decoded = pa.array(m.decode_all(flat, lengths), pa.string(), mask=missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(lengths.astype(np.int32), mask=missing), decoded], names=[id_col, "ids", "n_tokens", "decoded"])

    return picked.mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
