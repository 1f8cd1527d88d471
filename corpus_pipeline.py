"""The training-data pipeline: documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, near_dedup, sentencepiece_fst, toxicity
from granary.llm.common import forget, new_folder, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts stay, and so does everything where no document is labelled as toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one, up to PIPELINE_EDITS edits; a document of such lines alone goes. Null, empty and blank texts stay; rows alike in id and text share one fate."""
    return line_dedup.without_repeated_lines(docs, most_edits=line_dedup.PIPELINE_EDITS)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others. Null texts and those without a word stay; of rows alike in id and text one stays."""
    return near_dedup.without_near_duplicates(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed blocks as documents: each has its block's text, the id and language of the document that its first token is from, its source and its length. Columns that only a whole document has are null. Null and empty texts have no tokens and give no block."""
    mixed = mixing.mix(docs)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "lang": F.col("lang"), "source": F.col("source"), "n_chars": F.length("text")}
    return mixed.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in docs.schema])


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to; of a null text neither, of an empty one no ids."""
    return sentencepiece_fst.encode_decode(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line dedup", _line_dedup),
    ("near dedup", _near_dedup),
    ("mixing", _mix),
    ("sentencepiece", _encode),
]

#: Classifier, sampling and tokeniser can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's result is written to the shared folder and read again, which also cuts its lineage; what the next stage has been made from is then deleted. An empty table gives an empty result, and columns besides those of documents go through to the mixing stage."""
    docs = table(spark, sf_dir, "documents")
    where = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            forget(spark, f"{where}/{k - 1}")
    return docs
