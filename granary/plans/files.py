"""Sinks and sources held against the tables they were written from: each query writes files of its own, reads them back and gives what they say."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import checkpoint_dir
from ..sources import archives, sinks
from .registry import Tables, query


def _place(t: Tables, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(t.spark).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}/{name}"


def _archive(t: Tables, kind: str, rows: DataFrame, order: str, limit: int) -> str:
    """An archive of banks of at most ``limit`` bytes, with ``rows`` having the JSON text of each row."""
    import os

    path = _place(t, "terms.zip")
    os.makedirs(os.path.dirname(path))
    sinks.write_archive(path, {kind: sinks.chunked_json(rows, "body", [order], limit)}, {"index.json": b"{}"})
    return path


@query("""
WITH RECURSIVE b AS MATERIALIZED (SELECT p_partkey, p_name, p_brand, p_size, strlen('["' || p_name || '","' || p_brand || '","","",' || p_size || ',["' || p_type || '"],' || p_partkey || ',""]') AS n, row_number() OVER (ORDER BY p_partkey) AS k FROM part),
s AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS bank, 2::BIGINT AS size UNION ALL
  SELECT b.k, CASE WHEN s.k = 0 OR size + n + 1 > 20000 THEN bank + 1 ELSE bank END, CASE WHEN s.k = 0 OR size + n + 1 > 20000 THEN 2 + n ELSE size + n + 1 END FROM s JOIN b ON b.k = s.k + 1
)
SELECT CAST(bank AS INTEGER) AS bank, CAST(row_number() OVER (PARTITION BY bank ORDER BY k) - 1 AS INTEGER) AS ordinal, p_name AS expression, p_brand AS reading, CAST(p_size AS DOUBLE) AS score, p_partkey AS sequence FROM s JOIN b USING (k)
""")
def term_archive(t: Tables) -> DataFrame:
    """Term banks packed by bytes into an archive, and read again in the order of their numbers."""
    s = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    n = lambda c: F.col(c).cast("string")
    body = F.concat(F.lit("["), F.concat_ws(",", s("p_name"), s("p_brand"), F.lit('""'), F.lit('""'), n("p_size"), F.concat(F.lit("["), s("p_type"), F.lit("]")), n("p_partkey"), F.lit('""')), F.lit("]"))
    path = _archive(t, "term_bank", t.part.select("p_partkey", body.alias("body")), "p_partkey", 20_000)
    return archives.read_terms(t.spark, path).select("bank", "ordinal", "expression", "reading", "score", "sequence")


def _ranks(t: Tables) -> str:
    """Ranks as numbers, and as objects with one of two names; some kinds and values aren't ranks."""
    k = F.col("c_custkey")
    rank = F.col("c_nationkey").cast("string")
    value = F.when(k % 4 == 0, rank).when(k % 4 == 1, F.concat(F.lit('{"value":'), rank, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit('{"frequency":'), rank, F.lit(',"value":1}'))).otherwise(F.lit("true"))
    kind = F.when(k % 5 == 0, "pitch").otherwise("freq")
    body = F.concat(F.lit('["'), F.col("c_mktsegment"), (k % 40).cast("string"), F.lit('","'), kind, F.lit('",'), value, F.lit("]"))
    return _archive(t, "term_meta_bank", t.customer.select("c_custkey", body.alias("body")), "c_custkey", 4_000)


@query("""
SELECT c_mktsegment || c_custkey % 40 AS term, CAST(min(c_nationkey) AS BIGINT) AS rank FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 3 AND c_nationkey BETWEEN 1 AND 12 GROUP BY 1
""")
def recorded_ranks(t: Tables) -> DataFrame:
    """The best recorded rank of each term, within a limit; ranks come in three shapes."""
    return archives.read_ranks(t.spark, _ranks(t), 12, True).select("term", "rank")


@query("""
WITH r AS (SELECT c_mktsegment || c_custkey % 40 AS term, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 5 <> 0) SELECT term, min(k) AS rank FROM r WHERE k <= 100 GROUP BY 1
""")
def placed_ranks(t: Tables) -> DataFrame:
    """The best place of each term among the first hundred rows of an archive."""
    return archives.read_ranks(t.spark, _ranks(t), 100, False).select("term", "rank")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 2 = 0")
def strict_csv(t: Tables) -> DataFrame:
    """A CSV file with a header that has to be the schema's and a number of rows that was agreed."""
    d = t.documents.where("doc_id % 2 = 0").select("doc_id", "lang", "source", "n_chars")
    path = _place(t, "rows.csv")
    d.write.csv(path, header=True)
    return archives.read_strict_csv(t.spark, path, d.schema, d.count())


@query("SELECT doc_id, lang, text FROM documents WHERE doc_id % 3 = 0")
def strict_jsonl(t: Tables) -> DataFrame:
    """One object on each line, texts with line breaks and quotes among them."""
    d = t.documents.where("doc_id % 3 = 0").select("doc_id", "lang", "text")
    path = _place(t, "rows.jsonl")
    d.write.json(path)
    return archives.read_strict_jsonl(t.spark, path, T.StructType(d.schema.fields))


@query(r"""
SELECT conv_id, turn, string_split(role || chr(31) || text, chr(31))[1] AS speaker, trim(text, ' ') AS said, '' AS missing FROM conversations
""")
def split_note_fields(t: Tables) -> DataFrame:
    """Fields at U+001F by name; one that isn't there is empty."""
    f = archives.split_fields(F.concat(F.col("role"), F.lit("\x1f"), F.col("text")), ["speaker", "said", "missing"])
    return t.conversations.select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", "f.*")


@query("SELECT conv_id, turn, text FROM conversations")
def response_texts(t: Tables) -> DataFrame:
    """The one output text of a response envelope that has parts of other kinds besides."""
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    content = lambda *p: F.struct(F.array(*p).alias("content"))
    body = F.to_json(F.struct(F.array(content(part("summary", F.col("role"))), content(part("refusal", F.lit("no")), part("output_text", F.col("text")))).alias("output")))
    return archives.responses(t.conversations.select("conv_id", "turn", body.alias("body")), "body").select("conv_id", "turn", "text")


@query("""
WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS words, CAST(sum(n > 2) AS BIGINT) AS synonyms, 0 AS issues FROM e
""")
def index_bundle(t: Tables) -> DataFrame:
    """Body, index and synonym files written and checked: as many words and synonyms as there are, and nothing wrong."""
    e = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    word = F.concat(F.lit("W"), F.col("user_id").cast("string"))
    entries = e.select(word.alias("expression"), F.repeat(F.lit("é"), (F.col("n") % 50).cast("int")).alias("markup"))
    synonyms = e.where("n > 2").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("word"), word.alias("expression"))
    folder = _place(t, "bundle")
    made = sinks.write_index_bundle(folder, entries, synonyms, "test")
    issues = sinks.verify_index_bundle(folder)
    return t.spark.range(1).select(F.lit(made["words"]).cast("long").alias("words"), F.lit(made["synonyms"]).cast("long").alias("synonyms"), F.lit(len(issues)).alias("issues"))
