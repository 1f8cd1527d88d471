"""Choosing what a run covers: ranked word lists matched to articles, notes resolved, content hashes of a selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import framed, nfc, reading_variants


def ranked_terms(rows: DataFrame, term: str, rank: str, limit: int) -> DataFrame:
    """(term, rank): normalised terms of rank 1 to ``limit``, ties at the limit kept, the best rank of each."""
    r = rows.select(nfc(term).alias("term"), F.col(rank).cast("long").alias("rank")).where((F.col("term") != "") & F.col("rank").between(1, limit))
    return r.groupBy("term").agg(F.min("rank").alias("rank"))


def matched(terms: DataFrame, articles: DataFrame, article: str = "article", expression: str = "expression", reading: str = "reading") -> DataFrame:
    """(source, term, article, match_kind): by expression; by reading only where a term is nobody's expression."""
    a = articles.select(F.col(article).alias("article"), nfc(expression).alias("e"), nfc(reading).alias("r"))
    t = terms.select("source", "term").distinct()
    by_e = t.join(a.select(F.col("e").alias("term"), "article"), "term").withColumn("match_kind", F.lit("expression"))
    rest = t.join(by_e.select("source", "term").distinct(), ["source", "term"], "left_anti")
    by_r = rest.join(a.where("r != ''").select(F.col("r").alias("term"), "article"), "term").withColumn("match_kind", F.lit("reading"))
    return by_e.unionByName(by_r).select("source", "term", "article", "match_kind").distinct()


def combined(sources: Mapping[str, DataFrame], articles: DataFrame, **columns: str) -> dict[str, DataFrame]:
    """``terms`` with a flag, ``links`` and ``selected`` articles of several ranked lists at once."""
    terms = None
    for name, s in sources.items():
        one = s.select(F.lit(name).alias("source"), "term", "rank")
        terms = one if terms is None else terms.unionByName(one)
    links = matched(terms, articles, **columns)
    hit = links.select("source", "term").distinct().withColumn("matched", F.lit(1))
    return {"terms": terms.join(hit, ["source", "term"], "left").fillna(0, ["matched"]), "links": links, "selected": links.select("article").distinct()}


def report(terms: DataFrame) -> DataFrame:
    """By source and for all together: terms, matched, skipped."""
    by = terms.groupBy("source").agg(F.count("*").alias("terms"), F.sum("matched").alias("matched"))
    union = terms.groupBy("term").agg(F.max("matched").alias("matched")).agg(F.count("*").alias("terms"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
    both = by.unionByName(union.select(F.lit("union").alias("source"), "terms", "matched"))
    return both.withColumn("skipped", F.col("terms") - F.col("matched"))


def candidates(notes: DataFrame, articles: DataFrame) -> DataFrame:
    """(note, article, sequence, match_kind) of notes (note, word, reading).

    An article is a candidate if its expression is the note's word and their
    readings share a variant. A note without any may take articles by reading
    alone, if its word is written in kana.
    """
    from ..functions.text import kana_folded, kana_only

    n = notes.select("note", nfc("word").alias("w"), reading_variants("reading").alias("rv"), kana_only(nfc("word")).alias("kana"), kana_folded(nfc("word")).alias("wk"))
    a = articles.select("article", "sequence", nfc("expression").alias("e"), reading_variants(F.when(F.col("reading") == "", F.col("expression")).otherwise(F.col("reading"))).alias("av"))
    exact = n.join(a, n["w"] == a["e"]).where(F.arrays_overlap("rv", "av") | (F.size("rv") == 0)).select("note", "article", "sequence", F.lit("expression").alias("match_kind"))
    rest = n.where("kana").join(exact.select("note").distinct(), "note", "left_anti")
    spoken = a.select("article", "sequence", F.explode("av").alias("v"))
    by_reading = rest.join(spoken, rest["wk"] == spoken["v"]).select("note", "article", "sequence", F.lit("reading").alias("match_kind"))
    return exact.unionByName(by_reading).distinct()


def resolved(notes: DataFrame, found: DataFrame) -> DataFrame:
    """(note, decision, sequence): included where the candidates have one sequence, else unresolved."""
    g = found.groupBy("note").agg(F.count_distinct("sequence").alias("n"), F.max("sequence").alias("s"))
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    return notes.select("note").join(g, "note", "left").select("note", F.when(one, "included").otherwise("unresolved").alias("decision"), F.when(one, F.col("s")).alias("sequence"))


def unresolved_report(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """(note, candidates) of the notes without a decision."""
    nested = found.groupBy("note").agg(F.sort_array(F.collect_list(F.struct("sequence", "article", "match_kind"))).alias("candidates"))
    return decisions.where("decision = 'unresolved'").select("note").join(nested, "note", "left")


def selection_hash(parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> str:
    """SHA-256 over ordered result sets: rows are hashed where they are, then ranges in order, so that only one digest for each range comes to the driver."""
    import hashlib

    h = hashlib.sha256()
    for df, columns in parts:
        line = F.sha2(framed(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
        rows = df.select(F.struct(*columns).alias("o"), line.alias("l")).withColumn("p", F.substring(F.sha2(F.col("o").cast("string"), 256), 1, 2))
        # a part is named by content, so the result doesn't depend on partitions
        one = rows.groupBy("p").agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("o", "l"))), lambda x: x["l"])), 256).alias("d"))
        for r in one.orderBy("p").collect():
            h.update(f"{r['p']}:{r['d']}".encode())
        h.update(b"|")
    return h.hexdigest()
