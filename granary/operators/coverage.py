"""Progress and coverage: what of a corpus is done, by the rule that a group is done when all its members are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headword_progress(articles: DataFrame, in_run: DataFrame, units: DataFrame, done_units: DataFrame, head: Sequence[str], article: str, unit: str) -> DataFrame:
    """One row (done, total): headwords all of whose articles are in the run with every unit done.

    A headword is open if one of its articles isn't in the run, or has an open unit.
    """
    outside = articles.join(in_run.select(article), article, "left_anti").select(*head)
    open_articles = units.join(done_units.select(unit), unit, "left_anti").select(article)
    unfinished = articles.join(open_articles, article, "left_semi").select(*head)
    open_heads = outside.union(unfinished).distinct()
    total = articles.select(*head).distinct().agg(F.count("*").alias("total"))
    left = open_heads.agg(F.count("*").alias("open"))
    return total.crossJoin(left).select((F.col("total") - F.col("open")).alias("done"), "total")


def strict_coverage(terms: DataFrame, mapping: DataFrame, in_run: DataFrame, source: str, term: str, item: str) -> DataFrame:
    """By source: terms, terms with any mapped item, and terms with all mapped items in the run."""
    flags = mapping.join(in_run.select(item).distinct().withColumn("__in", F.lit(True)), item, "left").groupBy(source, term).agg(F.min(F.coalesce("__in", F.lit(False))).alias("all_in"))
    joined = terms.select(source, term).distinct().join(flags, [source, term], "left")
    return joined.groupBy(source).agg(
        F.count("*").alias("terms"), F.count("all_in").alias("matched"), F.count_if("all_in").alias("covered")
    )


def loose_coverage(terms: DataFrame, mapping: DataFrame, in_run: DataFrame, source: str, term: str, item: str) -> DataFrame:
    """By source: terms, and terms with any mapped item in the run."""
    hit = mapping.join(in_run.select(item), item, "left_semi").select(source, term).distinct().withColumn("__hit", F.lit(1))
    joined = terms.select(source, term).distinct().join(hit, [source, term], "left")
    return joined.groupBy(source).agg(F.count("*").alias("terms"), F.count("__hit").alias("covered"))


def membership_histogram(members: DataFrame, source: str, word: str) -> DataFrame:
    """(sources, words): how many words occur in how many sources."""
    return members.select(source, word).distinct().groupBy(word).agg(F.count("*").alias("sources")).groupBy("sources").agg(F.count("*").alias("words"))
