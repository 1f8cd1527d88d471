"""Envelopes for workers, accepted values, reviews and adjudications, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kana_folded, strip
from .relational import latest


def envelopes(articles: DataFrame, units: DataFrame, evidence: DataFrame) -> DataFrame:
    """(article, term, reading, source_sha256, units, evidence): an article with its open units in order and the distinct evidence for it."""
    u = units.groupBy("article").agg(F.sort_array(F.collect_list(F.struct("ordinal", "unit", "role", "text", "digest"))).alias("units"))
    e = evidence.select("article", "kind", "value").distinct().groupBy("article").agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("evidence"))
    return articles.join(u, "article").join(e, "article", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(e.schema["evidence"].dataType)))


def accepted(translations: DataFrame) -> DataFrame:
    """The latest translation of each unit, by time and then id."""
    return latest(translations, ["unit"], F.desc("created_at"), F.desc("id"))


def review_candidates(translations: DataFrame) -> DataFrame:
    """The translation that a review of a unit is about: the accepted one, else the newest."""
    return latest(translations, ["unit"], F.desc("accepted"), F.desc("id"))


def review_issues(reviews: DataFrame, translations: DataFrame) -> DataFrame:
    """(unit, reviewer, issue): unknown unit, one's own translation, a change without a replacement, a replacement equal to the target."""
    j = reviews.join(review_candidates(translations).select("unit", "worker", "target"), "unit", "left")
    issue = (
        F.when(F.col("target").isNull(), "unknown_unit")
        .when(F.col("reviewer") == F.col("worker"), "own_translation")
        .when((F.col("decision") == "replace") & (F.coalesce(strip("replacement"), F.lit("")) == ""), "no_replacement")
        .when((F.col("decision") == "replace") & (F.col("replacement") == F.col("target")), "same_target")
        .when(~F.col("decision").isin("approve", "replace", "reject"), "unknown_decision")
    )
    return j.select("unit", "reviewer", issue.alias("issue")).where("issue IS NOT NULL")


def adjudicated(reviews: DataFrame, rulings: DataFrame) -> DataFrame:
    """(unit, decision, replacement): a ruling, else the decision that all reviewers of a unit share, else ``open``."""
    r = reviews.groupBy("unit").agg(F.count_distinct(F.struct("decision", F.coalesce("replacement", F.lit("")))).alias("n"), F.max("decision").alias("d"), F.max("replacement").alias("x"))
    j = r.join(rulings.select("unit", F.col("decision").alias("rd"), F.col("replacement").alias("rx")), "unit", "full_outer")
    one = F.col("n") == 1
    decision = F.coalesce("rd", F.when(one, F.col("d")), F.lit("open"))
    return j.select("unit", decision.alias("decision"), F.when(F.col("rd").isNotNull(), F.col("rx")).when(one, F.col("x")).alias("replacement"))


def tag_issues(tags: DataFrame, most: int = 16) -> DataFrame:
    """(code, issue) of translated tags: empty, longer than ``most``, unchanged kana, or a label that two codes of a category share."""
    label = strip("label")
    single = (
        F.when(F.coalesce(label, F.lit("")) == "", "empty")
        .when(F.length(label) > most, "too_long")
        .when(kana_folded(label).rlike("[ぁ-ゖ]"), "kana")
    )
    own = tags.select("code", single.alias("issue")).where("issue IS NOT NULL")
    twice = tags.groupBy("category", "label").agg(F.collect_set("code").alias("codes")).where("size(codes) > 1 AND label != ''")
    return own.unionByName(twice.select(F.explode("codes").alias("code"), F.lit("shared_label").alias("issue")))


def localised_references(rows: DataFrame, tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with their space-separated tag codes as labels in order; an error for a code that the mapping lacks. ``rows`` has ``row``."""
    codes = rows.select("row", F.posexplode(F.split("codes", " ")).alias("n", "code")).where("code != ''")
    j = codes.join(mapping.select("code", "label"), "code", "left")
    checked = j.withColumn("label", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), "code"))).otherwise(F.replace("label", F.lit(" "), F.lit(" "))))
    done = checked.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), " ").alias("labels"))
    return rows.join(done, "row", "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def tag_catalog(nodes: DataFrame, banks: DataFrame) -> DataFrame:
    """(source, code, label, category, n): tags met in trees with how often, and those that banks declare."""
    inside = nodes.where("map_contains_key(data, 'code')").select(F.lit("embedded").alias("source"), F.col("data")["code"].alias("code"), F.col("data")["label"].alias("label"), F.col("data")["category"].alias("category"))
    met = inside.groupBy("source", "code", "label", "category").agg(F.count("*").alias("n"))
    declared = banks.groupBy(F.lit("bank").alias("source"), "code", F.col("description").alias("label"), "category").agg(F.count("*").alias("n"))
    return met.unionByName(declared)


def cost(attempts: DataFrame, input_price: str, cached_price: str, output_price: str, factor: str = "1") -> DataFrame:
    """Exact cost of attempts: (input - cached) * p1 + cached * p2 + output * p3, times a factor, per million tokens."""
    d = lambda v: F.lit(v).cast("decimal(12,6)")
    n = lambda c: F.col(c).cast("decimal(12,0)")
    total = (n("input_tokens") - n("cached_input_tokens")) * d(input_price) + n("cached_input_tokens") * d(cached_price) + n("output_tokens") * d(output_price)
    return attempts.withColumn("cost", (total * F.lit(factor).cast("decimal(6,3)") / F.lit(1_000_000)).cast("decimal(30,12)"))
