"""Rules on texts: each row gets the codes of the rules that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mixed_tokens


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules]))


def plain_text_issues(target: Column, protected: Column, script: str = r"\p{IsCyrillic}", allow_no_script: Column | None = None, allowed: Column | None = None, most_foreign: int = 2) -> Column:
    """Codes, in the order of the rules: empty, markup, control_character, lost_token, no_script, mixed_alphabet, foreign_words.

    Protected tokens are taken out before the script and the foreign words are
    looked at.
    """
    bare = F.aggregate(protected, target, lambda acc, p: F.replace(acc, p, F.lit(" ")))
    words = F.transform(F.regexp_extract_all(bare, F.lit(r"\b[A-Za-z]{2,}\b"), 0), lambda w: F.lower(w))
    if allowed is not None:
        words = F.array_except(words, allowed)
    none = ~bare.rlike(script)
    if allow_no_script is not None:
        none = none & ~allow_no_script
    return _codes(
        (F.trim(target) == "", "empty"),
        (target.rlike(r"<[A-Za-z/][^>]*>|\[[^\]]*\]\([^)]*\)|```"), "markup"),
        (target.rlike(r"[\x{0000}-\x{0008}\x{000b}\x{000c}\x{000e}-\x{001f}\x{007f}]"), "control_character"),
        (F.exists(protected, lambda p: ~target.contains(p)), "lost_token"),
        (none & (F.trim(target) != ""), "no_script"),
        (F.size(mixed_tokens(bare)) > 0, "mixed_alphabet"),
        (F.size(words) > most_foreign, "foreign_words"),
    )


def set_issues(values: Column, most: int = 12) -> Column:
    """Codes for a list of texts: size (1 to ``most``), repeated, empty_item."""
    return _codes(
        ((F.size(values) < 1) | (F.size(values) > most), "size"),
        (F.size(F.array_distinct(values)) != F.size(values), "repeated"),
        (F.exists(values, lambda v: v.isNull() | (F.trim(v) == "")), "empty_item"),
    )


def response_issues(expected: DataFrame, got: DataFrame, key: str, digest: str) -> DataFrame:
    """(position, issue) of a response held against its manifest by place: missing, unexpected, order, source_changed. Both have ``position``."""
    e = expected.select("position", F.col(key).alias("__ek"), F.col(digest).alias("__ed"))
    g = got.select("position", F.col(key).alias("__gk"), F.col(digest).alias("__gd"))
    issue = (
        F.when(F.col("__gk").isNull(), "missing")
        .when(F.col("__ek").isNull(), "unexpected")
        .when(F.col("__ek") != F.col("__gk"), "order")
        .when(~F.col("__ed").eqNullSafe(F.col("__gd")), "source_changed")
    )
    return e.join(g, "position", "full_outer").select("position", issue.alias("issue")).where("issue IS NOT NULL")


def leaf_class(text: Column, selector: Column, lang: Column) -> Column:
    """MUST_TRANSLATE, MUST_PRESERVE or REVIEW of a visible leaf; the first rule that holds decides."""
    return (
        F.when(F.trim(text) == "", "MUST_PRESERVE")
        .when(lang == "ja", "MUST_PRESERVE")
        .when(~text.rlike(r"\p{L}"), "MUST_PRESERVE")
        .when(text.rlike(r"^https?://\S+$"), "MUST_PRESERVE")
        .when(selector.isin("glossary", "sense-note", "info-gloss"), "MUST_TRANSLATE")
        .when(text.rlike("[A-Za-z]") & text.rlike(r"\p{IsCyrillic}"), "REVIEW")
        .when(text.rlike(r"[A-Za-z]{3,}"), "MUST_TRANSLATE")
        .otherwise("REVIEW")
    )


def outcome(message: Column) -> Column:
    """Kind of a failure by its message; the order of the tests is part of the meaning."""
    m = F.lower(message)
    return (
        F.when(message.isNull(), "ok")
        .when(m.contains("rate limit") | m.contains("429"), "rate_limit")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("validation") | m.contains("schema"), "validation")
        .otherwise("transport")
    )


def usage_issues(df: DataFrame) -> DataFrame:
    """Usage rows that break an invariant: counts below zero, more cached than input, a total that isn't the sum."""
    return df.where("input_tokens < 0 OR output_tokens < 0 OR cached_input_tokens < 0 OR cached_input_tokens > input_tokens OR total_tokens != input_tokens + output_tokens")
