"""Text, hash and identifier functions.

Everything that Spark's own functions can say stays a column expression; only
Unicode normalisation, which Spark lacks, goes through Arrow.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{001c}-\x{001f}]+"
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of all scripts off both ends (trim takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(_col(c), "^" + _SPACE, ""), _SPACE + "$", "")


def _normaliser(form: str):
    @F.pandas_udf("string")
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return normalise


def nfc(c: Column | str) -> Column:
    """NFC, stripped. ASCII texts, the most, don't need Python, but a column can't know; the test is the first thing done there."""
    return strip(_normaliser("NFC")(_col(c)))


def nfkc(c: Column | str) -> Column:
    return _normaliser("NFKC")(_col(c))


def kana_folded(c: Column | str) -> Column:
    """Katakana as hiragana."""
    return F.translate(_col(c), _KATAKANA, _HIRAGANA)


def reading_variants(c: Column | str) -> Column:
    """Variants of a reading: compatibility form, cut at separators, kana folded, empty ones dropped, first seen kept."""
    parts = F.transform(F.split(nfkc(c), "[・/／,、]"), lambda x: kana_folded(strip(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def kana_only(c: Column | str) -> Column:
    return _col(c).rlike("^[ぁ-ゖァ-ヺー・]+$")


def stable_key(c: Column | str) -> list[Column]:
    """Sort keys that no locale changes: ASCII case folded, then the raw bytes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [F.translate(_col(c), upper, upper.lower()), _col(c)]


PROTECTED = [
    r"https?://[^\s)\]>\"']+",
    r"\{[A-Za-z0-9_]*\}",
    r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}々〆〤ー]+",
    r"\d+(?:[.,:/-]\d+)*",
    r"\b[A-Z]{2,}(?:[-/][A-Z0-9]+)*\b",
    r"\b(?:Ctrl|Alt|Shift|Cmd)(?:\+[A-Za-z0-9]+)+",
]


def protected_tokens(c: Column | str, patterns: list[str] = PROTECTED) -> Column:
    """What a rewrite of a text has to keep: links, placeholders, CJK runs, numbers, acronyms and key chords, first seen kept."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(_col(c), F.lit(p), 0) for p in patterns]))


_NOT_GENUS = "The|This|That|These|Those|When|While|With|From|Into|And|But|For|Not|You|They|She|His|Her|Its|Our"
_NOT_SPECIES = "and|the|of|in|on|or|to|is|was|are|for|with|from|by|as|at|an|be|that|this|which|used|also"


def taxa(c: Column | str) -> Column:
    """Latin binomials; an abbreviated genus counts once its full name has been seen."""
    text = _col(c)
    full = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,} [a-z]{3,}\b"), 0), lambda x: ~x.rlike(rf"^({_NOT_GENUS}) ") & ~x.rlike(rf" ({_NOT_SPECIES})$"))
    short = F.regexp_extract_all(text, F.lit(r"\b[A-Z]\. [a-z]{3,}\b"), 0)
    initials = F.transform(full, lambda x: F.substring(x, 1, 1))
    return F.array_distinct(F.concat(full, F.filter(short, lambda x: F.array_contains(initials, F.substring(x, 1, 1)))))


def kept_space(source: Column | str, target: Column | str) -> Column:
    """The target with the white space that stood around the source."""
    s = _col(source)
    return F.concat(F.regexp_extract(s, r"^(\s*)", 1), strip(target), F.when(strip(s) == "", "").otherwise(F.regexp_extract(s, r"(\s*)$", 1)))


_MIXED = r"[A-Za-z][\x{0400}-\x{04ff}]|[\x{0400}-\x{04ff}][A-Za-z]"
_LATIN, _CYRILLIC = "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"


def mixed_tokens(c: Column | str) -> Column:
    """Words of two alphabets."""
    return F.filter(F.regexp_extract_all(_col(c), F.lit(r"[A-Za-z\x{0400}-\x{04ff}]+"), 0), lambda x: x.rlike(_MIXED))


def homoglyphs_repaired(token: Column | str) -> Column:
    """Look-alike Latin letters as Cyrillic, if that leaves no Latin letter; else null."""
    fixed = F.translate(_col(token), _LATIN, _CYRILLIC)
    return F.when(_col(token).rlike(_MIXED) & ~fixed.rlike("[A-Za-z]"), fixed)


def tag_text(tags: Column | str) -> Column:
    """Tags as one string that splits at spaces: spaces inside a tag become no-break ones."""
    return F.array_join(F.transform(_col(tags), lambda x: F.replace(x, F.lit(" "), F.lit(" "))), " ")


def xml_safe(c: Column | str) -> Column:
    return ~_col(c).rlike(r"[\x{0000}-\x{0008}\x{000b}\x{000c}\x{000e}-\x{001f}\x{fffe}\x{ffff}]")


def escaped(c: Column | str) -> Column:
    """HTML-escaped; an error for characters that XML forbids."""
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(xml_safe(c), out).otherwise(F.raise_error(F.lit("a character that XML forbids")))


def class_name(c: Column | str) -> Column:
    """A class name of letters, digits, dashes and underscores, or null."""
    x = F.regexp_replace(F.regexp_replace(_col(c), r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.when(x != "", x)


def link_kind(c: Column | str) -> Column:
    x = _col(c)
    return F.when(x.isNull() | (x == ""), "empty").when(x.startswith("?"), "internal").when(x.startswith("#"), "anchor").when(x.rlike(r"^https?://"), "external").when(x.rlike(r"^[a-z][a-z0-9+.-]*:"), "scheme").otherwise("relative")


def entry_href(c: Column | str, scheme: str = "entry://") -> Column:
    """A link by query as a link to the entry; other links as they are."""
    q = F.regexp_extract(_col(c), r"^\?(?:[^#]*&)?query=([^&#]*)", 1)
    return F.when(q != "", F.concat(F.lit(scheme), q)).otherwise(_col(c))


def safe_path(c: Column | str) -> Column:
    """Whether a path is relative, without parents, backslashes, empty parts or control characters."""
    x = _col(c)
    return (x != "") & ~x.startswith("/") & ~x.rlike(r"[\\\x{0000}-\x{001f}:]") & ~F.exists(F.split(x, "/"), lambda p: p.isin("", ".", ".."))


def rank_label(c: Column | str) -> Column:
    x = _col(c)
    return F.when((x % 1000 == 0) & (x > 0), F.concat((x / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(x.cast("string"))


def entry_identity(c: Column | str) -> Column:
    return F.concat(F.lit("e-"), F.substring(F.sha2(_col(c), 256), 1, 24))


def framed(*parts: Column) -> Column:
    """Parts with their byte lengths before them, so that no two lists look alike when hashed."""
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def utc_text(c: Column | str) -> Column:
    """A timestamp as ISO text in UTC; microseconds only where there are some."""
    x = _col(c).cast("timestamp")
    return F.when(F.date_format(x, "SSSSSS") == "000000", F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def template_leftovers(c: Column | str) -> Column:
    """Number of template marks left in a text."""
    return F.regexp_count(F.lower(_col(c)), F.lit(r"\{\{|\}\}|\{%|%\}"))
