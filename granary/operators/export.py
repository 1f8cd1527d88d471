"""Entries grouped from rows, and the records that dictionary formats are made of."""

from __future__ import annotations

import html
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterable, Mapping
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontree as J
from ..functions.text import entry_identity, stable_key
from .relational import running

#: All members of an archive bear this time, so that equal contents are equal bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)


def entries(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(expression, identity, variants, readings): rows grouped by expression, variants in source order, readings first seen and other than the expression."""
    bad = F.when(F.col("expression").isNull() | (F.col("expression") == "") | F.col("expression").contains("\0"), F.raise_error(F.lit("an expression is empty or has a NUL"))).otherwise(F.col("expression"))
    others = [c for c in rows.columns if c not in ("expression", ordinal)]
    g = rows.withColumn("expression", bad).groupBy("expression").agg(F.sort_array(F.collect_list(F.struct(ordinal, *others))).alias("variants"))
    readings = F.array_distinct(F.filter(F.col("variants.reading"), lambda r: (r != "") & (r != F.col("expression"))))
    return g.select("expression", entry_identity("expression").alias("identity"), "variants", readings.alias("readings"))


def offsets(bodies: DataFrame, key: str, body: str, shelf: str | None = None) -> DataFrame:
    """(key, start, size): where each body begins when they stand one after another in stable order of the key, within each shelf. Only keys and sizes are moved."""
    by = [shelf] if shelf else []
    sized = bodies.select(*by, key, F.octet_length(body).cast("long").alias("size"))
    return running(sized, F.col("size"), "start", stable_key(key), by).select(*by, key, "start", "size")


def synonyms(grouped: DataFrame) -> DataFrame:
    """(word, expression) of the readings, distinct."""
    return grouped.select(F.explode("readings").alias("word"), "expression").distinct()


def redirects(syn: DataFrame, known: DataFrame) -> DataFrame:
    """(word, kind, targets): a word with one target redirects, one with several gets a page of choices; a word that is an entry itself stays one."""
    t = syn.join(known.select(F.col("expression").alias("word")), "word", "left_anti").groupBy("word").agg(F.sort_array(F.collect_set("expression")).alias("targets"))
    return t.select("word", F.when(F.size("targets") == 1, "redirect").otherwise("choices").alias("kind"), "targets")


def collisions(mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Targets that several sources map to."""
    return mapping.groupBy(target).agg(F.count_distinct(source).alias("n")).where("n > 1")


class Ledger(Counter):
    """How faithfully a format shows each feature: counts by (feature, fidelity, note)."""

    def note(self, feature: str, fidelity: str, note: str = "") -> None:
        self[(feature, fidelity, note)] += 1

    def rows(self) -> list[tuple[str, str, str, int]]:
        return [(*k, n) for k, n in sorted(self.items())]


_HTML = frozenset("a b br code div em i li ol p rp rt ruby small span strong sub sup table tbody td th thead tr u ul details summary".split())


def to_html(node, ledger: Ledger | None = None, link=lambda h: h) -> str:
    """A tree as HTML: known elements kept with class and language, links rewritten, others unwrapped."""

    def tag(name, node, inside):
        if name == "img":
            if ledger is not None:
                ledger.note("image", "preserved")
            return f'<img src="{html.escape(str(node.get("path", "")))}" alt="{html.escape(str(node.get("title", "")))}">'
        if name not in _HTML:
            if ledger is not None and name:
                ledger.note(name, "unwrapped")
            return inside
        if name == "br":
            return "<br>"
        attrs = ""
        s = J.selector_of(node)
        if s:
            attrs += f' class="{html.escape(s)}"'
        if isinstance(node.get("lang"), str):
            attrs += f' lang="{html.escape(node["lang"])}"'
        if name == "a":
            attrs += f' href="{html.escape(link(str(node.get("href", ""))))}"'
        if ledger is not None:
            ledger.note(name, "preserved")
        return f"<{name}{attrs}>{inside}</{name}>"

    return J.rendered(node, tag, lambda s: html.escape(s, quote=False))


_XDXF = {"b": "b", "strong": "b", "i": "i", "em": "i", "u": "u", "sub": "sub", "sup": "sup", "code": "c", "small": "small"}


def to_xdxf(node, ledger: Ledger | None = None) -> str:
    """A tree as XDXF: what the format lacks becomes text, tables as cells and lines, readings in brackets; the ledger says so."""

    def tag(name, node, inside):
        note = (lambda f, how: ledger.note(name or "text", f, how)) if ledger is not None else (lambda f, how: None)
        if name in _XDXF:
            note("preserved", "")
            return f"<{_XDXF[name]}>{inside}</{_XDXF[name]}>"
        if name == "a":
            note("preserved", "")
            return f"<kref>{inside}</kref>"
        if name == "rt":
            note("degraded", "brackets")
            return f"({inside})"
        if name in ("td", "th"):
            note("degraded", "cell")
            return inside + " | "
        if name == "li":
            note("degraded", "bullet")
            return f"• {inside}\n"
        if name in ("div", "p", "tr", "br", "details", "summary"):
            note("degraded", "line")
            return inside.removesuffix(" | ") + "\n"
        if name == "img":
            note("dropped", "image")
            return html.escape(str(node.get("title", "")), quote=False)
        if name and name not in ("span", "ruby", "ul", "ol", "table", "tbody", "thead"):
            note("degraded", "unwrapped")
        return inside

    return J.rendered(node, tag, lambda s: html.escape(s, quote=False))


def rendered(df: DataFrame, json_col: str, how: str) -> DataFrame:
    """Adds ``markup`` and ``ledger`` (rows of feature, fidelity, note, n) in ``html`` or ``xdxf``."""
    import json

    make = {"html": to_html, "xdxf": to_xdxf}[how]

    @F.pandas_udf("markup string, ledger array<struct<feature string, fidelity string, note string, n int>>")
    def render(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for b in bodies:
            ledger = Ledger()
            out.append((None if b is None else make(json.loads(b), ledger), [dict(zip(("feature", "fidelity", "note", "n"), r)) for r in ledger.rows()]))
        return pd.DataFrame(out, columns=["markup", "ledger"])

    return df.withColumn("__r", render(json_col)).select(*df.columns, F.col("__r.markup").alias("markup"), F.col("__r.ledger").alias("ledger"))


def ledger_totals(rendered_: DataFrame) -> DataFrame:
    return rendered_.select(F.explode("ledger").alias("l")).groupBy("l.feature", "l.fidelity", "l.note").agg(F.sum("l.n").alias("n"))


# -- binary records of the index-and-body format


def index_record(word: str, *numbers: int) -> bytes:
    return word.encode() + b"\0" + struct.pack(f">{len(numbers)}I", *numbers)


def parse_records(data: bytes, numbers: int) -> list[tuple[str, tuple[int, ...]]]:
    """Words and numbers of a file of index records; an error if it breaks off."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\0", at)
        if end < 0 or end + 1 + 4 * numbers > len(data):
            raise ValueError("a record breaks off")
        out.append((data[at:end].decode(), struct.unpack_from(f">{numbers}I", data, end + 1)))
        at = end + 1 + 4 * numbers
    return out


def parse_header(text: str) -> dict[str, str]:
    lines = text.splitlines()
    return dict(line.split("=", 1) for line in lines[1:] if "=" in line)


def safe(path: str) -> PurePosixPath:
    p = PurePosixPath(path)
    if not path or p.is_absolute() or ".." in p.parts or "\\" in path or any(ord(c) < 32 for c in path):
        raise ValueError(f"unsafe path {path!r}")
    return p


def deflated(data: bytes) -> tuple[int, int, bytes]:
    """Checksum, size and compressed bytes of a member, as ``archive`` would have them."""
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return zlib.crc32(data), len(data), z.compress(data) + z.flush()


def archive(path: str, members: Mapping[str, bytes]) -> None:
    """A ZIP whose bytes follow from its members alone: names sorted, one time for all."""
    archive_deflated(path, ((name, *deflated(members[name])) for name in sorted(members)))


def archive_deflated(path: str, members: Iterable[tuple[str, int, int, bytes]]) -> None:
    """The same from (name, checksum, size, compressed bytes) in order of their names, one after another."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        last = ""
        for name, crc, size, data in members:
            if name <= last:
                raise ValueError(f"{name} isn't after {last}")
            last = name
            info = zipfile.ZipInfo(str(safe(name)), EPOCH)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            info.CRC, info.file_size, info.compress_size, info.header_offset = crc, size, len(data), z.fp.tell()
            z.fp.write(info.FileHeader(zip64=False))
            z.fp.write(data)
            z.filelist.append(info)
            z.NameToInfo[info.filename] = info
            z.start_dir, z._didModify = z.fp.tell(), True


def member_issues(path: str, required: set[str]) -> list[str]:
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
    twice = [n for n, k in Counter(names).items() if k > 1]
    return [f"twice: {n}" for n in twice] + [f"missing: {n}" for n in sorted(required - set(names))]
