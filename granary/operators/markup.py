"""Trees as strict HTML for three dictionary formats, and as HTML for side-by-side pages. Of the strict ones: unknown elements, images that aren't there and characters that XML forbids are errors, and a ledger says how each feature came through."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import parse_qs, quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .export import Ledger

ELEMENTS = frozenset("a br details div img li ol rp rt ruby span summary table tbody td tfoot th thead tr ul".split())
_FORBIDDEN = re.compile(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_NAME = re.compile(r"[A-Za-z0-9_-]+")


class Unsupported(ValueError):
    """A tree has what the format can't show."""


@dataclass(frozen=True)
class Dialect:
    """What sets a format apart."""

    #: Before the quoted term of a link to another entry, and the ledger's word for it.
    entry_link: str
    link_note: str
    images: str
    image_note: str
    line_break: str
    #: Ends an element without content.
    close: str
    #: Other data keys become attributes, or else classes.
    data_attributes: bool
    data_note: str
    style_note: str
    no_style_note: str
    #: Bold and italic have classes.
    font_classes: bool
    #: title, lang and spans are attributes of every element, or else title of all but links.
    all_attributes: bool
    #: Readings keep their elements outside of ruby too.
    free_readings: bool


MDICT = Dialect("entry://", "entry URI", "media/", "MDD resource with alt text", "<br>", "/>", True, "HTML data attribute", "CSS class", "portable MDict CSS profile has no mapping", True, True, True)
APPLE = Dialect("x-dictionary:d:", "x-dictionary definition URI", "Images/", "bundle resource with alt text", "<br/>", "/>", False, "stable CSS class", "stable CSS class", "schema-safe CSS profile has no mapping", False, False, False)
DIALECTS = {"mdict": MDICT, "apple": APPLE}


def _of(node: dict, key: str, kind: type):
    """A value of a kind; the kind's empty value where there is none."""
    got = node.get(key)
    return got if type(got) is kind else kind()


def _walk(node, element, text, strange) -> str:
    """What all formats do alike: nothing for nothing, a list's parts together, a wrapper's content, and ``element`` for the rest."""
    match node:
        case None:
            return ""
        case [*parts]:
            return "".join([_walk(x, element, text, strange) for x in parts])
        case {"type": "structured-content", **rest}:
            return _walk(rest.get("content"), element, text, strange)
        case dict():
            return element(node)
        case bool():
            return strange(node)
        case str() | int() | float():
            return text(node)
    return strange(node)


def _refuse(node) -> str:
    raise Unsupported(type(node).__name__)


def entry_term(href: str) -> str:
    """The term that a link of the source names, if it isn't one to elsewhere."""
    at = urlsplit(href)
    terms = {} if at.scheme or at.netloc else parse_qs(at.query)
    return terms.get("query", [""])[0]


def name_part(value) -> str:
    """A text as part of a class or attribute name; empty if nothing is left of it."""
    return "-".join(_NAME.findall(value)).strip("-") if type(value) is str else ""


def _common(node: dict) -> list[tuple[str, object]]:
    """title and lang, and how many columns and rows a cell takes."""
    said = [(key, node[key]) for key in ("title", "lang") if type(node.get(key)) is str]
    return said + [(key.lower(), n) for key in ("colSpan", "rowSpan") if (n := _of(node, key, int)) > 0]


def escaped(value) -> str:
    text = str(value)
    if bad := _FORBIDDEN.search(text):
        raise Unsupported(f"XML has no U+{ord(bad.group()):04X}")
    return html.escape(text, quote=True)


def _plain(value) -> bool:
    return type(value) in (str, int, float)


class Writer:
    def __init__(self, dialect: Dialect, images: Mapping[str, str], alt: str, ledger: Ledger):
        self.dialect, self.images, self.alt, self.ledger = dialect, images, alt, ledger

    def attributes(self, node: dict, first: tuple[str, ...] = ()) -> str:
        d, note = self.dialect, self.ledger.note
        classes, other = [c for c in first if c], []
        data = _of(node, "data", dict)
        classes += [f"{mark}-{c}" for mark, key in (("dc", "class"), ("sc", "content")) if (c := name_part(data.get(key)))]
        for key in sorted(data):
            part = name_part(key)
            if d.data_attributes:
                if part and _plain(data[key]):
                    other.append((f"data-sc-{part}", data[key]))
                    note("semantic-data:" + key, "exact", d.data_note)
            else:
                if part and (v := name_part(data[key])) and key not in ("class", "content"):
                    classes.append(f"meta-{part}-{v}")
                note("semantic-data:" + key, "lossless-transform", d.data_note)
        for key, value in sorted(_of(node, "style", dict).items()):
            made = self.style_class(key, value)
            classes += [made] if made else []
            note(f"style:{key}", *(("lossless-transform", d.style_note) if made else ("degraded", d.no_style_note)))
        named = " ".join(dict.fromkeys(classes))
        out = [("class", named)] if named else []
        if not d.all_attributes:
            return self.joined(out)
        return self.joined([*other, *out, *_common(node)])

    def style_class(self, key: str, value) -> str | None:
        if key == "listStyleType" and (v := name_part(str(value))):
            return f"style-list-{v}"
        if self.dialect.font_classes and key == "fontWeight" and value in ("bold", 600, 700, 800, 900):
            return "style-font-bold"
        if self.dialect.font_classes and key == "fontStyle" and value == "italic":
            return "style-font-italic"
        return None

    @staticmethod
    def joined(pairs) -> str:
        return "".join(f' {k}="{escaped(v)}"' for k, v in pairs)

    def write(self, node, in_ruby: bool = False) -> str:
        return _walk(node, lambda x: self.element(x, in_ruby), escaped, _refuse)

    def element(self, node: dict, in_ruby: bool) -> str:
        note, tag, inside = self.ledger.note, node.get("tag"), node.get("content")
        match tag:
            case "br":
                note("tag:br", "exact")
                return self.dialect.line_break
            case "details" | "summary":
                if tag == "details":
                    note("details", "lossless-transform", "expanded block")
                box = {"details": "div", "summary": "span"}[tag]
                return f'<{box} class="jr-{tag}">{self.write(inside)}</{box}>'
            case "a":
                return self.link(node)
            case "img":
                return self.image(node)
            case "ruby" if not self.dialect.free_readings:
                note("ruby", "exact")
                return f"<ruby>{self.write(inside, True)}</ruby>"
            case "rt" | "rp" if not self.dialect.free_readings:
                return f"<rt>{self.write(inside)}</rt>" if tag == "rt" and in_ruby else self.write(inside)
        if tag not in ELEMENTS:
            raise Unsupported(f"element {tag!r}")
        head = tag + self.attributes(node)
        if not self.dialect.all_attributes:
            head += self.joined(_common(node)[:1]) if type(node.get("title")) is str else ""
        note("tag:" + tag, "exact")
        return f"<{head}>{self.write(inside)}</{tag}>"

    def link(self, node: dict) -> str:
        note, attributes, body, href = self.ledger.note, self.attributes(node), self.write(node.get("content")), node.get("href")
        if type(href) is not str:
            note("link:missing", "degraded", "visible text retained")
            return body
        if term := entry_term(href):
            note("link:internal", "lossless-transform", self.dialect.link_note)
            to, shown = self.dialect.entry_link + quote(term, safe=""), term
        elif href.lower().startswith(("http://", "https://")):
            note("link:external", "exact")
            to, shown = escaped(href), href
        else:
            note("link:other", "degraded", "visible text retained")
            return body or escaped(href)
        return f'<a href="{to}"{attributes}>{body or escaped(shown)}</a>'

    def image(self, node: dict) -> str:
        d, note, path = self.dialect, self.ledger.note, _of(node, "path", str)
        if path not in self.images:
            raise Unsupported(f"image {path!r}")
        alt = next((x for x in (node.get("alt"), node.get("title")) if x), self.alt)
        look = name_part(node.get("appearance"))
        attributes = self.attributes(node, ("gloss-image", look and f"image-{look}", _of(node, "background", bool) and "image-background"))
        units, sizes = node.get("sizeUnits"), []
        for key in ("width", "height"):
            if isinstance(node.get(key), (int, float)) and node[key] > 0:
                sizes.append((key, f"{node[key]:g}"))
                note(f"image:{key}", "lossless-transform")
        for key, how in (("appearance", "class or dimension unit"), ("background", "class or dimension unit"), ("sizeUnits", "class or dimension unit"), ("collapsible", "image emitted expanded"), ("collapsed", "image emitted expanded")):
            if key in node:
                note(f"image:{key}", "lossless-transform", how)
        note("image", "lossless-transform", d.image_note)
        as_style = d.all_attributes or units == "em"
        unit = units if units in ("px", "em") else "px"
        sized = self.joined([("style", ";".join(f"{k}:{v}{unit}" for k, v in sizes))] if sizes and as_style else sizes)
        title = "" if d.all_attributes or type(node.get("title")) is not str else self.joined([("title", node["title"])])
        head = f'<img src="{d.images}{escaped(self.images[path])}" alt="{escaped(alt if isinstance(alt, str) else self.alt)}"'
        return head + (attributes + sized if d.all_attributes else sized + attributes + title) + d.close


#: Data keys and style names that the index-and-body format's HTML has; others are left out.
_DATA = ("class", "content", "code", "sentence-key", "source", "source-type")
_STYLES = ("fontStyle", "fontWeight", "fontSize", "textDecorationLine", "verticalAlign", "textAlign", "marginTop", "marginRight", "marginBottom", "marginLeft", "listStyleType")
#: Elements of side-by-side pages; others give way to their content.
_PAGE = ELEMENTS - {"details", "summary", "img", "rp", "tfoot"}


def kebab(name: str) -> str:
    """camelCase in lower case with hyphens."""
    return name[:1].lower() + "".join(f"-{c.lower()}" if c.isupper() else c for c in name[1:])


def _tagged(tag: str, pairs) -> str:
    return tag + "".join(f' {k}="{html.escape(str(v), quote=True)}"' for k, v in pairs)


def index_html(node, images: Mapping[str, str] | None = None, alt: str = "image") -> str:
    """A tree in the HTML of the index-and-body format: known styles inline, known data as attributes, images in a box that folds as they do."""
    images = images or {}

    def element(node: dict) -> str:
        tag, data, style = node.get("tag"), _of(node, "data", dict), _of(node, "style", dict)
        if tag not in ELEMENTS:
            raise Unsupported(f"element {tag!r}")
        classes = [name_part(data.get("class")), "sc-" + name_part(data.get("content"))]
        pairs = [(f"data-sc-{k}", data[k]) for k in _DATA if _plain(data.get(k))]
        if tag == "img":
            classes += ["gloss-image", "image-" + name_part(node.get("appearance")), "image-background" * _of(node, "background", bool)]
            settings = [(kebab(k), node.get(k)) for k in ("appearance", "collapsible", "collapsed", "background", "sizeUnits")]
            pairs += [(f"data-sc-{k}", {True: "true", False: "false"}.get(v, v) if type(v) is bool else v) for k, v in settings if type(v) in (bool, str)]
        named = " ".join(c for c in classes if c not in ("", "sc-", "image-"))
        pairs += [("class", named)] * bool(named) + _common(node)
        declared = [f"{kebab(k)}:{style[k]}" for k in _STYLES if isinstance(style.get(k), (str, int, float))]
        if (unit := node.get("sizeUnits")) in ("px", "em"):
            declared += [f"{k}:{node[k]:g}{unit}" for k in ("width", "height") if isinstance(node.get(k), (int, float))]
        pairs += [("style", ";".join(declared))] * bool(declared)
        if tag == "a" and type(href := node.get("href")) is str:
            term = entry_term(href)
            pairs.append(("href", "bword://" + quote(term, safe="") if term else href))
        if tag == "br":
            return f"<{_tagged(tag, pairs)}>"
        if tag != "img":
            return f"<{_tagged(tag, pairs)}>{index_html(node.get('content'), images, alt)}</{tag}>"
        path, label = _of(node, "path", str), next((node[k] for k in ("alt", "title") if type(node.get(k)) is str), "")
        if not path:
            raise Unsupported("an image without a path")
        image = f"<{_tagged(tag, [*pairs, ('src', images.get(path, path)), ('alt', label)])}>"
        box = [("class", "gloss-image-container")]
        if not _of(node, "collapsible", bool):
            return f"<{_tagged('span', box)}>{image}</span>"
        return f"<{_tagged('details', box)}{'' if _of(node, 'collapsed', bool) else ' open'}><summary>{html.escape(label or alt)}</summary>{image}</details>"

    return _walk(node, element, lambda x: html.escape(str(x)), _refuse)


def page_html(node) -> str:
    """A tree in the HTML of side-by-side pages: all styles and data kept, links open elsewhere, elements that a page doesn't have give way to their content; nothing is an error."""

    def element(node: dict) -> str:
        tag, style, inside = node.get("tag"), node.get("style"), node.get("content")
        if tag not in _PAGE:
            return page_html(inside)
        said = {k: node.get(k) for k in ("href", "lang", "title")}
        said["style"] = ";".join(f"{kebab(str(k))}:{v}" for k, v in style.items()) if type(style) is dict else style
        said |= {k.lower(): node.get(k) for k in ("colSpan", "rowSpan")}
        said |= {"data-sc-" + str(k).replace("_", "-").lower(): v for k, v in _of(node, "data", dict).items()}
        said |= {"target": "_blank", "rel": "noreferrer"} if tag == "a" else {}
        head = _tagged(tag, [(k, v) for k, v in said.items() if v is not None])
        return f"<{head}>" if tag == "br" else f"<{head}>{page_html(inside)}</{tag}>"

    def text(x) -> str:
        return html.escape(str(x))

    return _walk(node, element, text, text)


def strict(node, how: str, images: Mapping[str, str] | None = None, alt: str = "image", ledger: Ledger | None = None) -> str:
    """A tree in one of DIALECTS, as ``index`` HTML or as ``page`` HTML, of which the last two keep no ledger; images by their path in the source."""
    if how in ("index", "page"):
        return index_html(node, images, alt) if how == "index" else page_html(node)
    return Writer(DIALECTS[how], images or {}, alt, Ledger() if ledger is None else ledger).write(node)


_LEDGER = {"feature": pa.string(), "fidelity": pa.string(), "note": pa.string(), "n": pa.int32()}


def strictly_rendered(df: DataFrame, json_col: str, how: str, images: Mapping[str, str] | None = None, alt: str = "image") -> DataFrame:
    """Adds ``markup`` and ``ledger`` (rows of feature, fidelity, note, n); a null tree has neither markup nor rows."""
    images = dict(images or {})

    @F.arrow_udf("markup string, ledger array<struct<feature string, fidelity string, note string, n int>>")
    def run(bodies: pa.Array) -> pa.Array:
        made, ledgers = [], []
        for b in bodies.to_pylist():
            ledger = Ledger()
            made.append(None if b is None else strict(json.loads(b), how, images, alt, ledger))
            ledgers.append(ledger.rows())
        rows = [r for x in ledgers for r in x]
        entries = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_LEDGER.values())], list(_LEDGER))
        ends = pa.array(accumulate(map(len, ledgers), initial=0), pa.int32())
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.ListArray.from_arrays(ends, entries)], ["markup", "ledger"])

    return df.withColumn("__r", run(json_col)).select(*df.columns, F.col("__r.markup").alias("markup"), F.col("__r.ledger").alias("ledger"))


def link_records(redirects: DataFrame, style: str = "style.css") -> DataFrame:
    """(key, body) of the words that aren't entries: a link where a word has one target, else a page of links in order. ``redirects`` has word, kind and targets."""

    def entry(t: Column) -> Column:
        return F.concat(F.lit('<li><a href="entry://'), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")), F.lit('">'), F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</a></li>"))

    page = F.concat(F.lit(f'<link rel="stylesheet" type="text/css" href="{style}"><ul>'), F.array_join(F.transform("targets", entry), ""), F.lit("</ul>"))
    bad = F.col("word").rlike(r"[\x00\r\n]") | (F.col("word") == "")
    key = F.when(bad, F.raise_error(F.lit("a key is empty or has a line break or a NUL"))).otherwise(F.col("word"))
    return redirects.select(key.alias("key"), F.when(F.col("kind") == "redirect", F.concat(F.lit("@@@LINK="), F.col("targets")[0])).otherwise(page).alias("body"))
