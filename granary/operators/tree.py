"""The node table: trees flattened once, then filtered and grouped as any table."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsontree as J

_NODE = [
    ("node_no", T.IntegerType()),
    ("parent_no", T.IntegerType()),
    ("depth", T.IntegerType()),
    ("pointer", T.StringType()),
    ("key", T.StringType()),
    ("kind", T.StringType()),
    ("text", T.StringType()),
    ("tag", T.StringType()),
    ("selectors", T.ArrayType(T.StringType())),
    ("selector", T.StringType()),
    ("lang", T.StringType()),
    ("data", T.MapType(T.StringType(), T.StringType())),
]


_ARROW = {
    T.IntegerType(): pa.int32(),
    T.StringType(): pa.string(),
    T.ArrayType(T.StringType()): pa.list_(pa.string()),
    T.MapType(T.StringType(), T.StringType()): pa.map_(pa.string(), pa.string()),
}


def _exploded(df: DataFrame, id_col: str, body: str, fields: list, make) -> DataFrame:
    picked = df.select(id_col, F.col(body).alias("body")).where("body IS NOT NULL")
    schema = T.StructType([picked.schema[0], *[T.StructField(n, t) for n, t in fields]])
    kinds = [_ARROW[t] for _, t in fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [list(make(b)) for b in part.column(1).to_pylist()]
                owner = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int32())
                columns = list(zip(*[r for rows in made for r in rows])) or [()] * len(kinds)
                yield pa.record_batch([part.column(0).take(owner), *map(pa.array, columns, kinds)], names=schema.names)

    return picked.mapInArrow(run, schema)


def node_table(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """All nodes of each JSON text, one parse per text. Texts that aren't JSON are an error; nulls have no nodes."""

    def make(body):
        for *place, selectors, lang, data in J.walked(json.loads(body)):
            yield *place, selectors, selectors[-1] if selectors else None, lang, list(data.items())

    return _exploded(df, id_col, json_col, _NODE, make)


def unit_table(df: DataFrame, id_col: str, json_col: str, glossary_sets: bool = False) -> DataFrame:
    """(id, pointer, role, text, digest, byte_count) of the translatable leaves."""
    fields = [("ordinal", T.IntegerType()), ("pointer", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
    u = _exploded(df, id_col, json_col, fields, lambda b: ((n, x.pointer, x.role, x.text) for n, x in enumerate(J.units(json.loads(b), "", glossary_sets))))
    return u.withColumns({"digest": F.sha2("text", 256), "byte_count": F.octet_length("text")})


def leaves(nodes: DataFrame, id_col: str) -> DataFrame:
    """Visible leaves with the selector and language that they inherit."""
    return nodes.where((F.col("kind") == "string") & (F.col("key").isNull() | F.col("key").isin("content", "title"))).select(id_col, "pointer", "selector", "lang", F.col("text"))


def features(nodes: DataFrame) -> DataFrame:
    """(kind, name, n): how often each tag, selector, data key and setting occurs. The nodes are gone through once."""

    def pair(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    own = F.array(pair("tag", F.col("tag")), pair("selector", F.when(F.col("kind") == "object", F.col("selector"))), pair("kind", F.col("kind")))
    data = F.transform(F.coalesce(F.map_keys("data"), F.array().cast("array<string>")), lambda k: pair("data", k))
    return nodes.select(F.inline(F.concat(own, data))).where("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


class _Elements(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.rows.append([len(self.rows), self.stack[-1] if self.stack else None, len(self.stack), tag, a.get("class"), a.get("href") or a.get("src"), ""])
        if tag not in self.VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[k]][3] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        if self.stack:
            self.rows[self.stack[-1]][6] += data


def html_elements(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, node_no, parent_no, depth, tag, class, link, text): the elements of each page in order, with the text directly in them."""
    fields = [("node_no", T.IntegerType()), ("parent_no", T.IntegerType()), ("depth", T.IntegerType()), *[(n, T.StringType()) for n in ("tag", "class", "link", "text")]]

    def make(body):
        p = _Elements()
        p.feed(body)
        p.close()
        return p.rows

    return _exploded(df, id_col, html_col, fields, make)



def html_is_sound(markup: str) -> bool:
    """Whether every element that is opened is closed, innermost first."""

    class Check(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open: list[str] = []
            self.sound = True

        def handle_starttag(self, tag, attrs):
            if tag not in _Elements.VOID:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if not self.open or self.open.pop() != tag:
                self.sound = False

    c = Check()
    c.feed(markup)
    c.close()
    return c.sound and not c.open


def applied(articles: DataFrame, targets: DataFrame, id_col: str, json_col: str, lang: str) -> DataFrame:
    """(id, body): each tree with its translations put in. ``targets`` has the id, ``pointer`` and ``target``, the JSON of the new value. Articles without a target stay as they are."""
    grouped = targets.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pointer", "target"))).alias("__t"))
    joined = articles.select(id_col, json_col).join(grouped, id_col, "left")

    @F.pandas_udf("string")
    def rewrite(bodies: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([b if m is None else J.canonical(J.translated(json.loads(b), {p: json.loads(t) for p, t in (m.items() if isinstance(m, dict) else m)}, lang)) for b, m in zip(bodies, maps)])

    return joined.select(id_col, rewrite(json_col, "__t").alias("body"))
