"""URL filters by host-suffix and path-prefix expressions with hashed lookup."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules made up by a seed beside the sixteen below, of one to five path segments.
MADE_UP, MADE_UP_SEED = 2_000, 8
#: (rule_id, expression, action, priority). An expression is a host suffix with a path prefix, as in a canonical URL without its scheme.
DEFAULT_RULES = [
    (1, "example.net/", "block", 0),
    (2, "thering.example.net/", "allow", 0),
    (3, "example.org/de/", "block", 0),
    (4, "m.tiontion.example.com/", "block", 0),
    (5, "example.com/fr/", "block", 0),
    (6, "therwh.example.com/fr/", "allow", 0),
    (7, "tionsh.example.net/es/", "allow", 0),
    (8, "blog.tionble.example.com/", "block", 0),
    (9, "example.com/en/25", "block", 0),
    (10, "www.thering.example.org/", "allow", 1),
    (11, "example.org/", "allow", -1),
    (12, "therha.example.com/en/676", "block", 2),
    (13, "ththre.example.com/fr/825?page=2&ref=x", "allow", 0),
    (14, "example.net/en/", "block", 1),
    (15, "absent.example/", "block", 5),
    (16, "thering.example.net/en/", "block", 1),
]


def _made_up() -> list[tuple[int, str, str, int]]:
    rng, out = random.Random(MADE_UP_SEED), {}
    part = lambda: "".join(rng.choice(("th", "er", "in", "on", "an", "re", "ti", "ble")) for _ in range(rng.randint(1, 3)))
    while len(out) < MADE_UP:
        host = ".".join([part() for _ in range(rng.randint(0, 2))] + [f"example.{rng.choice(('com', 'net', 'org'))}"])
        path = "/".join([rng.choice(("en", "de", "fr", "es")), *[str(rng.randrange(1000)) for _ in range(rng.randint(0, 4))]])
        expression = f"{host}/{path}" + rng.choice(("", "/", f"?page={rng.randrange(9)}"))
        # a whole language of a whole domain would leave nothing for the others to decide
        if expression.count("/") > 2 or host.count(".") > 1:
            out.setdefault(expression, (1000 + len(out), expression, rng.choice(("block", "block", "allow")), rng.choice((-1, 0, 0, 0, 1))))
    return list(out.values())


DEFAULT_RULES += _made_up()


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """Rules given as tuples, as a relation whose size the optimiser knows."""
    values = ", ".join(f"({r}L, '{e.replace(chr(39), chr(39) * 2)}', '{a}', {p})" for r, e, a, p in (DEFAULT_RULES if rules is None else rules))
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(rule_id, expression, action, priority)")


def prefix(digest: Column) -> Column:
    """The first 32 bits of a digest, as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def _authority(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.regexp_extract(rest, r"^([^/?]*)", 1), F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), F.regexp_extract(rest, r"^[^?]*(\?.*)?$", 1)


def canonical(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its mark): white space and fragment gone, user, port and outer dots off the host, dot segments resolved, slashes single."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(url), r"[\t\r\n]", ""), r"#.*$", "")
    authority, path, query = _authority(clean)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"^\.+|\.+$", ""), r"\.{2,}", ".")
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    # only paths with a dot segment pay for the fold
    kept = F.when(path.rlike(r"/\.\.(/|$)"), stack).otherwise(parts)
    last = F.when(path.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))
    clean_path = F.when(F.size(kept) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), last))
    return host, clean_path, query


def expressions(host: Column, path: Column, query: Column, labels: Column, depth: Column) -> Column:
    """All host suffixes of at most ``labels`` labels (two at least, a number-only host whole) with all path prefixes of at most ``depth`` segments, the whole path, and the path with its query."""
    names = F.split(host, r"\.")
    n = F.size(names)
    numeric = host.rlike(r"^[0-9.]+$") | (n < 2)
    longest = F.least(n, F.greatest(labels, F.lit(2)))
    suffixes = F.when(numeric, F.array(host)).otherwise(F.transform(F.sequence(F.lit(2), longest), lambda k: F.array_join(F.slice(names, -k, k), ".")))
    suffixes = F.array_union(suffixes, F.when(n <= labels, F.array(host)).otherwise(F.array().cast("array<string>")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    deep = F.least(F.size(segments), depth)
    prefixes = F.transform(F.sequence(F.lit(0), deep), lambda k: F.when(k == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))))
    # a prefix with a slash after it belongs to the URL only if the path goes on there
    inside = F.filter(prefixes, lambda p: path.startswith(p))
    paths = F.array_union(F.array_union(inside, F.array(path)), F.array(F.concat(path, query)))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, url, action (``pass`` where no rule applies) and rule_id.

    Each distinct URL is expanded into host-suffix and path-prefix expressions,
    no deeper than the deepest rule (deeper ones can't match, so nothing is
    lost). Expressions meet the rules in an equi-join on the first 32 bits of
    their SHA-256; where these agree the full digests are compared. Of the rules
    that match, the one with the highest priority wins, then the one with more
    host labels, the longer path, ``allow`` before ``block``, the lower rule_id.
    URLs and rules are brought into one form first; percent escapes stay as they
    are.

    A null or blank URL passes; a URL of any length is taken whole. Repeated
    pages are all returned, of an empty table none. Null and repeated rules are
    harmless; other columns of the inputs are ignored.
    """
    rule = rules.select(
        F.col("rule_id").cast("long").alias("rule_id"),
        F.col("expression").cast("string").alias("given"),
        F.col("action").cast("string").alias("action"),
        F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"),
    ).where("given IS NOT NULL AND action IS NOT NULL")
    rule_host, rule_path, rule_query = canonical(F.col("given"))
    rule = rule.select("rule_id", "action", "priority", rule_host.alias("host"), F.concat(rule_path, rule_query).alias("rest"), rule_path.alias("path"))
    rule = rule.select(
        F.unhex(F.sha2(F.concat("host", "rest"), 256)).alias("digest"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).alias("depth"),
        F.struct(
            (-F.col("priority")).alias("p"), (-F.size(F.split("host", r"\."))).alias("l"), (-F.length("rest")).alias("n"), F.when(F.col("action") == "allow", 0).otherwise(1).alias("b"), F.col("rule_id").alias("r"), F.col("action").alias("a")
        ).alias("rank"),
    )
    bounds = rule.agg(F.coalesce(F.max("labels"), F.lit(2)).alias("max_labels"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    # of the rules with one expression the first in precedence counts; those that share a prefix stand in one row
    listed = rule.groupBy("digest").agg(F.min("rank").alias("rank")).groupBy(prefix(F.col("digest")).alias("short")).agg(F.collect_list(F.struct("digest", "rank")).alias("rules"))
    page = pages.select(pages[id_col].alias(id_col), pages[url_col].cast("string").alias(url_col))
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of partitions that isn't lowered afterwards, as the expansion is the work
    urls = page.select(F.col(url_col).alias("u")).where("u IS NOT NULL AND trim(u) != ''").repartition(spread, "u").distinct()
    host, path, query = canonical(F.col("u"))
    urls = urls.select("u", host.alias("h"), path.alias("p"), query.alias("q")).where("h != ''").crossJoin(bounds)
    expanded = urls.select("u", F.explode(expressions(F.col("h"), F.col("p"), F.col("q"), F.col("max_labels"), F.col("max_depth"))).alias("e"))
    hashed = expanded.select("u", F.unhex(F.sha2("e", 256)).alias("d")).withColumn("short", prefix(F.col("d")))
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("d"))
    winners = hashed.join(listed, "short").select("u", F.explode(confirmed).alias("m")).groupBy("u").agg(F.min("m.rank").alias("w"))
    return page.join(winners, page[url_col] == winners["u"], "left").select(page[id_col], page[url_col], F.coalesce("w.a", F.lit("pass")).alias("action"), F.col("w.r").alias("rule_id"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


_VALUES = ", ".join(f"({r}, '{e}', '{a}', {p})" for r, e, a, p in DEFAULT_RULES)
OP1_SQL = rf"""
WITH rules(rule_id, expression, action, priority) AS (VALUES {_VALUES}),
r AS (SELECT *, len(string_split(split_part(expression, '/', 1), '.')) AS labels,
             length(expression) - length(split_part(expression, '/', 1)) AS path_length FROM rules),
u AS (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM pages WHERE url IS NOT NULL),
v AS (SELECT url, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1) AS path0, regexp_extract(rest, '^[^?]*(\?.*)?$', 1) AS query FROM u),
w AS (SELECT url, host, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path, query FROM v),
m AS (
  SELECT w.url, r.* FROM w JOIN r
  ON (w.host = split_part(expression, '/', 1) OR ends_with(w.host, '.' || split_part(expression, '/', 1)))
  AND (substr(expression, instr(expression, '/')) = w.path || w.query OR substr(expression, instr(expression, '/')) = w.path
       OR (ends_with(expression, '/') AND starts_with(w.path, substr(expression, instr(expression, '/')))))
),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, labels DESC, path_length DESC, CASE WHEN action = 'allow' THEN 0 ELSE 1 END, rule_id) = 1)
SELECT p.page_id, p.url, coalesce(b.action, 'pass') AS action, CAST(b.rule_id AS BIGINT) AS rule_id FROM pages p LEFT JOIN best b ON p.url = b.url
"""
