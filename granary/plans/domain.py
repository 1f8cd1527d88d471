"""Text rules, packing, increments, integrity, trees, exports and event logs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.digest import history_digest, parity, table_digest
from ..operators import export, incremental, integrity, markup, packing, sampling, tree, validate
from ..operators import relational as R
from ..streaming import events as E
from .registry import Tables, query


@query("""
WITH a AS (SELECT doc_id, lang, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, sha256(text) AS digest, min(doc_id) AS source_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1, 2)
SELECT doc_id, source_id FROM a JOIN b USING (lang, digest)
""")
def reuse_by_content_key(t: Tables) -> DataFrame:
    """Documents of one run whose content another run has."""
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("digest"))
    old = d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "source_id")
    return incremental.reusable(d.where("doc_id % 2 = 0"), old, ["lang", "digest"], "doc_id", "source_id", [F.col("source_id")])


@query("""
SELECT 'u-r2-' || CAST(doc_id AS VARCHAR) AS unit, doc_id, doc_id % 3 = 0 AS copied FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0
""")
def incremental_union(t: Tables) -> DataFrame:
    """A run that grows: old units copied under new keys, only new articles extracted."""
    old = t.documents.where("doc_id % 3 = 0").select(F.concat(F.lit("u-r1-"), F.col("doc_id").cast("string")).alias("unit"), "doc_id", F.lit(True).alias("copied"))
    wanted = t.documents.where("doc_id % 3 = 0 OR doc_id % 5 = 0").select("doc_id")
    extract = lambda new: new.select(F.concat(F.lit("u-r2-"), F.col("doc_id").cast("string")).alias("unit"), "doc_id", F.lit(False).alias("copied"))
    return incremental.extended_run(old, wanted, extract, "doc_id", "unit", "u-r1-", "u-r2-")


@query("""
WITH tag AS (SELECT doc_id, 'tag-' || lang AS v FROM documents WHERE doc_id % 4 = 0), man AS (SELECT doc_id, source AS v FROM documents WHERE doc_id % 6 = 0)
SELECT d.doc_id, d.source AS previous, coalesce(tag.v, man.v) AS value, CASE WHEN tag.v IS NOT NULL THEN 'tag' ELSE 'manifest' END AS origin FROM documents d LEFT JOIN tag USING (doc_id) LEFT JOIN man USING (doc_id)
WHERE coalesce(tag.v, man.v) IS DISTINCT FROM d.source AND coalesce(tag.v, man.v) IS NOT NULL
""")
def canonical_values(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("source").alias("value"))
    tag = t.documents.where("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("tag-"), F.col("lang")).alias("value"))
    return incremental.canonicalised(d, "doc_id", "value", [("tag", tag), ("manifest", d.where("doc_id % 6 = 0"))])


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 10 = 0
""")
def upserted_rows(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return R.upserted(o, o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 OR c_nationkey < 5")
def append_if_absent(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    old, new = c.where("c_acctbal > 0"), c.where("c_nationkey < 5")
    return R.appended(old, new.union(new), ["c_custkey"]).select("c_custkey", "c_mktsegment")


_RULES = r"""
CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '<[A-Za-z/][^>]*>|\[[^\]]*\]\([^)]*\)|```') THEN 'markup' END,
CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'control_character' END,
CASE WHEN NOT regexp_matches(text, '[à-ÿ]') AND trim(text) <> '' THEN 'no_script' END,
CASE WHEN len(regexp_extract_all(text, '\b[A-Za-z]{2,}\b')) > 2 THEN 'foreign_words' END
"""


@query(f"SELECT doc_id, unnest(list_filter([{_RULES}], lambda x: x IS NOT NULL)) AS issue FROM documents WHERE regexp_matches(text, '^[ -~]*$')")
def text_rule_issues(t: Tables) -> DataFrame:
    """The rule set bound to accented Latin as the script wanted, over plain ASCII documents."""
    none = F.array().cast("array<string>")
    d = t.documents.where(F.col("text").rlike("^[ -~]*$"))
    return d.select("doc_id", F.explode(validate.plain_text_issues(F.col("text"), none, script="[à-ÿ]")).alias("issue"))


@query(r"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'MUST_PRESERVE' WHEN lang = 'ja' THEN 'MUST_PRESERVE' WHEN NOT regexp_matches(text, '\p{L}') THEN 'MUST_PRESERVE' WHEN regexp_matches(text, '^https?://\S+$') THEN 'MUST_PRESERVE'
WHEN source IN ('glossary', 'sense-note', 'info-gloss') THEN 'MUST_TRANSLATE' WHEN regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '\p{Cyrillic}') THEN 'REVIEW' WHEN regexp_matches(text, '[A-Za-z]{3,}') THEN 'MUST_TRANSLATE' ELSE 'REVIEW' END AS class FROM documents
""")
def classify_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", validate.leaf_class(F.col("text"), F.col("source"), F.col("lang")).alias("class"))


@query("SELECT lang, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-Z]{3,}'))))), ' ') AS tokens FROM documents WHERE regexp_matches(text, '[A-Z]{3,}') GROUP BY 1")
def token_array_merge(t: Tables) -> DataFrame:
    """Acronyms of each language, merged."""
    return t.documents.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{3,}"), 0)).alias("x")).groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("x")), " ").alias("tokens"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, ' ')[1:8] AS a, string_split(text, ' ')[5:14] AS b FROM documents WHERE doc_id % 5 = 0), c AS (SELECT doc_id, len(a) AS n, list_concat(a, b) AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS merged, len(list_filter(l, lambda x, i: list_position(l, x) = i)) - len(list_distinct(l[1:n])) AS added FROM c
""")
def ordered_token_merge(t: Tables) -> DataFrame:
    """Two token arrays merged in order: the first's tokens as they come, then what the second has besides, each once."""
    w = F.split("text", " ")
    a, b = F.slice(w, 1, 8), F.slice(w, 5, 10)
    return t.documents.where("doc_id % 5 = 0").select("doc_id", F.array_join(F.array_union(a, b), " ").alias("merged"), (F.size(F.array_union(a, b)) - F.size(F.array_distinct(a))).cast("long").alias("added"))


_AUDIT = "x[CAST(least(n, ceil({} * n)) AS INTEGER)]"


@query(f"""
WITH r AS (SELECT lang AS run, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS v FROM documents), l AS (SELECT run, list_sort(list(v)) AS x, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY 1)
SELECT run, n AS requests, x[1] AS least, {_AUDIT.format(0.5)} AS middle, {_AUDIT.format(0.95)} AS p95, {_AUDIT.format(0.99)} AS p99, x[n] AS most, total, 1050000 / x[n] AS headroom, 1050000 / x[n] >= 4 AS passed FROM l
""")
def token_audit(t: Tables) -> DataFrame:
    """Input tokens of each run's requests, and whether the largest fits the window four times."""
    return integrity.token_audit(t.documents.select(F.col("lang").alias("run"), F.ceil(F.octet_length("text") / 4.0).alias("v")), "run", "v", 1_050_000, 4)


@query(r"""
SELECT doc_id, array_to_string(regexp_extract_all(text, 'https?://[^\s)\]>"'']+'), ' ') AS links, len(regexp_extract_all(text, '\d+(?:[.,:/-]\d+)*')) AS numbers FROM documents WHERE doc_id % 7 = 0
""")
def protected_parts(t: Tables) -> DataFrame:
    d = t.documents.where("doc_id % 7 = 0")
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(X.PROTECTED[0]), 0), " ").alias("links"), F.size(F.regexp_extract_all("text", F.lit(X.PROTECTED[3]), 0)).alias("numbers"))


@query("""
SELECT * FROM (VALUES ('カタカナ', 'かたかな', true), ('ひらがな', 'ひらがな', true), ('漢字', '漢字', false), ('ﾊﾝｶｸ', 'はんかく', false), ('ア・イ', 'あ|い', true)) AS v(probe, variants, kana)
""")
def kana_fold(t: Tables) -> DataFrame:
    probes = t.spark.sql("SELECT * FROM VALUES ('カタカナ'), ('ひらがな'), ('漢字'), ('ﾊﾝｶｸ'), ('ア・イ') AS v(probe)")
    return probes.select("probe", F.array_join(X.reading_variants("probe"), "|").alias("variants"), X.kana_only("probe").alias("kana"))


@query("SELECT p_partkey, 'e-' || substr(sha256(p_name), 1, 24) AS identity, CASE WHEN p_size * 500 % 1000 = 0 THEN CAST(p_size * 500 // 1000 AS VARCHAR) || 'k' ELSE CAST(p_size * 500 AS VARCHAR) END AS label FROM part")
def entry_identities(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.entry_identity("p_name").alias("identity"), X.rank_label(F.col("p_size").cast("long") * 500).alias("label"))


@query("""
SELECT page_id, CASE WHEN url = '' THEN 'empty' WHEN starts_with(url, '?') THEN 'internal' WHEN starts_with(url, '#') THEN 'anchor' WHEN regexp_matches(url, '^https?://') THEN 'external' WHEN regexp_matches(url, '^[a-z][a-z0-9+.-]*:') THEN 'scheme' ELSE 'relative' END AS kind,
replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages
""")
def link_kinds(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.link_kind("url").alias("kind"), X.escaped("url").alias("escaped"))


_HEX = "CAST('0x' || substr(h, {} , 8) AS BIGINT)"


def _digest_sql(table: str, columns: tuple[str, ...]) -> str:
    """(n, total, mixed) of a table, a row's text being each value with its length before it."""
    text = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"""WITH r AS (SELECT sha256({text}) AS h FROM {table}),
s AS (SELECT count(*) AS n, {", ".join(f"CAST(sum({_HEX.format(8 * k + 1)}) AS HUGEINT) AS s{k}, bit_xor({_HEX.format(8 * k + 1)}) AS m{k}" for k in range(8))} FROM r),
c AS (SELECT *, 0::HUGEINT AS c8, {", ".join(f"(s{k} + c{k + 1}) // 4294967296 AS c{k}" for k in range(7, -1, -1))} FROM s)
SELECT n, {" || ".join(f"printf('%08x', CAST((s{k} + c{k + 1}) % 4294967296 AS BIGINT))" for k in range(8))} AS total, {" || ".join(f"printf('%08x', m{k})" for k in range(8))} AS mixed FROM c"""


_NATION, _REGION, _LABELS = ("n_nationkey", "n_name", "n_regionkey"), ("r_regionkey", "r_name"), ("doc_id", "quality", "toxic")


@query(f"""
WITH RECURSIVE d AS (SELECT 0 AS place, 'region' AS name, * FROM ({_digest_sql("region", _REGION)}) UNION ALL SELECT 1, 'nation', * FROM ({_digest_sql("nation", _NATION)}) UNION ALL SELECT 2, 'labels', * FROM ({_digest_sql("labels", _LABELS)})),
f AS (SELECT 0 AS place, sha256('region:' || n || ':' || total || ':' || mixed) AS upto FROM d WHERE place = 0 UNION ALL SELECT d.place, sha256(f.upto || name || ':' || n || ':' || total || ':' || mixed) FROM f JOIN d ON d.place = f.place + 1)
SELECT d.*, f.upto FROM d JOIN f USING (place)
""")
def history_fingerprint(t: Tables) -> DataFrame:
    """Three tables in order, each with its digest and that of all up to it."""
    return history_digest({"region": t.region.select(*_REGION), "nation": t.nation.select(*_NATION), "labels": t.labels.select(*_LABELS)})


@query("""
WITH a AS (SELECT doc_id, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id = (SELECT max(doc_id) FROM labels) THEN 1 - toxic ELSE toxic END AS toxic FROM labels)
SELECT 'labels' AS name, (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, CASE WHEN EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b) OR EXISTS (SELECT * FROM b EXCEPT ALL SELECT * FROM a) THEN 'different' ELSE 'same' END AS state
UNION ALL SELECT 'nation', count(*), count(*), 'same' FROM nation UNION ALL SELECT 'region', count(*), NULL, 'missing' FROM region UNION ALL SELECT 'supplier', NULL, count(*), 'extra' FROM supplier
""")
def parity_report(t: Tables) -> DataFrame:
    """Two copies of four tables: one with a changed row, one in another order, one on either side alone."""
    last = t.labels.agg(F.max("doc_id").alias("last"))
    changed = t.labels.crossJoin(last).select("doc_id", F.when(F.col("doc_id") == F.col("last"), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int").alias("toxic"))
    left = {"labels": t.labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "nation": t.nation.select(*_NATION), "region": t.region.select(*_REGION)}
    return parity(left, {"labels": changed, "nation": t.nation.select(*_NATION).orderBy(F.desc("n_name")), "supplier": t.supplier.select("s_suppkey", "s_name")})


@query(_digest_sql("nation", _NATION))
def digest_of_table(t: Tables) -> DataFrame:
    return table_digest(t.nation)


@query("SELECT user_id, count(*) FILTER (value > 10) AS submitted, count(*) FILTER (event_type = 'purchase' AND value > 10) AS completed FROM events GROUP BY 1 HAVING count(*) > 3")
def events_by_user(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 10).alias("submitted"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("completed"), F.count("*").alias("n"))
    return g.where("n > 3").drop("n")


@query("""
WITH e AS (SELECT epoch(ts) AS t, event_type, value FROM events), b AS (SELECT min(t) + (max(t) - min(t)) * 0.25 AS t0, min(t) + (max(t) - min(t)) * 0.75 AS t1 FROM e),
p AS (SELECT e.*, CASE WHEN t < t0 THEN 'before' WHEN t <= t1 THEN 'window' ELSE 'drain' END AS place FROM e, b),
d AS (SELECT list_sort(list(value)) AS x, count(*) AS n FROM p WHERE place = 'window' AND event_type = 'purchase')
SELECT count(*) FILTER (place = 'window' AND event_type = 'click') AS submitted, count(*) FILTER (place = 'window' AND event_type = 'purchase') AS completed, count(*) FILTER (place = 'drain' AND event_type = 'purchase') AS drain,
CAST(count(*) FILTER (place = 'window' AND event_type = 'purchase') AS BIGINT) AS amount, (SELECT x[greatest(CAST(ceil(n * 0.5) AS INTEGER), 1)] FROM d) AS p50, (SELECT x[greatest(CAST(ceil(n * 0.95) AS INTEGER), 1)] FROM d) AS p95,
count(*) FILTER (place = 'window' AND event_type = 'purchase') * 60 / 3600.0::DOUBLE AS per_minute FROM p
""")
def window_measure_drain(t: Tables) -> DataFrame:
    """The middle half of the log as the measured window; later events are the drain."""
    kinds = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "submitted").otherwise("other")
    e = t.events.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), kinds.alias("event"), F.col("value").alias("latency"), F.lit(1).alias("amount"))
    bounds = e.agg(F.min("t").alias("a"), F.max("t").alias("z")).select((F.col("a") + (F.col("z") - F.col("a")) * 0.25).alias("t0"), (F.col("a") + (F.col("z") - F.col("a")) * 0.75).alias("t1"))
    return E.window_summary(E.placed(e, bounds), 3600.0)


@query("""
WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 429 timeout' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'Schema mismatch' ELSE 'reset' END AS msg FROM events)
SELECT event_id, CASE WHEN msg IS NULL THEN 'ok' WHEN lower(msg) LIKE '%rate limit%' OR lower(msg) LIKE '%429%' THEN 'rate_limit' WHEN lower(msg) LIKE '%timeout%' OR lower(msg) LIKE '%timed out%' THEN 'timeout' WHEN lower(msg) LIKE '%validation%' OR lower(msg) LIKE '%schema%' THEN 'validation' ELSE 'transport' END AS outcome FROM m
""")
def outcome_classifier(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    m = F.when(k == 1, "HTTP 429 timeout").when(k == 2, "request timed out").when(k == 3, "Schema mismatch").when(k == 4, "reset")
    return t.events.select("event_id", validate.outcome(m).alias("outcome"))


@query("""
WITH r AS (SELECT user_id AS k, min(event_type) AS a, max(event_type) AS z FROM events WHERE event_id % 2 = 0 GROUP BY 1), e AS (SELECT c_custkey AS k FROM customer), i AS (SELECT user_id AS k, max(event_type) AS i FROM events WHERE event_id % 11 = 1 GROUP BY 1)
SELECT coalesce(r.k, e.k) AS k, CASE WHEN r.a IS NULL THEN 'absent' WHEN e.k IS NULL THEN 'unknown' WHEN a <> z OR i.i <> a THEN 'conflict' WHEN i.i IS NOT NULL THEN 'replayed' ELSE 'pending' END AS state
FROM r FULL JOIN e ON r.k = e.k LEFT JOIN i ON i.k = coalesce(r.k, e.k)
""")
def replay_dedupe(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("k"), F.col("event_type").alias("f"), "event_id")
    return integrity.replay_plan(e.where("event_id % 2 = 0"), t.customer.select(F.col("c_custkey").alias("k")), e.where("event_id % 11 = 1"), "k", "f")


@query("""
WITH RECURSIVE u AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1),
o AS MATERIALIZED (SELECT o_orderstatus AS run, o_orderkey, coalesce(c, 0) * 100 + length(o_orderpriority) AS b, coalesce(c, 0) AS u, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders LEFT JOIN u ON l_orderkey = o_orderkey),
-- one step adds an item to each run: it goes on with the pack (of n items, size bytes, us units), starts one, or stands alone, after which the next starts one
s AS (
  SELECT run, 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, -1::BIGINT AS pack, 0::BIGINT AS place, 0::BIGINT AS n, 0::BIGINT AS size, 0::BIGINT AS us FROM (SELECT DISTINCT run FROM o)
  UNION ALL
  SELECT run, k, o_orderkey, CASE WHEN fresh THEN pack + 1 ELSE pack END, CASE WHEN fresh THEN 0 ELSE place + 1 END, CASE WHEN b >= 1200 THEN 0 WHEN fresh THEN 1 ELSE n + 1 END,
         CASE WHEN b >= 1200 THEN 0 WHEN fresh THEN 2 + b ELSE size + b + 1 END, CASE WHEN b >= 1200 THEN 0 WHEN fresh THEN u ELSE us + u END
  FROM (SELECT s.run, o.k, o.o_orderkey, s.pack, s.place, s.n, s.size, s.us, o.b, o.u, o.b >= 1200 OR s.n = 0 OR s.n >= 12 OR s.size + o.b + 1 > 4500 OR s.us + o.u > 40 AS fresh FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1)
)
SELECT run AS o_orderstatus, o_orderkey, pack, place FROM s WHERE k > 0
""")
def packing_greedy(t: Tables) -> DataFrame:
    """Orders of each status packed in order of key by line count and size."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("units"))
    o = t.orders.join(n, "o_orderkey", "left").select("o_orderstatus", "o_orderkey", (F.coalesce("units", F.lit(0)) * 100 + F.length("o_orderpriority")).alias("size"), F.coalesce("units", F.lit(0)).alias("units"))
    return packing.pack(o, "o_orderstatus", ["o_orderkey"], "o_orderkey", "size", "units", max_items=12, max_bytes=4500, max_units=40, alone_from=1200, hard_bytes=10**6, hard_units=10**4, empty=2)


@query("""
WITH RECURSIVE d AS MATERIALIZED (SELECT lang, doc_id, strlen(text) + 2 AS b, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
s AS (
  SELECT lang, 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS chunk, 2::BIGINT AS size FROM (SELECT DISTINCT lang FROM d)
  UNION ALL
  SELECT lang, k, doc_id, CASE WHEN fresh THEN chunk + 1 ELSE chunk END, CASE WHEN fresh THEN 2 + b ELSE size + b + 1 END
  FROM (SELECT s.lang, d.k, d.doc_id, s.chunk, s.size, d.b, s.k = 0 OR s.size + d.b + 1 > 1048576 AS fresh FROM s JOIN d ON d.lang = s.lang AND d.k = s.k + 1)
)
SELECT lang, doc_id, chunk FROM s WHERE k > 0
""")
def chunk_bytes(t: Tables) -> DataFrame:
    return packing.chunk(t.documents.select("lang", "doc_id", (F.octet_length("text") + 2).alias("size")), "lang", ["doc_id"], "doc_id", "size", 1 << 20)


@query("""
SELECT CASE WHEN count(*) > 1 THEN 'articles' ELSE 'units' END AS cut, o_custkey, count(*) // 2 AS first_half FROM orders GROUP BY 2
""")
def midpoint_split(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.select(F.when(F.col("n") > 1, "articles").otherwise("units").alias("cut"), "o_custkey", F.expr("n div 2").alias("first_half"))


@query("""
WITH m AS (SELECT doc_id, n_chars, len(string_split(text, chr(10))) AS units, lang, source FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER () AS n FROM m),
h AS (SELECT doc_id, f, sha256('pilot-v1:' || CAST(doc_id AS VARCHAR)) AS h FROM m, unnest([lang, source]) AS x(f))
SELECT doc_id AS article FROM r WHERE k IN (0, n // 2, CAST(floor((n - 1) * 0.95) AS BIGINT), n - 1)
UNION (SELECT doc_id FROM m ORDER BY units DESC, doc_id LIMIT 1) UNION (SELECT arg_min(doc_id, h) FROM h GROUP BY f)
""")
def pilot_mandatory(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("article"), F.col("n_chars").alias("size"), F.size(F.split("text", "\n")).alias("units"), F.array("lang", "source").alias("features"))
    return sampling.mandatory(d)


@query(r"""
WITH n AS (SELECT event_id, j.id, j.parent, j.type, j.atom, j.fullkey FROM events, json_tree(props) AS j), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY id) - 1 AS node_no FROM n)
SELECT a.event_id, CAST(a.node_no AS INTEGER) AS node_no, CAST(b.node_no AS INTEGER) AS parent_no, CAST(len(string_split(a.fullkey, '.')) - 1 AS INTEGER) AS depth, replace(substr(a.fullkey, 2), '.', '/') AS pointer,
       CASE WHEN a.type = 'OBJECT' THEN 'object' WHEN a.type = 'ARRAY' THEN 'array' WHEN a.type = 'VARCHAR' THEN 'string' WHEN a.type = 'BOOLEAN' THEN 'boolean' WHEN a.type = 'NULL' THEN 'null' ELSE 'number' END AS kind,
       CASE WHEN a.atom IS NOT NULL THEN json_extract_string(a.atom, '$') END AS text
FROM k a LEFT JOIN k b ON a.event_id = b.event_id AND a.parent = b.id
""")
def tree_nodes(t: Tables) -> DataFrame:
    return tree.node_table(R.spread(t.events.select("event_id", "props"), "event_id"), "event_id", "props").select("event_id", "node_no", "parent_no", "depth", "pointer", "kind", "text")


@query("""
WITH p AS (SELECT event_id, unnest(json_keys(props)) AS k FROM events) SELECT k AS key, count(*) AS n FROM p GROUP BY 1
""")
def tree_keys(t: Tables) -> DataFrame:
    n = tree.node_table(R.spread(t.events.select("event_id", "props"), "event_id"), "event_id", "props")
    return n.where("depth = 1 AND key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


@query()
def tree_features(t: Tables) -> DataFrame:
    """Elements of the pages by tag, with the deepest place and the longest text."""
    e = tree.html_elements(t.pages, "page_id", "html")
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max(F.length("text")).alias("longest"), F.count_distinct("page_id").alias("pages"))


@query("""
WITH s AS (SELECT DISTINCT p_type AS word, p_brand AS e FROM part WHERE p_size < 10), t AS (SELECT word, list_sort(list(e)) AS targets FROM s GROUP BY 1)
SELECT word, CASE WHEN len(targets) = 1 THEN 'redirect' ELSE 'choices' END AS kind, array_to_string(targets, ' ') AS targets FROM t
""")
def redirect_disambiguation(t: Tables) -> DataFrame:
    s = t.part.where("p_size < 10").select(F.col("p_type").alias("word"), F.col("p_brand").alias("expression")).distinct()
    return export.redirects(s, t.part.select(F.col("p_brand").alias("expression")).distinct()).withColumn("targets", F.array_join("targets", " "))


@query("""
WITH g AS (SELECT p_name, list(p_brand ORDER BY p_partkey) AS r, count(*) AS n FROM part GROUP BY 1) SELECT p_name AS expression, 'e-' || substr(sha256(p_name), 1, 24) AS identity, n AS variants, len(list_distinct(r)) AS readings FROM g
""")
def entry_groups(t: Tables) -> DataFrame:
    e = export.entries(t.part.select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("expression"), F.col("p_brand").alias("reading")))
    return e.select("expression", "identity", F.size("variants").cast("long").alias("variants"), F.size("readings").cast("long").alias("readings"))


@query("""
SELECT lang, doc_id AS key, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(text) AS size FROM documents
""")
def body_offsets(t: Tables) -> DataFrame:
    """Where each body begins in its shelf."""
    d = t.documents.select("lang", F.col("doc_id").cast("string").alias("key"), "text")
    return export.offsets(d, "key", "text", "lang").withColumn("key", F.col("key").cast("long"))


@query("""
SELECT 'unique_order' AS "check", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'line_has_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'order_has_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'quantity_positive', (SELECT count(*) FROM lineitem WHERE NOT (l_quantity > 0))
UNION ALL SELECT 'discount_small', (SELECT count(*) FROM lineitem WHERE NOT (l_discount <= 0.05))
""")
def constraint_checks(t: Tables) -> DataFrame:
    return integrity.counts(
        {
            "unique_order": integrity.unique(t.orders, ["o_orderkey"]),
            "line_has_order": integrity.references(t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
            "order_has_customer": integrity.references(t.orders, "o_custkey", t.customer, "c_custkey"),
            "quantity_positive": integrity.satisfies(t.lineitem, "l_quantity > 0"),
            "discount_small": integrity.satisfies(t.lineitem, "l_discount <= 0.05"),
        }
    )


@query("""
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 1),
m AS (SELECT count(*) AS missing FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), e AS (SELECT count(*) AS extra FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT missing, extra, missing = 0 AND extra = 0 AS passed FROM m, e
""")
def source_identity_report(t: Tables) -> DataFrame:
    return integrity.identity_report(t.lineitem.where("l_orderkey % 2 = 0"), t.lineitem.where("l_orderkey % 2 = 1"), ["l_partkey", "l_suppkey"])


@query("""
SELECT turn AS position, CASE WHEN b.turn IS NULL THEN 'missing' WHEN a.turn IS NULL THEN 'unexpected' WHEN a.role <> b.role THEN 'order' WHEN a.d <> b.d THEN 'source_changed' END AS issue
FROM (SELECT turn, role, sha256(text) AS d FROM conversations WHERE conv_id = 1) a FULL JOIN (SELECT turn, role, sha256(text) AS d FROM conversations WHERE conv_id = 2) b USING (turn)
WHERE b.turn IS NULL OR a.turn IS NULL OR a.role <> b.role OR a.d <> b.d
""")
def response_by_position(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", F.col("turn").alias("position"), "role", F.sha2("text", 256).alias("d"))
    return validate.response_issues(c.where("conv_id = 1"), c.where("conv_id = 2"), "role", "d")


@query("""
SELECT batch, state, token, CAST(tries AS INTEGER) AS tries FROM (SELECT event_id AS batch, 'leased' AS state, CAST(user_id AS VARCHAR) AS token, 1 AS tries FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'done', NULL, 1 FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'queued', NULL, 1 FROM events WHERE event_id % 3 = 2)
""")
def lease_states(t: Tables) -> DataFrame:
    """Every event is a batch that is claimed; a third are completed, a third fail."""
    e = t.events.select(F.col("event_id").cast("string").alias("batch"), F.col("user_id").cast("string").alias("token"), (F.col("event_id") % 3).alias("m"))
    claim = e.select("batch", F.lit("claim").alias("kind"), "token", F.lit(0.0).alias("t"))
    then = e.where("m != 0").select("batch", F.when(F.col("m") == 1, "complete").otherwise("fail").alias("kind"), "token", F.lit(1.0).alias("t"))
    return E.leases(claim.union(then)).withColumn("batch", F.col("batch").cast("long"))


@query("""
SELECT event_id AS batch, ['leased', 'leased', 'split', 'queued', 'queued', 'done'][event_id % 6 + 1] AS state, [CAST(user_id AS VARCHAR) || 'b', CAST(user_id AS VARCHAR), NULL, NULL, NULL, NULL][event_id % 6 + 1] AS token, CAST([2, 1, 3, 0, 1, 1][event_id % 6 + 1] AS INTEGER) AS tries FROM events
""")
def lease_histories(t: Tables) -> DataFrame:
    """Six histories of batches: a lease that runs out and is taken over; a claim and a completion by another, which don't count; three failures, which split; a lease given back; a completion that comes too late; a claim after the end."""
    stories = [
        [("claim", "", 0), ("claim", "b", 100)],
        [("claim", "", 0), ("claim", "b", 10), ("complete", "b", 20)],
        [(kind, "", t_) for k in range(3) for kind, t_ in (("claim", 10 * k), ("fail", 10 * k + 5))],
        [("claim", "", 0), ("release", "", 9)],
        [("claim", "", 0), ("complete", "", 70)],
        [("claim", "", 0), ("complete", "", 5), ("claim", "b", 6)],
    ]
    made = F.array(*[F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(who).alias("who"), F.lit(float(at)).alias("t")) for kind, who, at in s]) for s in stories])
    e = t.events.select("event_id", "user_id", F.explode(F.get(made, F.col("event_id") % 6)).alias("s"))
    e = e.select(F.col("event_id").cast("string").alias("batch"), "s.kind", F.concat(F.col("user_id").cast("string"), F.col("s.who")).alias("token"), "s.t")
    return E.leases(e).withColumn("batch", F.col("batch").cast("long"))


@query("""
WITH u AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, source FROM documents)
SELECT source, count(*) AS n, CASE WHEN count(*) % 1000 = 0 THEN 'complete' WHEN count(*) > 30 THEN 'partial' ELSE 'limited' END AS title FROM u GROUP BY 1
""")
def corpus_titles(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", "n", F.when(F.col("n") % 1000 == 0, "complete").when(F.col("n") > 30, "partial").otherwise("limited").alias("title"))


@query("""
WITH a AS (SELECT doc_id, array_slice(string_split(text, ' '), 1, 5) AS x, array_slice(string_split(text, ' '), 3, 7) AS y FROM documents WHERE doc_id < 200)
SELECT doc_id, len(list_filter(x, lambda e: NOT list_contains(y, e))) AS missing, len(x) BETWEEN 1 AND 12 AND len(list_distinct(x)) = len(x) AS valid FROM a
""")
def array_rules(t: Tables) -> DataFrame:
    """Tokens of one list that another lacks, and the rules for lists."""
    w = F.split("text", " ")
    a = t.documents.where("doc_id < 200").select("doc_id", F.slice(w, 1, 5).alias("x"), F.slice(w, 3, 5).alias("y"))
    missing = F.filter("x", lambda e: ~F.array_contains("y", e))
    return a.select("doc_id", F.size(missing).cast("long").alias("missing"), (F.size("x").between(1, 12) & (F.size(F.array_distinct("x")) == F.size("x"))).alias("valid"))


def _leaf_trees(t: Tables) -> DataFrame:
    """A tree for each part: a block with data, a style and a list, a link to another entry, a number and a line break."""
    s = lambda **kw: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in kw.items()])
    link = s(tag="a", href=F.concat(F.lit("?query="), F.replace("p_brand", F.lit("#"), F.lit("%23"))), content=F.col("p_type"))
    item = s(tag="li", lang="en", content=F.col("p_name"))
    box = F.struct(F.lit("div").alias("tag"), s(**{"class": F.col("p_type"), "size": F.col("p_size").cast("string")}).alias("data"), s(fontWeight="bold", color="red").alias("style"))
    parts = [F.to_json(x) for x in (link, s(tag="br"), s(tag="ul", content=F.array(item)))]
    inside = F.concat(F.lit("["), F.concat_ws(",", *parts, F.col("p_size").cast("string")), F.lit("]"))
    whole = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(',"content":'), F.col("inside"), F.lit("}"))
    part = R.spread(t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size"), "p_partkey", "p_name")
    return part.select("p_partkey", F.to_json(box).alias("head"), inside.alias("inside")).select("p_partkey", whole.alias("tree"))


_NAME = "trim(regexp_replace(p_type, '[^A-Za-z0-9_-]+', '-', 'g'), '-')"
_BRAND = "replace(replace(p_brand, '#', '%23'), ' ', '%20')"


@query(f"""
SELECT p_partkey, '<div data-sc-class="' || p_type || '" data-sc-size="' || p_size || '" class="dc-' || {_NAME} || ' style-font-bold"><a href="entry://' || {_BRAND} || '">' || p_type || '</a><br><ul><li lang="en">' || p_name || '</li></ul>' || p_size || '</div>' AS markup,
       9 AS features FROM part
""")
def mdict_markup(t: Tables) -> DataFrame:
    r = markup.strictly_rendered(_leaf_trees(t), "tree", "mdict")
    return r.select("p_partkey", "markup", F.aggregate("ledger", F.lit(0), lambda a, x: a + x["n"]).alias("features"))


@query(f"""
SELECT p_partkey, '<div class="dc-' || {_NAME} || ' meta-size-' || p_size || '"><a href="x-dictionary:d:' || {_BRAND} || '">' || p_type || '</a><br/><ul><li>' || p_name || '</li></ul>' || p_size || '</div>' AS markup, 9 AS features FROM part
""")
def apple_markup(t: Tables) -> DataFrame:
    r = markup.strictly_rendered(_leaf_trees(t), "tree", "apple")
    return r.select("p_partkey", "markup", F.aggregate("ledger", F.lit(0), lambda a, x: a + x["n"]).alias("features"))


@query("""
WITH s AS (SELECT DISTINCT p_type AS word, p_brand AS e FROM part WHERE p_size < 10), t AS (SELECT word, list_sort(list(e)) AS targets FROM s GROUP BY 1)
SELECT word AS key, CASE WHEN len(targets) = 1 THEN '@@@LINK=' || targets[1] ELSE '<link rel="stylesheet" type="text/css" href="style.css"><ul>' || array_to_string(list_transform(targets, lambda x: '<li><a href="entry://' || replace(replace(x, '#', '%23'), ' ', '%20') || '">' || x || '</a></li>'), '') || '</ul>' END AS body FROM t
""")
def link_records(t: Tables) -> DataFrame:
    s = t.part.where("p_size < 10").select(F.col("p_type").alias("word"), F.col("p_brand").alias("expression")).distinct()
    return markup.link_records(export.redirects(s, t.part.select(F.col("p_brand").alias("expression")).distinct()))


@query("""
SELECT p_partkey, '<div data-sc-class="' || p_type || '" class="' || p_type || '" style="font-weight:bold"><a href="bword://' || replace(p_brand, '#', '%23') || '">' || p_type || '</a><br><ul><li lang="en">' || p_name || '</li></ul>' || p_size || '</div>' AS indexed,
       '<div style="font-weight:bold;color:red" data-sc-class="' || p_type || '" data-sc-size="' || p_size || '"><a href="?query=' || replace(p_brand, '#', '%23') || '" target="_blank" rel="noreferrer">' || p_type || '</a><br><ul><li lang="en">' || p_name || '</li></ul>' || p_size || '</div>' AS paged FROM part
""")
def index_and_page_markup(t: Tables) -> DataFrame:
    """The same trees in the HTML of the index-and-body format and of side-by-side pages."""
    one = markup.strictly_rendered(_leaf_trees(t), "tree", "index").select("p_partkey", "tree", F.col("markup").alias("indexed"))
    return markup.strictly_rendered(one, "tree", "page").select("p_partkey", "indexed", F.col("markup").alias("paged"))


@query("SELECT p_partkey, '/content/0/content' AS pointer, NULL AS lang, p_type AS text FROM part UNION ALL SELECT p_partkey, '/content/2/content/0/content', 'en', p_name FROM part")
def tree_leaves(t: Tables) -> DataFrame:
    """Visible leaves with the language that they inherit."""
    return tree.leaves(tree.node_table(_leaf_trees(t), "p_partkey", "tree"), "p_partkey").select("p_partkey", "pointer", "lang", "text")


@query("""
SELECT kind, name, n * (SELECT count(*) FROM part) AS n FROM (VALUES ('data', 'class', 1), ('data', 'size', 1), ('kind', 'array', 2), ('kind', 'number', 1), ('kind', 'object', 7), ('kind', 'string', 13), ('tag', 'a', 1), ('tag', 'br', 1), ('tag', 'div', 1), ('tag', 'li', 1), ('tag', 'ul', 1)) AS v(kind, name, n)
""")
def tree_feature_counts(t: Tables) -> DataFrame:
    """How often each element, data key and kind of node occurs."""
    return tree.features(tree.node_table(_leaf_trees(t), "p_partkey", "tree"))


@query("SELECT p_partkey, '<kref>' || p_type || '</kref>' || chr(10) || '• ' || p_name || chr(10) || p_size || chr(10) AS markup, 3 AS degraded FROM part")
def xdxf_markup(t: Tables) -> DataFrame:
    """The same trees with what a plain format lacks as text, and how many features were degraded by that."""
    r = export.rendered(_leaf_trees(t), "tree", "xdxf")
    return r.select("p_partkey", "markup", F.size(F.filter("ledger", lambda x: x["fidelity"] == "degraded")).alias("degraded"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 20 THEN '{"content":[{"content":"' || p_type || '","href":"?query=' || replace(p_brand, '#', '%23') || '","tag":"a"},{"tag":"br"},{"content":[{"content":"T ' || p_brand || '","lang":"ru","tag":"li"}],"tag":"ul"},' || p_size || '],"data":{"class":"' || p_type || '","size":"' || p_size || '"},"style":{"color":"red","fontWeight":"bold"},"tag":"div"}' END AS body FROM part
""")
def translated_trees(t: Tables) -> DataFrame:
    """Trees with a leaf translated and its holder's language set, in canonical JSON; trees without a translation stay as they are and are told by null here."""
    targets = t.part.where("p_size < 20").select("p_partkey", F.lit("/content/2/content/0/content").alias("pointer"), F.concat(F.lit('"T '), F.col("p_brand"), F.lit('"')).alias("target"))
    before = _leaf_trees(t)
    done = tree.applied(before, targets, "p_partkey", "tree", "ru")
    return done.join(before, "p_partkey").select("p_partkey", F.when(F.col("body") != F.col("tree"), F.col("body")).alias("body"))


@query("""
SELECT p_partkey, 0 AS ordinal, '/0/content/0/content' AS pointer, 'glossary' AS role, p_name AS text, sha256(p_name) AS digest, strlen(p_name) AS byte_count FROM part UNION ALL SELECT p_partkey, 1, '/0/content/1/content', 'glossary', p_type, sha256(p_type), strlen(p_type) FROM part
""")
def translatable_units(t: Tables) -> DataFrame:
    """The leaves to be translated, with role, digest and size; attributions aren't among them."""
    body = F.concat(F.lit('[{"tag":"ul","data":{"content":"glossary"},"content":[{"tag":"li","content":"'), "p_name", F.lit('"},{"tag":"li","content":"'), "p_type", F.lit('"}]},{"tag":"span","data":{"content":"attribution"},"content":"'), "p_brand", F.lit('"}]'))
    part = R.spread(t.part.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey", "p_name")
    return tree.unit_table(part.select("p_partkey", body.alias("body")), "p_partkey", "body")
