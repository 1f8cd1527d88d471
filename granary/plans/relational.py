"""Joins, aggregates, windows, orders and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamped_delta, nearest_rank, rounded_indices
from ..operators import coverage
from ..operators import relational as R
from .registry import Tables, query

LINES = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1"


@query("""
WITH arts AS (SELECT o_orderkey AS art, o_custkey AS a, o_orderpriority AS b, o_orderstatus AS st FROM orders),
acc AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
open_arts AS (SELECT DISTINCT l_orderkey AS art FROM lineitem WHERE l_linestatus <> 'F' AND l_orderkey NOT IN (SELECT l_orderkey FROM acc)),
openh AS (SELECT a, b FROM arts WHERE st = 'P' UNION SELECT a, b FROM arts WHERE art IN (SELECT art FROM open_arts))
SELECT (SELECT count(*) FROM (SELECT DISTINCT a, b FROM arts)) - (SELECT count(*) FROM openh) AS done, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM arts)) AS total
""")
def headword_progress(t: Tables) -> DataFrame:
    """Headword: customer and priority; article: order; unit: open line; done: an order with a returned line."""
    articles = t.orders.select(F.col("o_orderkey").alias("art"), "o_custkey", "o_orderpriority", "o_orderstatus")
    units = t.lineitem.where("l_linestatus != 'F'").select(F.col("l_orderkey").alias("art"), F.col("l_orderkey").alias("unit"))
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit")).distinct()
    return coverage.headword_progress(articles, articles.where("o_orderstatus != 'P'"), units, done, ["o_custkey", "o_orderpriority"], "art", "unit")


@query("""
SELECT count(*) AS units, count(DISTINCT l_orderkey) AS articles, CAST(coalesce(sum(length(p_name)), 0) AS BIGINT) AS characters FROM lineitem l JOIN part ON p_partkey = l_partkey
WHERE NOT (l_returnflag = 'A' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F'))
""")
def workload_progress(t: Tables) -> DataFrame:
    """Units neither accepted themselves nor part of a validated batch, with their size."""
    batches = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    open_ = t.lineitem.where("l_returnflag != 'A'").join(batches, "l_orderkey", "left_anti")
    sized = open_.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return sized.agg(F.count("*").alias("units"), F.count_distinct("l_orderkey").alias("articles"), F.coalesce(F.sum(F.length("p_name")), F.lit(0)).alias("characters"))


_COVER = """
WITH m AS (SELECT source, lang AS term, doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
"""


@query(_COVER + """
f AS (SELECT source, term, bool_and(r.doc_id IS NOT NULL) AS all_in FROM m LEFT JOIN r USING (doc_id) GROUP BY 1, 2)
SELECT source, count(*) AS terms, count(all_in) AS matched, count(*) FILTER (all_in) AS covered FROM f GROUP BY 1
""")
def coverage_by_source(t: Tables) -> DataFrame:
    d = t.documents.select("source", F.col("lang").alias("term"), "doc_id")
    return coverage.strict_coverage(d, d, t.labels.where("quality = 1"), "source", "term", "doc_id")


@query(_COVER + """
f AS (SELECT source, term, bool_or(r.doc_id IS NOT NULL) AS any_in FROM m LEFT JOIN r USING (doc_id) GROUP BY 1, 2)
SELECT source, count(*) AS terms, count(*) FILTER (any_in) AS covered FROM f GROUP BY 1
""")
def coverage_loose(t: Tables) -> DataFrame:
    d = t.documents.select("source", F.col("lang").alias("term"), "doc_id")
    return coverage.loose_coverage(d, d, t.labels.where("quality = 1"), "source", "term", "doc_id")


@query("""
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 5))
""")
def relational_division(t: Tables) -> DataFrame:
    """Orders all of whose parts are large; those without a line too."""
    members = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return R.divided(t.orders.select("o_orderkey", "o_custkey"), members, t.part.where("p_size > 5"), "o_orderkey", "p_partkey")


@query("""
WITH probe AS (SELECT DISTINCT p_brand AS term FROM part WHERE p_size < 20 UNION SELECT DISTINCT p_type FROM part WHERE p_size > 40),
h AS (SELECT term, p_partkey, 'p_brand' AS k, 0 AS p FROM probe JOIN part ON p_brand = term UNION ALL SELECT term, p_partkey, 'p_type', 1 FROM probe JOIN part ON p_type = term)
SELECT term, p_partkey, arg_min(k, p) AS match_kind FROM h GROUP BY 1, 2
""")
def scope_priority_match(t: Tables) -> DataFrame:
    """A term meets an item by brand before it meets it by type."""
    probe = t.part.where("p_size < 20").select(F.col("p_brand").alias("term")).union(t.part.where("p_size > 40").select("p_type")).distinct()
    return R.prioritised(probe, "term", t.part, "p_partkey", ["p_brand", "p_type"])


@query("""
WITH c AS (SELECT s_suppkey, s_nationkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING')
SELECT s_suppkey, count(DISTINCT c_custkey) AS candidates, CASE WHEN count(DISTINCT c_custkey) = 1 THEN 'included' ELSE 'unresolved' END AS decision,
       CASE WHEN count(DISTINCT c_custkey) = 1 THEN max(c_custkey) END AS resolved FROM supplier LEFT JOIN c USING (s_suppkey) GROUP BY 1
""")
def candidate_resolution(t: Tables) -> DataFrame:
    """A note is resolved if its candidates name one sequence alone."""
    c = t.customer.where("c_acctbal > 9000 AND c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    # notes with the same nations have the same candidates, so these are counted once for each set of nations, never paired with each note
    nations = F.sort_array(F.collect_set(F.when(F.col("s_suppkey").isNotNull(), F.col("s_nationkey"))))
    notes = t.supplier.groupBy("s_suppkey").agg(nations.alias("nations"))
    asked = notes.select("nations").distinct().select("nations", F.explode("nations").alias("s_nationkey"))
    found = asked.join(c, "s_nationkey").groupBy("nations").agg(F.count_distinct("c_custkey").alias("n"), F.max("c_custkey").alias("m"))
    g = notes.join(found, "nations", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), "m")
    one = F.col("candidates") == 1
    return g.select("s_suppkey", "candidates", F.when(one, "included").otherwise("unresolved").alias("decision"), F.when(one, F.col("m")).alias("resolved"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def first_rank_dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING min(p_partkey) <= 500")
def min_rank_per_term(t: Tables) -> DataFrame:
    return R.min_rank(t.part, "p_name", "p_partkey").where("p_partkey <= 500")


@query("""
SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_shipdate < TIMESTAMP '1996-01-01')
ORDER BY o_orderdate, o_orderkey LIMIT 200
""")
def scope_delta_topn(t: Tables) -> DataFrame:
    """The next 200 articles that no earlier run has."""
    earlier = t.lineitem.where("l_shipdate < TIMESTAMP '1996-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(earlier, "o_orderkey", "left_anti").orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey, count(l_orderkey) AS lines, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1
""")
def left_join_on_filter(t: Tables) -> DataFrame:
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return t.orders.select("o_orderkey").join(r, "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("lines"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("numbers"))


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def anti_by_outer(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""
SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c.c_custkey AND l_quantity > 49 AND o_orderpriority = '1-URGENT')
""")
def semi_over_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").join(t.lineitem.where("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return t.customer.select("c_custkey", "c_mktsegment").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("""
SELECT n_name, r_name, o_orderpriority, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey GROUP BY 1, 2, 3
""")
def multiway_join(t: Tables) -> DataFrame:
    """Six tables; small sides are broadcast by their measured size, the rest is left to the optimiser."""
    home = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    people = t.customer.join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t.orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        lines.join(t.supplier, (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .groupBy("n_name", "r_name", "o_orderpriority")
        .agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"))
    )


@query("""
SELECT a.l_partkey, a.l_suppkey, a.l_linenumber, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber
WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R' GROUP BY 1, 2, 3
""")
def composite_key_join(t: Tables) -> DataFrame:
    key = ["l_partkey", "l_suppkey", "l_linenumber"]
    a, b = t.lineitem.where("l_returnflag = 'N'").select(*key), t.lineitem.where("l_returnflag = 'R'").select(*key)
    return a.join(b, key).groupBy(*key).agg(F.count("*").alias("pairs"))


@query("""
SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) % 7 AS declared, coalesce(n, 0) AS counted FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE CAST(round(o_totalprice) AS BIGINT) % 7 <> coalesce(n, 0)
""")
def count_mismatch(t: Tables) -> DataFrame:
    """A declared count held against the rows that are there."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = t.orders.select("o_orderkey", (F.round("o_totalprice").cast("long") % 7).alias("declared")).join(n, "o_orderkey", "left")
    return j.select("o_orderkey", "declared", F.coalesce("n", F.lit(0)).alias("counted")).where("declared != counted")


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderkey DESC) = 1
""")
def latest_candidate(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.latest(o, ["o_custkey"], F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).desc(), F.desc("o_orderkey"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS tag FROM events),
x AS (SELECT c_custkey, c_mktsegment, max(c_name) AS name FROM customer GROUP BY 1, 2), u AS (SELECT c_custkey, max(c_name) AS name FROM customer GROUP BY 1 HAVING count(*) = 1)
SELECT event_id, coalesce(x.name, u.name) AS c_name FROM e LEFT JOIN x ON x.c_custkey = e.user_id AND x.c_mktsegment = upper(e.event_type) LEFT JOIN u ON u.c_custkey = e.user_id
""")
def exact_then_fallback(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.col("user_id").alias("c_custkey"), F.upper("event_type").alias("c_mktsegment"))
    return R.exact_then_unique(e, t.customer.select("c_custkey", "c_mktsegment", "c_name"), ["c_custkey", "c_mktsegment"], "c_custkey", "c_name").select("event_id", "c_name")


@query("""
WITH a AS (SELECT doc_id, n_chars % 2 AS q FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, quality AS q FROM labels)
SELECT doc_id, CASE WHEN b.q IS NULL THEN 'missing' WHEN a.q IS NULL THEN 'extra' WHEN a.q <> b.q THEN 'different' ELSE 'same' END AS state FROM a FULL JOIN b USING (doc_id)
""")
def reconcile_two_sided(t: Tables) -> DataFrame:
    a = t.documents.where("doc_id % 3 != 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("q"))
    return R.reconciled(a, t.labels.select("doc_id", F.col("quality").alias("q")), ["doc_id"], ["q"])


@query("""
(SELECT 'missing' AS side, l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 1))
UNION ALL (SELECT 'extra', l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 1 EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 2 = 0))
""")
def identity_except_both_ways(t: Tables) -> DataFrame:
    even, odd = (t.lineitem.where(f"l_orderkey % 2 = {k}").select("l_partkey", "l_suppkey") for k in (0, 1))
    return even.subtract(odd).select(F.lit("missing").alias("side"), "*").union(odd.subtract(even).select(F.lit("extra"), "*"))


@query("""
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderpriority LIKE '1-%') AS urgent, max(o_orderkey) AS newest, count(*) FILTER (o_orderpriority LIKE '1-%') = 0 AS ready FROM orders GROUP BY 1
""")
def status_report(t: Tables) -> DataFrame:
    urgent = F.count_if(F.col("o_orderpriority").like("1-%"))
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), urgent.alias("urgent"), F.max("o_orderkey").alias("newest"), (urgent == 0).alias("ready"))


@query("""
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS high_users, count(DISTINCT CASE WHEN props LIKE '%1%' THEN user_id END) AS like_users, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY 1
""")
def conditional_distinct(t: Tables) -> DataFrame:
    high = F.col("value") > 50
    return t.events.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(high, F.col("user_id"))).alias("high_users"),
        F.count_distinct(F.when(F.col("props").like("%1%"), F.col("user_id"))).alias("like_users"),
        F.sum(F.when(high, 1).otherwise(0)).alias("high"),
    )


@query("""
WITH n AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids, count(*) AS orders, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > 1
""")
def ordered_id_list(t: Tables) -> DataFrame:
    """Aggregated facts joined to another table and aggregated again, with an ordered list of ids."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    g = t.orders.join(n, "o_orderkey", "left").groupBy("o_custkey")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return g.agg(ids.alias("ids"), F.count("*").alias("orders"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines")).where("orders > 1")


@query("""
WITH w AS (SELECT DISTINCT source, unnest(string_split(text, ' ')) AS word FROM documents), c AS (SELECT word, count(*) AS sources FROM w GROUP BY 1) SELECT sources, count(*) AS words FROM c GROUP BY 1
""")
def membership_histogram(t: Tables) -> DataFrame:
    return coverage.membership_histogram(t.documents.select("source", F.explode(F.split("text", " ")).alias("word")), "source", "word")


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'absent' WHEN quality = 1 THEN 'translated' ELSE 'untranslated' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def three_way_status(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.when(F.col("quality").isNull(), "absent").when(F.col("quality") == 1, "translated").otherwise("untranslated").alias("state")).agg(F.count("*").alias("n"))


_PCT = "WITH v AS (SELECT event_type, list_sort(list(value)) AS x, count(value) AS n FROM events GROUP BY 1) "


@query(_PCT + "SELECT event_type, x[CAST(ceil(0.5 * n) AS INTEGER)] AS p50, x[CAST(ceil(0.95 * n) AS INTEGER)] AS p95, x[CAST(ceil(0.99 * n) AS INTEGER)] AS p99 FROM v")
def pct_nearest_rank(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*[nearest_rank("value", f).alias(n) for f, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


@query(_PCT + "SELECT event_type, x[CAST(round_even((n - 1) * 0.5, 0) AS INTEGER) + 1] AS p50, x[CAST(round_even((n - 1) * 0.95, 0) AS INTEGER) + 1] AS p95 FROM v")
def pct_round_index(t: Tables) -> DataFrame:
    return rounded_indices(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("""
WITH x AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS c, CAST(l_partkey AS BIGINT) AS o FROM lineitem)
SELECT l_orderkey, CAST(sum((i - c) * CAST(1.25 AS DECIMAL(10, 4)) + c * CAST(0.125 AS DECIMAL(10, 4)) + o * CAST(10.5 AS DECIMAL(10, 4))) * CAST(0.5 AS DECIMAL(6, 2)) AS DOUBLE) AS micro_cost FROM x GROUP BY 1
""")
def exact_cost(t: Tables) -> DataFrame:
    """Cost from three prices in decimals; the sum is exact, only the result is a double."""
    d = lambda v: F.lit(v).cast("decimal(10,4)")
    x = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("decimal(12,0)").alias("i"), F.col("l_linenumber").cast("decimal(12,0)").alias("c"), F.col("l_partkey").cast("decimal(12,0)").alias("o"))
    cost = F.sum((F.col("i") - F.col("c")) * d("1.25") + F.col("c") * d("0.125") + F.col("o") * d("10.5")) * F.lit("0.5").cast("decimal(6,2)")
    return x.groupBy("l_orderkey").agg(cost.cast("double").alias("micro_cost"))


@query("SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN text END AS payload FROM conversations")
def first_row_payload(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.when(n == 1, F.col("text")).alias("payload"))


@query("SELECT doc_id, lang, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, strlen(text) AS size FROM documents")
def running_offset(t: Tables) -> DataFrame:
    w = Window.partitionBy("lang").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    return t.documents.select("doc_id", "lang", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("start"), size.alias("size"))


@query("""
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, strftime(h, '%Y-%m-%d %H') AS hour, n - lag(n) OVER w AS delta, CAST(date_diff('hour', lag(h) OVER w, h) AS BIGINT) AS hours FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)
""")
def rate_between_samples(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("h")
    return s.select("event_type", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), (F.col("n") - F.lag("n").over(w)).alias("delta"), F.expr("(unix_seconds(cast(h as timestamp)) - unix_seconds(cast(lag(h) over (partition by event_type order by h) as timestamp))) div 3600").alias("hours"))


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, greatest(max(CASE WHEN k = n THEN event_id END) - max(CASE WHEN k = 1 THEN event_id END), 0) AS delta FROM r GROUP BY 1
""")
def counter_delta(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return e.groupBy("user_id").agg(clamped_delta("event_id", "at").alias("delta"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 100 + 1 AS BIGINT) AS page, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) % 100 AS BIGINT) AS place FROM conversations")
def page_slices(t: Tables) -> DataFrame:
    return R.pages(t.conversations.select("conv_id", "turn"), 100, F.col("conv_id"), F.col("turn"))


@query("SELECT doc_id FROM documents ORDER BY sha256('pilot:' || CAST(doc_id AS VARCHAR)) LIMIT 50")
def stable_hash_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(F.sha2(F.concat(F.lit("pilot:"), F.col("doc_id").cast("string")), 256)).limit(50)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents), hard AS (SELECT doc_id FROM r WHERE k <= 20),
rest AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hard) ORDER BY sha256(CAST(doc_id AS VARCHAR)) LIMIT 80)
SELECT doc_id, 'hard' AS why FROM hard UNION ALL SELECT doc_id, 'drawn' FROM rest
""")
def top_fifth_and_drawn(t: Tables) -> DataFrame:
    """A fifth by difficulty, the rest by hash order."""
    hard = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")
    rest = t.documents.select("doc_id").join(hard, "doc_id", "left_anti").orderBy(F.sha2(F.col("doc_id").cast("string"), 256)).limit(80)
    return hard.select("doc_id", F.lit("hard").alias("why")).union(rest.select("doc_id", F.lit("drawn")))


@query("""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(CASE WHEN k = 0 THEN doc_id END) AS smallest, max(CASE WHEN k = n // 2 THEN doc_id END) AS middle, max(CASE WHEN k = CAST(floor((n - 1) * 0.95) AS BIGINT) THEN doc_id END) AS p95, max(CASE WHEN k = n - 1 THEN doc_id END) AS largest FROM r GROUP BY 1
""")
def order_statistic_picks(t: Tables) -> DataFrame:
    w = Window.partitionBy("lang")
    r = t.documents.select("lang", "doc_id", (F.row_number().over(w.orderBy("n_chars", "doc_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    pick = lambda at: F.max(F.when(F.col("k") == at, F.col("doc_id")))
    return r.groupBy("lang").agg(pick(F.lit(0)).alias("smallest"), pick(F.expr("n div 2")).alias("middle"), pick(F.floor((F.col("n") - 1) * 0.95)).alias("p95"), pick(F.col("n") - 1).alias("largest"))


@query("""
SELECT lang, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS longest, arg_min(doc_id, sha256(CAST(doc_id AS VARCHAR))) AS drawn FROM documents GROUP BY 1
""")
def argmax_with_tiebreak(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"), F.min_by("doc_id", F.sha2(F.col("doc_id").cast("string"), 256)).alias("drawn"))


@query("SELECT lang, doc_id FROM documents WHERE text LIKE '%the%' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10")
def capped_samples(t: Tables) -> DataFrame:
    """At most ten cases of each kind."""
    n = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return t.documents.where(F.col("text").contains("the")).select("lang", "doc_id", n.alias("n")).where("n <= 10").drop("n")


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') COLLATE "C", p_name COLLATE "C", p_partkey) AS place FROM part WHERE p_size = 7
""".replace(' COLLATE "C"', ""))
def case_fold_order(t: Tables) -> DataFrame:
    """ASCII case folded first, raw bytes second, whatever the locale."""
    from ..functions.text import stable_key

    named = R.numbered(t.part.where("p_size = 7").select("p_partkey", "p_name"), "place", *stable_key("p_name"), F.col("p_partkey"))
    return named.select("p_partkey", (F.col("place") + 1).cast("int").alias("place"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").union(t.customer.where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.where("l_shipdate >= TIMESTAMP '1998-01-01'").select("l_orderkey", "l_returnflag").dropDuplicates()


@query("""
SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS repeated, (SELECT count(*) FROM orders WHERE o_totalprice IS NULL) AS missing
""")
def scalar_difference(t: Tables) -> DataFrame:
    a = t.lineitem.agg((F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("repeated"))
    return a.crossJoin(t.orders.agg(F.count_if(F.col("o_totalprice").isNull()).alias("missing")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) != 1")
def unique_key_violations(t: Tables) -> DataFrame:
    from ..operators.integrity import unique

    return unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT o_orderkey, 'x-r2-' || substr('x-r1-' || CAST(o_orderkey AS VARCHAR), length('x-r1-') + 1) AS id, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS kind FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND coalesce(o_orderstatus, '') <> 'P' AND CAST(o_orderkey AS VARCHAR) NOT LIKE '1%'
""")
def projected_and_filtered(t: Tables) -> DataFrame:
    """Key rewritten by prefix, constant choice, list and prefix filters; all of it reaches the scan or the projection."""
    from ..operators.incremental import rekeyed

    o = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.coalesce("o_orderstatus", F.lit("")) != "P") & ~F.col("o_orderkey").cast("string").like("1%"))
    return o.select("o_orderkey", rekeyed(F.concat(F.lit("x-r1-"), F.col("o_orderkey").cast("string")), "x-r1-", "x-r2-").alias("id"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("kind"))


@query("""
WITH b AS (SELECT l_orderkey, count(*) AS units, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM lineitem GROUP BY 1), e AS (SELECT event_type, user_id FROM events)
SELECT event_type, count(*) AS occurrences, CAST(sum(units) AS BIGINT) AS units, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN b ON l_orderkey = user_id GROUP BY 1
""")
def workload_per_occurrence(t: Tables) -> DataFrame:
    """A batch listed twice counts twice."""
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("user_id")).agg(F.count("*").alias("units"), F.sum("l_linenumber").alias("weight"))
    return t.events.select("event_type", "user_id").join(b, "user_id").groupBy("event_type").agg(F.count("*").alias("occurrences"), F.sum("units").alias("units"), F.sum("weight").alias("weight"))


@query("SELECT event_type, user_id % 10 AS cell, count(*) AS n FROM events GROUP BY 1, 2")
def multi_key_count(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (F.col("user_id") % 10).alias("cell")).agg(F.count("*").alias("n"))
