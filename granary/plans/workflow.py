"""Reviews, tags, scopes and batches on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, review, scope
from .registry import Tables, query

_TRANSLATIONS = "t AS (SELECT event_id % 500 AS unit, event_id AS id, user_id % 5 AS worker, event_type AS target, event_id % 3 = 0 AS accepted, ts AS created_at FROM events)"
_REVIEWS = """v AS (SELECT o_orderkey % 600 AS unit, o_custkey % 5 AS reviewer, ['approve', 'replace', 'reject', 'unsure'][o_orderkey % 4 + 1] AS decision,
     CASE WHEN o_orderkey % 4 = 1 THEN ['', 'purchase', 'click', NULL][o_orderkey // 4 % 4 + 1] END AS replacement FROM orders)"""


def _translations(t: Tables) -> DataFrame:
    return t.events.select((F.col("event_id") % 500).alias("unit"), F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("worker"), F.col("event_type").alias("target"), (F.col("event_id") % 3 == 0).alias("accepted"), F.col("ts").alias("created_at"))


def _reviews(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.get(F.array(F.lit(""), F.lit("purchase"), F.lit("click"), F.lit(None)), F.expr("o_orderkey div 4 % 4").cast("int"))
    decision = F.get(F.array(*[F.lit(x) for x in ("approve", "replace", "reject", "unsure")]), (k % 4).cast("int"))
    return t.orders.select((k % 600).alias("unit"), (F.col("o_custkey") % 5).alias("reviewer"), decision.alias("decision"), F.when(k % 4 == 1, text).alias("replacement"))


@query(f"""
WITH {_TRANSLATIONS} SELECT unit, id, target FROM t QUALIFY row_number() OVER (PARTITION BY unit ORDER BY created_at DESC, id DESC) = 1
""")
def accepted_translations(t: Tables) -> DataFrame:
    return review.accepted(_translations(t)).select("unit", "id", "target")


@query(f"""
WITH {_TRANSLATIONS}, {_REVIEWS}, c AS (SELECT unit, worker, target FROM t QUALIFY row_number() OVER (PARTITION BY unit ORDER BY accepted DESC, id DESC) = 1)
SELECT * FROM (SELECT unit, reviewer, CASE WHEN target IS NULL THEN 'unknown_unit' WHEN reviewer = worker THEN 'own_translation' WHEN decision = 'replace' AND coalesce(trim(replacement), '') = '' THEN 'no_replacement'
  WHEN decision = 'replace' AND replacement = target THEN 'same_target' WHEN decision NOT IN ('approve', 'replace', 'reject') THEN 'unknown_decision' END AS issue FROM v LEFT JOIN c USING (unit)) WHERE issue IS NOT NULL
""")
def review_findings(t: Tables) -> DataFrame:
    """What is wrong with reviews, held against the translation that each is about."""
    return review.review_issues(_reviews(t), _translations(t))


@query(f"""
WITH {_REVIEWS}, g AS (SELECT unit, count(DISTINCT decision || chr(31) || coalesce(replacement, '')) AS n, max(decision) AS d, max(replacement) AS x FROM v WHERE unit % 7 < 2 GROUP BY 1), r AS (SELECT p_partkey AS unit FROM part WHERE p_size < 9)
SELECT unit, CASE WHEN r.unit IS NOT NULL THEN 'reject' WHEN n = 1 THEN d ELSE 'open' END AS decision, CASE WHEN r.unit IS NULL AND n = 1 THEN x END AS replacement FROM g FULL JOIN r USING (unit)
""")
def adjudicated_units(t: Tables) -> DataFrame:
    """A ruling first, else what all reviewers of a unit say."""
    rulings = t.part.where("p_size < 9").select(F.col("p_partkey").alias("unit"), F.lit("reject").alias("decision"), F.lit(None).cast("string").alias("replacement"))
    return review.adjudicated(_reviews(t).where("unit % 7 < 2"), rulings)


@query("""
WITH u AS (SELECT l_orderkey AS a, string_agg(l_linenumber || ':' || l_partkey || l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS units FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
e AS (SELECT a, string_agg(k || v, ' ' ORDER BY k, v) AS evidence FROM (SELECT DISTINCT l_orderkey AS a, l_returnflag AS k, l_linestatus AS v FROM lineitem WHERE l_linenumber > 2) GROUP BY 1)
SELECT o_orderkey AS article, o_orderpriority AS term, units, coalesce(evidence, '') AS evidence FROM orders JOIN u ON u.a = o_orderkey LEFT JOIN e ON e.a = o_orderkey
""")
def article_envelopes(t: Tables) -> DataFrame:
    """Articles with their open units in order and the distinct evidence for them."""
    articles = t.orders.select(F.col("o_orderkey").alias("article"), F.col("o_orderpriority").alias("term"))
    line = t.lineitem.withColumn("article", F.col("l_orderkey"))
    units = line.where("l_returnflag != 'A'").select("article", F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("unit"), F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("text"), F.lit("").alias("digest"))
    e = review.envelopes(articles, units, line.where("l_linenumber > 2").select("article", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("value")))
    text = F.transform("units", lambda u: F.concat(u["ordinal"].cast("string"), F.lit(":"), u["unit"].cast("string"), u["role"], u["text"]))
    return e.select("article", "term", F.array_join(text, " ").alias("units"), F.array_join(F.transform("evidence", lambda x: F.concat(x["kind"], x["value"])), " ").alias("evidence"))


@query("SELECT p_partkey AS \"row\", array_to_string(list_transform(string_split(p_name, ' '), lambda w: 'L-' || upper(w)), ' ') AS labels FROM part")
def localised_tags(t: Tables) -> DataFrame:
    """Tag codes of each row as labels, in order."""
    rows = t.part.select(F.col("p_partkey").alias("row"), F.col("p_name").alias("codes"))
    mapping = t.part.select(F.explode(F.split("p_name", " ")).alias("code")).distinct().withColumn("label", F.concat(F.lit("L-"), F.upper("code")))
    return review.localised_references(rows, mapping, mapping).select("row", "labels")


@query("""
WITH g AS (SELECT p_type AS category, p_brand AS code, CASE WHEN p_size = 7 THEN ' ' ELSE p_name END AS label, CASE WHEN p_size = 9 THEN NULL ELSE p_type END AS description, CASE WHEN p_size > 49 THEN 'b' ELSE 'a' END AS provenance FROM part WHERE p_partkey < 90)
SELECT 'repeated_code' AS issue, code AS detail FROM g GROUP BY category, code HAVING count(*) > 1 UNION ALL SELECT 'incomplete', code FROM g WHERE coalesce(trim(label), '') = '' OR coalesce(trim(description), '') = ''
UNION ALL SELECT 'shared_label', label FROM g WHERE label <> '' GROUP BY category, label HAVING count(DISTINCT code) > 1 UNION ALL SELECT 'several_provenances', CAST(n AS VARCHAR) FROM (SELECT count(DISTINCT provenance) AS n FROM g) WHERE n > 1
""")
def tag_catalogue_findings(t: Tables) -> DataFrame:
    size = F.col("p_size")
    g = t.part.where("p_partkey < 90").select(F.col("p_type").alias("category"), F.col("p_brand").alias("code"), F.when(size == 7, " ").otherwise(F.col("p_name")).alias("label"), F.when(size != 9, F.col("p_type")).alias("description"), F.when(size > 49, "b").otherwise("a").alias("provenance"))
    return catalog.catalog_issues(g)


@query("""
WITH a AS (SELECT p_name AS label, count(*) AS n FROM part WHERE p_size < 3 GROUP BY 1), m AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size BETWEEN 2 AND 4)
SELECT label, CASE WHEN m.label IS NULL THEN 'unknown' WHEN a.label IS NULL THEN 'missing' ELSE 'repeated' END AS issue FROM a FULL JOIN m USING (label) WHERE m.label IS NULL OR a.label IS NULL OR n > 1
""")
def tag_bank_findings(t: Tables) -> DataFrame:
    """Localised labels read through the inverse map."""
    return catalog.bank_issues(t.part.where("p_size < 3").select(F.col("p_name").alias("label")), t.part.where("p_size BETWEEN 2 AND 4").select(F.col("p_name").alias("label")))


@query("SELECT c_mktsegment || c_custkey % 40 AS term, CAST(min(c_nationkey) AS BIGINT) AS rank FROM customer WHERE c_nationkey BETWEEN 1 AND 12 GROUP BY 1")
def ranked_list(t: Tables) -> DataFrame:
    """Normalised terms within a limit of rank, ties kept, the best rank of each."""
    rows = t.customer.select(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("t"), F.col("c_nationkey").alias("r"))
    return scope.ranked_terms(rows, "t", "r", 12)


_TERMS = """q AS (SELECT DISTINCT 'a' AS source, p_brand AS term FROM part WHERE p_size < 20 UNION SELECT DISTINCT 'b', p_type FROM part UNION SELECT 'b', 'nothing'),
a AS (SELECT p_partkey AS article, CASE WHEN p_partkey % 9 = 0 THEN 'LARGE' ELSE p_brand END AS e, p_type AS r FROM part WHERE p_partkey < 400), x AS (SELECT source, term, article, 'expression' AS match_kind FROM q JOIN a ON e = term),
l AS (SELECT * FROM x UNION ALL SELECT q.source, q.term, a.article, 'reading' FROM q JOIN a ON r = q.term WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source = q.source AND x.term = q.term))"""


def _scope(t: Tables) -> dict:
    p = t.part
    articles = p.where("p_partkey < 400").select(F.col("p_partkey").alias("article"), F.when(F.col("p_partkey") % 9 == 0, "LARGE").otherwise(F.col("p_brand")).alias("expression"), F.col("p_type").alias("reading"))
    one = p.where("p_size < 20").select(F.col("p_brand").alias("term")).distinct().withColumn("rank", F.lit(1))
    two = p.select(F.col("p_type").alias("term")).distinct().union(t.spark.sql("SELECT 'nothing'")).withColumn("rank", F.lit(1))
    return scope.combined({"a": one, "b": two}, articles)


@query(f"WITH {_TERMS} SELECT DISTINCT source, term, article, match_kind FROM l")
def scope_links(t: Tables) -> DataFrame:
    """Terms of two lists to articles: by expression, and by reading where a term is nobody's expression."""
    return _scope(t)["links"]


@query(f"""
WITH {_TERMS}, m AS (SELECT q.source, q.term, CAST(EXISTS (SELECT 1 FROM l WHERE l.source = q.source AND l.term = q.term) AS BIGINT) AS hit FROM q), u AS (SELECT term, max(hit) AS hit FROM m GROUP BY 1)
SELECT source, count(*) AS terms, CAST(sum(hit) AS BIGINT) AS matched, CAST(count(*) - sum(hit) AS BIGINT) AS skipped FROM m GROUP BY 1 UNION ALL SELECT 'union', count(*), CAST(sum(hit) AS BIGINT), CAST(count(*) - sum(hit) AS BIGINT) FROM u
""")
def scope_report(t: Tables) -> DataFrame:
    """Terms, matched and skipped, by list and for all together."""
    return scope.report(_scope(t)["terms"])


_FOUND = "f AS (SELECT o_custkey AS note, o_orderpriority AS sequence FROM orders WHERE o_orderkey % 11 = 0), g AS (SELECT c_custkey AS note, count(DISTINCT sequence) AS n, max(sequence) AS s FROM customer LEFT JOIN f ON note = c_custkey GROUP BY 1)"


@query(f"""
WITH {_FOUND}, d AS (SELECT note, CASE WHEN n = 1 THEN 'included' ELSE 'unresolved' END AS decision, CASE WHEN n = 1 THEN s END AS sequence FROM g), h AS (SELECT note, min(sequence) AS chosen FROM f WHERE note % 2 = 0 GROUP BY 1)
SELECT note, CASE WHEN chosen IS NOT NULL THEN 'included' ELSE decision END AS decision, coalesce(chosen, sequence) AS sequence, NOT (chosen IS NOT NULL OR decision = 'included') AS blocks FROM d LEFT JOIN h USING (note)
""")
def note_decisions(t: Tables) -> DataFrame:
    """Notes resolved where their candidates have one sequence, hand-made choices put in, and which of them still keep a run from being made."""
    found = t.orders.where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("note"), F.col("o_orderpriority").alias("sequence"))
    decisions = scope.resolved(t.customer.select(F.col("c_custkey").alias("note")), found)
    done = catalog.resolutions_applied(decisions, found, found.where("note % 2 = 0").groupBy("note").agg(F.min("sequence").alias("sequence")))
    blocked = catalog.run_blockers(done).select("note", F.lit(True).alias("b"))
    return done.join(blocked, "note", "left").select("note", "decision", "sequence", F.coalesce("b", F.lit(False)).alias("blocks"))


@query("""
SELECT 'u' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS unit_id, max(l_returnflag) AS source, 'T' || l_partkey AS target FROM lineitem WHERE l_orderkey % 5 = 0 AND l_returnflag <> 'N' GROUP BY l_orderkey, l_linenumber, l_partkey
""")
def manifest_requirements(t: Tables) -> DataFrame:
    """Required targets out of stored manifests, where some units have none."""
    unit = F.concat(F.lit("u"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    required = F.when(F.col("l_returnflag") != "N", F.struct(F.col("l_returnflag").alias("source"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("target")))
    lines = t.lineitem.where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.collect_list(F.struct(unit.alias("unit_id"), F.lit("").alias("source_sha256"), required.alias("required"))).alias("units"))
    bodies = lines.select(F.to_json(F.struct(F.array(F.struct("units")).alias("articles"))).alias("body"))
    return catalog.requirements(bodies, "body")


@query("""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(text[1:60], '[A-Za-z]{4,}')[1] AS token, text[1:60] AS s FROM documents WHERE doc_id % 6 = 0) SELECT doc_id AS unit, replace(s, token, 'X' || len(token)) AS target, token AS tokens FROM w WHERE token IS NOT NULL AND len(token) % 2 = 0
""")
def remediated_units(t: Tables) -> DataFrame:
    """Foreign tokens replaced; a unit with a token that has no replacement is left out."""
    token = F.get(F.regexp_extract_all(F.substring("text", 1, 60), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lit(0))
    f = t.documents.where("doc_id % 6 = 0").select(F.col("doc_id").alias("unit"), F.substring("text", 1, 60).alias("text"), token.alias("token")).where("token IS NOT NULL")
    f = f.withColumn("replacement", F.when(F.length("token") % 2 == 0, F.concat(F.lit("X"), F.length("token").cast("string"))))
    return catalog.remediation(f).select("unit", "target", F.array_join("tokens", " ").alias("tokens"))


@query("""
WITH b AS (SELECT event_id AS batch, CASE WHEN event_id % 2 = 0 THEN 'leased' ELSE 'queued' END AS state, CAST(user_id AS VARCHAR) AS token FROM events), r AS (SELECT event_id AS batch, CAST(user_id + event_id % 3 // 2 AS VARCHAR) AS token, event_id % 5 <> 0 AS valid FROM events WHERE event_id % 7 <> 0),
j AS (SELECT b.*, valid FROM b LEFT JOIN r USING (batch, token)), n AS (SELECT batch, token, CASE WHEN state = 'leased' AND valid THEN 'validated' WHEN state = 'leased' AND NOT valid THEN 'queued' ELSE state END AS state FROM j)
SELECT batch, state, CASE WHEN state = 'leased' THEN token END AS token FROM n
""")
def ingested_batches(t: Tables) -> DataFrame:
    """Responses count only with the lease token of their batch's claim."""
    user = F.col("user_id")
    b = t.events.select(F.col("event_id").alias("batch"), F.when(F.col("event_id") % 2 == 0, "leased").otherwise("queued").alias("state"), user.cast("string").alias("token"))
    r = t.events.where("event_id % 7 != 0").select(F.col("event_id").alias("batch"), (user + F.expr("event_id % 3 div 2")).cast("string").alias("token"), (F.col("event_id") % 5 != 0).alias("valid"))
    return catalog.ingested(b, r)


@query("""
SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)) AS judged
""")
def missing_by_version(t: Tables) -> DataFrame:
    """How many rows of the first version each other one lacks."""
    n = t.labels.select("doc_id", F.lit(1).alias("v"))
    return catalog.missing_translations({"all": t.documents.select("doc_id"), "good": t.labels.where("quality = 1").select("doc_id", F.lit(1).alias("v")), "judged": n}, ["doc_id"], "v")


@query("""
SELECT doc_id, n_chars AS n_original, n_chars + doc_id % 2 AS n_current FROM documents
""")
def versions_side_by_side(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.col("n_chars").alias("n"))
    return catalog.side_by_side(d, d.withColumn("n", F.col("n") + F.col("doc_id") % 2), ["doc_id"], ["n"])
