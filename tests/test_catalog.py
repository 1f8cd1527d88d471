import datetime
import json

import pytest
from granary.functions import jsontree as J
from granary.operators import catalog as C
from granary.operators import tree
from granary.streaming import events as E
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_catalog_and_tags(spark):
    tags = spark.createDataFrame([("c", "a", "x", "d", "p"), ("c", "a", "x", "d", "p"), ("c", "b", "x", "", "q")], "category string, code string, label string, description string, provenance string")
    assert {r.issue for r in C.catalog_issues(tags).collect()} == {"repeated_code", "incomplete", "shared_label", "several_provenances"}
    with pytest.raises(Exception, match="no description of b"):
        C.descriptions(tags).collect()
    tag = lambda label: {"tag": "span", "data": {"code": "n", "label": label, "title": "t"}, "content": label}
    df = spark.createDataFrame([(1, json.dumps([tag("noun"), tag("n."), tag("noun")])), (2, json.dumps([tag("сущ.")]))], "id long, body string")
    before, after = (tree.node_table(df.where(f"id = {k}"), "id", "body") for k in (1, 2))
    v = C.tag_variants(before).first()
    assert [tuple(x) for x in v.labels] == [("n.", 1), ("noun", 2)] and [tuple(x) for x in v.titles] == [("t", 3)]
    assert rows(C.unification(before, after)) == [("n", 2, 1, True)]
    m = spark.createDataFrame([("n", "сущ.")], "code string, label string")
    assert C.uncanonical(before, m).count() == 3 and C.uncanonical(after, m).count() == 0
    bank = spark.createDataFrame([("сущ.",), ("сущ.",), ("zzz",)], "label string")
    assert rows(C.bank_issues(bank, m.union(spark.createDataFrame([("v", "гл.")], m.schema)))) == sorted([("zzz", "unknown"), ("сущ.", "repeated"), ("гл.", "missing")], key=str)


def test_manifests_and_repairs(spark):
    unit = lambda i, t: {"unit_id": i, "source_sha256": "s", "required": None if t is None else {"source": "a", "target": t}}
    body = lambda *u: json.dumps({"articles": [{"units": list(u)}]})
    df = spark.createDataFrame([(body(unit("u1", "x"), unit("u2", None)),), (body(unit("u1", "x")),)], "b string")
    assert rows(C.requirements(df, "b")) == [("u1", "a", "x")]
    assert [None if r.payload is None else [tuple(p) for p in r.payload] for r in C.required_payload(df, "b").collect()] == [None, [("u1", "x")]]
    with pytest.raises(Exception, match="two targets for u1"):
        C.requirements(df.union(spark.createDataFrame([(body(unit("u1", "y")),)], "b string")), "b").collect()
    f = spark.createDataFrame([("u", "ab abc", "ab", "X"), ("u", "ab abc", "abc", "Y"), ("v", "q", "q", None)], "unit string, text string, token string, replacement string")
    assert rows(C.remediation(f)) == [("u", "X Y", ["ab", "abc"])]
    assert spark.range(1).select(C.localised_templates(F.lit("See also: x"), {"See": "См.", "See also:": "См. также:"})).first()[0] == "См. также: x"


def test_decisions_and_ingestion(spark):
    d = spark.createDataFrame([(1, "included", 10), (2, "unresolved", None)], "note long, decision string, sequence long")
    cand = spark.createDataFrame([(2, 20), (2, 21)], "note long, sequence long")
    done = C.resolutions_applied(d, cand, spark.createDataFrame([(2, 21)], "note long, sequence long"))
    assert rows(done) == [(1, "included", 10), (2, "included", 21)] and C.run_blockers(done).count() == 0 and C.run_blockers(d).count() == 1
    with pytest.raises(Exception, match="isn't a candidate"):
        C.resolutions_applied(d, cand, spark.createDataFrame([(2, 99)], "note long, sequence long")).collect()
    b = spark.createDataFrame([("a", "leased", "t1"), ("b", "leased", "t2"), ("c", "done", None), ("d", "leased", "t4")], "batch string, state string, token string")
    r = spark.createDataFrame([("a", "t1", True), ("a", "t1", True), ("b", "old", True), ("d", "t4", False)], "batch string, token string, valid boolean")
    assert rows(C.ingested(b, r)) == sorted([("a", "validated", None), ("b", "leased", "t2"), ("c", "done", None), ("d", "queued", None)], key=str)


def test_schemas_gates_and_files(spark, tmp_path):
    schema = {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "pattern": "^x", "minLength": 2}, "b": {"enum": [1, 2]}}}}
    df = spark.createDataFrame([('[{"a": "xy", "b": 1}]',), ('[{"a": "y", "b": 3, "c": 0}, {}, 1]',), ("[]",), (None,)], "body string")
    got = [r.issues for r in C.checked_by_schema(df, "body", schema).collect()]
    assert got == [[], ["/0/a: length", "/0/a: pattern", "/0/b: enum", "/0/c: unknown", "/1/a: required", "/2: type"], ["/: size"], None]
    assert C.output_struct([{"unit_id": "u-1", "role": "glossary_set"}, {"unit_id": "u-2", "role": "note"}]) == "`u-1` array<string>, `u-2` string"
    d = {"ids": [1, 2]}
    (tmp_path / "s.json").write_text(json.dumps(d | {"sha256": J.digest(d)}))
    assert C.verified_selection(str(tmp_path / "s.json")) == d
    (tmp_path / "s.json").write_text(json.dumps({"ids": [1], "sha256": J.digest(d)}))
    with pytest.raises(ValueError):
        C.verified_selection(str(tmp_path / "s.json"))
    C.gate({"a": True}, {"a"})
    for bad in ({"a": False}, {}, {"a": True, "b": True}):
        with pytest.raises(ValueError):
            C.gate(bad, {"a"})
    full = {"indexUrl": "https://x", "downloadUrl": "https://y", "isUpdatable": True}
    assert C.metadata_issues(full, True) == [] and C.metadata_issues({}, False) == [] and C.metadata_issues(full | {"indexUrl": "http://localhost/"}, False) == ["update fields", "local: indexUrl"]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert rows(C.side_by_side(a, a, ["k"], ["v"])) == [(1, "x", "x"), (2, "y", "y")]
    with pytest.raises(Exception, match="one side only"):
        C.side_by_side(a, a.where("k = 1"), ["k"], ["v"]).collect()
    assert spark.range(1).select(C.refreshed(F.lit("a <t>1</t>"), "<t>.*</t>", "<t>2</t>")).first()[0] == "a <t>2</t>"
    assert C.missing_translations({"a": a, "b": a.where("k = 1")}, ["k"], "v").first().b == 1
    assert C.approval(a.union(a)).where("n = 2").count() == 2
    assert C.sample_envelopes(spark, 5).count() == 5


def test_window_hash_phases_and_names(spark):
    p = spark.createDataFrame([("b", "window", "completed"), ("a", "window", "completed"), ("z", "drain", "completed")], "id string, place string, event string")
    one, two = E.window_ids(p, "id").first(), E.window_ids(p.repartition(3), "id").first()
    assert one == two and one.n == 2
    phases = E.Phases()
    with phases("scan", rows=3) as row:
        row["seen"] = 3
    assert phases.rows[0]["phase"] == "scan" and phases.rows[0]["seen"] == 3 and phases.rows[0]["wall"] >= 0
    assert [E.backoff(k) for k in (0, 1, 9)] == [0.05, 0.1, 2.0]
    assert E.revision("scope", datetime.datetime(2024, 1, 2, 3, 4)) == "scope-20240102.0304"
